"""Market and portfolio analytics as DataFrame -> DataFrame functions over tall (symbol, session) tables."""

__version__ = "0.1.0"
