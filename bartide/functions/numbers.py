"""Scalar Column expressions on numbers: rounding, rates, cleaning, digit grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def as_col(value) -> Column:
    """A column name, a Column or a number, as a Column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def ratio(top, bottom) -> Column:
    """top / bottom, null where the divisor is 0 or null (ANSI-safe)."""
    return as_col(top) / F.nullif(as_col(bottom), F.lit(0.0))


def growth(now, base) -> Column:
    """now / base - 1 where the base is positive, else null."""
    base = as_col(base)
    return F.when(base > 0, as_col(now) / base - 1)


def half_even(value, digits: int) -> Column:
    """Banker's rounding, as the numeric stack of the analysts and the SQL round: of the scaled number, whose product may be a tie where the decimals
    that Spark's bround looks at are none (116.14999999999999 to one digit), or none where they are one (627.675 to two)."""
    scale = 10.0 ** digits
    return F.rint(as_col(value) * scale) / scale + F.lit(0.0)  # no negative zero


def half_away(value, digits: int) -> Column:
    """Rounding of the scaled number with ties away from zero, as SQL's round; Spark's own takes ties by the shortest decimals."""
    value, scale = as_col(value), 10.0 ** digits
    size = F.abs(value * scale)
    whole = F.rint(size)
    whole = F.when(size - whole >= 0.5, whole + 1).otherwise(whole) / scale
    return F.when(value < 0, -whole).otherwise(whole) + F.lit(0.0)


def missing_to_null(value) -> Column:
    """NaN counts as missing; infinities stay values."""
    value = as_col(value)
    return F.when(~F.isnan(value), value)


def is_infinite(value) -> Column:
    return F.abs(as_col(value)) == float("inf")


def parse_number(text) -> Column:
    """'₹1,234.5%' -> 1234.5; blank, '-' and words -> null."""
    return F.regexp_replace(as_col(text), r"[^0-9.\-]", "").try_cast("double")


def group_rupees(amount) -> Column:
    """Whole rupees with Indian digit grouping: 123456789 -> 12,34,56,789."""
    whole = F.abs(half_even(amount, 0)).cast("decimal(30,0)").cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")
    return F.concat(F.when(half_even(amount, 0) < 0, "-").otherwise(""), grouped)


def per_session_rate(annual, sessions: int = TRADING_DAYS) -> Column:
    """Annual rate to a compounding one-session rate."""
    return F.pow(1 + as_col(annual), F.lit(1.0 / sessions)) - 1


def annualised_vol(session_vol, sessions: int = TRADING_DAYS) -> Column:
    return as_col(session_vol) * F.lit(float(sessions) ** 0.5)


def horizon_scaled(move, sessions, full_sessions: int = 63) -> Column:
    """Square-root-of-time scaling of a full-horizon move to fewer sessions."""
    return as_col(move) * F.sqrt(as_col(sessions) / F.lit(float(full_sessions)))
