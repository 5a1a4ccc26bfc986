"""All registered queries."""

from __future__ import annotations

import importlib
from dataclasses import replace

from bartide.plans.catalog import Query

MODULES = ("indicators", "prices", "screens", "risk", "options", "ledger", "backtests", "feeds", "landed", "growing")


#: modules whose queries read bars, members, factors or chains in several places
SHARED = {"screens", "risk", "options", "ledger", "backtests", "growing"}


def all_queries() -> list[Query]:
    found = [replace(q, shared=name in SHARED) for name in MODULES for q in importlib.import_module(f"bartide.plans.{name}").QUERIES]
    names = [q.name for q in found]
    assert len(names) == len(set(names)), sorted(n for n in names if names.count(n) > 1)
    return found


def by_name() -> dict[str, Query]:
    return {q.name: q for q in all_queries()}
