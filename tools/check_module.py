"""Compare only the queries of the named plan modules: python tools/check_module.py folder module ..."""

from __future__ import annotations

import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import check  # noqa: E402

if __name__ == "__main__":
    names = [q.name for m in sys.argv[2:] for q in importlib.import_module(f"bartide.plans.{m}").QUERIES]
    sys.exit(1 if check.main(sys.argv[1], names) else 0)
