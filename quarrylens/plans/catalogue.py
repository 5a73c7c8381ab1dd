"""All queries of the core with their SQL."""

from __future__ import annotations

from quarrylens.operators import level0, lines, php_tables, skew, style
from quarrylens.plans import fixtures, relational, reports
from quarrylens.streaming import incremental

_MODULES = (reports, skew, lines, relational, php_tables, level0, style, fixtures, incremental)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
