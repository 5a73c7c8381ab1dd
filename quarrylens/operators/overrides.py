"""Suppression by patterns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise(pattern: str) -> str | None:
    """`/re/` is a search, plain text an exact name; blank patterns are none. A bad expression raises."""
    p = pattern.strip()
    if len(p) >= 2 and p.startswith("/") and p.endswith("/"):
        p = p[1:-1]
        if not p:
            return None
        re.compile(p)
        return p
    return f"^{re.escape(p)}$" if p and p != "/" else None


def compiled(overrides: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(rule code, expression) of every pattern that says something."""
    return [(code, r) for code, patterns in overrides.items() for r in map(normalise, patterns) if r]


def suppress(issues: DataFrame, overrides: dict[str, list[str]]) -> DataFrame:
    """Rows that no pattern of their rule suppresses.

    Configured patterns are a handful, so they become one predicate over the
    row: no join at all. Only class subjects with a name can be suppressed.
    """
    rules = compiled(overrides)
    hit = F.lit(False)
    for code, expression in rules:
        hit = hit | ((F.col("code") == code) & F.col("subject_name").rlike(expression))
    subject = (F.col("subject_kind") == "class") & (F.col("subject_name") != "")
    return issues.where(~F.coalesce(subject & hit, F.lit(False)))
