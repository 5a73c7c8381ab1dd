"""Name helpers as column expressions (2.10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_key(name: Column) -> Column:
    """Trimmed, one leading backslash off, lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r"^\\", ""))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))


def pascal_case(name: Column) -> Column:
    """Words between underscores, each with a capital."""
    return F.array_join(F.transform(F.split(name, "_"), _capital), "")


def camel_case(name: Column) -> Column:
    p = pascal_case(name)
    return F.concat(F.lower(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))


def unqualified(name: Column) -> Column:
    """What follows the last backslash."""
    return F.element_at(F.split(name, r"\\"), -1)


def plural(n: Column, word: str) -> Column:
    return F.when(n == 1, word).otherwise(word + "S")
