"""Nearest-position joins (J14, J19) without pairing rows.

Both sides are laid one after the other, sorted within a key, and the last
value seen is carried on: one shuffle, one sort, no product of matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nearest_before(left: DataFrame, right: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """`left` with `value` of the row of `right` of the same key that is nearest at or before `position`; null where there is none.

    `right` has one row a position. A null key or position on the left matches nothing.
    """
    columns = [c for c in left.columns]
    a = left.select(*columns, F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    b = right.select(key, position, F.col(value).alias("_value"), F.lit(0).alias("_side"))
    w = W.partitionBy(key).orderBy(position, "_side").rowsBetween(W.unboundedPreceding, 0)
    u = a.unionByName(b, allowMissingColumns=True)
    return u.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select(*columns, value)
