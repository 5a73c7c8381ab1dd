"""Bounded samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_keys(df: DataFrame, key: str, label: str, per_label: int) -> list:
    """At most `per_label` keys for each value of `label`, the same ones for the same rows.

    Keys fall into per_label hash buckets and the smallest hash of each bucket
    stays, so the aggregate combines on the map side and its result is bounded
    by the number of labels times per_label, whatever the table holds.
    """
    h = F.xxhash64(F.col(key))
    rows = (df.where(F.col(key).isNotNull() & F.col(label).isNotNull())
            .groupBy(label, F.pmod(h, F.lit(per_label)).alias("b")).agg(F.min_by(key, h).alias("k")))
    by = defaultdict(list)
    for r in rows.toLocalIterator():
        by[r[0]].append(r["k"])
    return sorted(k for ks in by.values() for k in ks)
