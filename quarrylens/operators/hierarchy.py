"""Reachability over parent edges.

The closure is built by doubling. Besides all pairs up to distance n it keeps
the pairs that are joined by a walk of exactly n edges; all pairs up to 2n are
the old ones and those with such a walk behind them. So depth d takes log2(d)
steps, and a tree's pairs are made once each rather than at every cut of their
path. Cycles end because a pair is kept once, at its least distance. Each step
is written to the checkpoint folder: plans stay short, and a lost executor
costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import checkpointed


def closure(edges: DataFrame, child: str, parent: str, steps: int = 32, rank: str | None = None) -> DataFrame:
    """(node, ancestor, depth) of every pair, depth at least 1; a node on a cycle is no ancestor of itself.

    With the integer column `rank` of the edges, `rank` of a pair is the least, over its paths, of the greatest on the path.
    """
    r = F.lit(0) if rank is None else F.col(rank)
    step = F.greatest("rank", "jump_rank").alias("rank")
    exact = edges.where(F.col(child) != F.col(parent)).groupBy(F.col(child).alias("node"), F.col(parent).alias("ancestor")).agg(F.min(r).cast("int").alias("rank"))
    exact = checkpointed(exact)
    pairs, length = exact.withColumn("depth", F.lit(1)), 1
    size = F.struct(F.count("*").alias("n"), F.coalesce(F.sum("rank"), F.lit(0)).alias("r"))
    n = exact.agg(size).first()[0]
    for _ in range(steps):
        jump = exact.select(F.col("node").alias("mid"), F.col("ancestor").alias("far"), F.col("rank").alias("jump_rank"))
        longer = (pairs.withColumnRenamed("ancestor", "mid").join(jump, "mid").where(F.col("node") != F.col("far"))
                  .select("node", F.col("far").alias("ancestor"), step, (F.col("depth") + length).alias("depth")))
        pairs = checkpointed(pairs.unionByName(longer).groupBy("node", "ancestor").agg(F.min("rank").alias("rank"), F.min("depth").alias("depth")))
        m = pairs.agg(size).first()[0]
        if m == n:
            break
        exact = checkpointed(exact.withColumnRenamed("ancestor", "mid").join(jump, "mid").where(F.col("node") != F.col("far"))
                             .select("node", F.col("far").alias("ancestor"), step).groupBy("node", "ancestor").agg(F.min("rank").alias("rank")))
        n, length = m, 2 * length
    return pairs if rank else pairs.drop("rank")


def nearest(pairs: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """The nearest ancestor of each node among `flagged` (column `key`, all its columns come along)."""
    hit = pairs.join(flagged.withColumnRenamed(key, "ancestor"), "ancestor")
    return hit.groupBy("node").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("ancestor"), F.min("depth").alias("depth"))
