"""Problem 9: filling fixed-capacity containers with items, mixture-controlled.

Items are served by deficit round robin over source queues. Each window adds a
quantum to a queue's deficit counter: the queue's target share of the window's
tokens. The head of the queue is sent once the counter covers its size, which
is then taken off; what is left of the counter is carried to the next window.
So an item goes out in the first window k in which (k + 1) quanta cover the
tokens up to its end, and the counter behind window k is (k + 1) quanta less
the tokens sent. Those running sums are taken in two steps, sums per slice of a
queue and then within slices: deficits carry over slices, partitions and
windows alike, and a queue with a third of all rows is never in one task.
Every window holds the target mixture, but for less than one item a queue.

A window is packed on its own, best fit with the largest first. Items of
containers that stay open are served once more by the same round robin, so the
second level's windows hold the mixture of what was left.

Targets are the corpus's own token shares unless given; sources without a
target share the rest by their tokens, and a queue that runs dry leaves its
later windows to the others. A document of more than `capacity` tokens is cut
into full containers and a rest; no other one is split. Documents without
tokens (null or empty text) are put in with token count 0, dealt over windows
by hash. A null source is a queue of its own. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrylens.llm.encode import token_counts
from quarrylens.session import checkpointed
from quarrylens.sources.tables import table

CAPACITY = 2048
#: Containers a window holds about.
WINDOW = 256
#: A container is open below this share of its capacity.
FULL = 0.99
#: Rows a window holds about at most, where items have few or no tokens.
ROWS = 1 << 20
#: Rows a slice of a queue holds about.
SLICE = 4096


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item: the fullest one that still takes it, largest items first."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    free: list[tuple[int, int]] = []  # (room left, container)
    out, n = [0] * len(sizes), 0
    for i in order:
        s = sizes[i]
        k = bisect_left(free, (s, -1))
        if s >= capacity or k == len(free):
            room, c = capacity, n
            n += 1
        else:
            room, c = free.pop(k)
        out[i] = c
        if room - s > 0 or s == 0:
            insort(free, (room - s, c))
    return out


def windows(items: DataFrame, capacity: int, per_window: int = WINDOW, targets: dict[str, float] | None = None) -> DataFrame:
    """`items` (doc_id, source, first, size) with the window that serves each and the quantum of its queue."""
    items = items.withColumn("queue", F.coalesce("source", F.lit("\0none")))
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
    n_slices = max(1, -(-total["n"] // SLICE))
    n_windows = max(1, -(-total["tokens"] // (per_window * capacity)), -(-total["n"] // ROWS))
    items = items.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(n_slices)))
    sums = items.groupBy("queue", "slice").agg(F.sum("size").alias("slice_tokens"))
    queue = W.partitionBy("queue")
    sums = sums.select("queue", "slice",
                       (F.sum("slice_tokens").over(queue.orderBy("slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("slice_tokens")).alias("before"),
                       F.sum("slice_tokens").over(queue).alias("queue_tokens"))
    share = F.col("queue_tokens") / F.lit(max(1, total["tokens"]))
    if targets:
        scale = max(1.0, sum(targets.values()))
        given = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, v / scale)])[F.col("queue")]
        # Sources without a target share what the others leave, by their tokens.
        free = items.where(~F.col("queue").isin(*targets)).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        share = F.coalesce(given, F.col("queue_tokens") / F.lit(max(1, free)) * F.lit(1 - sum(targets.values()) / scale))
    quantum = F.greatest(share * F.lit(total["tokens"] / n_windows), F.lit(1.0))
    inside = W.partitionBy("queue", "slice").orderBy("doc_id", "first").rowsBetween(W.unboundedPreceding, 0)
    items = items.withColumn("inside", F.sum("size").over(inside)).join(sums.withColumn("quantum", quantum), ["queue", "slice"])
    # The first window whose credit covers the item; with the corpus's shares all queues end in the last window.
    served = F.ceil((F.col("before") + F.col("inside")) / F.col("quantum") - F.lit(1e-9)) - 1
    served = F.greatest(served, F.lit(0)) if targets else F.greatest(F.least(served, F.lit(n_windows - 1)), F.lit(0))
    return items.select("doc_id", "source", "first", "size", "quantum",
                        F.when(F.col("size") == 0, F.pmod(F.xxhash64("doc_id", "first"), F.lit(n_windows))).otherwise(served).cast("long").alias("win"))


def deficits(served: DataFrame) -> DataFrame:
    """(win, source, tokens, quantum, deficit): what each queue sent in a window and what its counter carries on."""
    per = served.groupBy("source", "win").agg(F.sum("size").alias("tokens"), F.max("quantum").alias("quantum"))
    sent = F.sum("tokens").over(W.partitionBy("source").orderBy("win").rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("deficit", (F.col("win") + 1) * F.col("quantum") - sent)


def pack(items: DataFrame, capacity: int = CAPACITY, per_window: int = WINDOW, targets: dict[str, float] | None = None) -> DataFrame:
    """(container, place, doc_id, source, first_token, n_tokens) of items (doc_id, source, first, size); sizes at most `capacity`."""
    schema = "container long, place int, doc_id long, source string, first long, size long, is_open boolean"

    def level(no: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "first"], kind="stable").reset_index(drop=True)
            win = int(pdf["win"].iloc[0])
            local = pd.Series(best_fit(pdf["size"].tolist(), capacity))
            filled = pdf["size"].groupby(local).transform("sum")
            return pd.DataFrame({"container": (no << 60) + (win << 20) + local, "place": pdf.groupby(local).cumcount().astype("int32"), "doc_id": pdf["doc_id"],
                                 "source": pdf["source"], "first": pdf["first"], "size": pdf["size"], "is_open": filled < FULL * capacity})

        return one

    first = checkpointed(windows(items, capacity, per_window, targets).groupBy("win").applyInPandas(level(0), schema))
    left = first.where("is_open").select("doc_id", "source", "first", "size")
    again = windows(left, capacity, per_window).groupBy("win").applyInPandas(level(1), schema)
    return first.where("NOT is_open").unionByName(again).select(
        "container", "place", "doc_id", "source", F.col("first").alias("first_token"), F.col("size").alias("n_tokens"))


def pieces(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Items of documents: full containers of what is too long, and the rest."""
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0))
    return (counts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
            .select("doc_id", "source", (F.col("k") * capacity).alias("first"),
                    F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("k") * capacity).alias("size")))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(checkpointed(token_counts(table(spark, sf_dir, "documents", "doc_id", "source", "text")))))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).drop("source")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, win, n_containers, n_tokens, fill, deviation) of the windows of the final containers.

    `deviation` is the greatest distance of a source's share of the window's tokens from its share of all tokens.
    """
    packed = checkpointed(_packed(spark, sf_dir))
    level, win = F.shiftright("container", 60).alias("level"), F.shiftright(F.col("container").bitwiseAND((1 << 60) - 1), 20).alias("win")
    sums = packed.groupBy(level, win, "source").agg(F.sum("n_tokens").alias("tokens"))
    total = packed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shares = packed.groupBy("source").agg((F.sum("n_tokens") / F.lit(max(1, total))).alias("share"))
    windows_ = packed.groupBy(level, win).agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    off = sums.join(windows_.select("level", "win", "n_tokens"), ["level", "win"]).join(shares, sums["source"].eqNullSafe(shares["source"])).groupBy("level", "win").agg(
        F.max(F.abs(F.col("tokens") / F.greatest("n_tokens", F.lit(1)) - F.col("share"))).alias("deviation"))
    return windows_.join(off, ["level", "win"]).select("level", "win", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 4).alias("fill"), F.round("deviation", 4).alias("deviation"))
