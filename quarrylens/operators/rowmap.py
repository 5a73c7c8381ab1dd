"""Arrow-batched row functions: the one place where rows pass through Python."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

T = TypeVar("T")
#: Rows gathered before an output batch is sent on.
OUT_ROWS = 4096
#: Models a worker process keeps.
KEPT = 8
_KEPT: dict[Hashable, object] = {}


def per_worker(key: Hashable, build: Callable[[], T]) -> T:
    """What `build` gives, kept for further tasks of this worker process; `key` stands for all it depends on."""
    if key not in _KEPT:
        while len(_KEPT) >= KEPT:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = build()
    return _KEPT[key]


def flat_map(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | StructType, out_rows: int = OUT_ROWS) -> DataFrame:
    """Each row becomes any number of rows.

    `make` is called once a task and returns the row function, so models and
    caches are built where they are used; the row function gets the columns of
    `df` in order. An empty input gives an empty output of the same schema.
    """
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    names, types = [f.name for f in arrow], [f.type for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = make(), []

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        for b in batches:
            if not b.num_rows:
                continue
            step = max(1, min(b.num_rows, 512))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.extend(fn(*row))
                    if len(out) >= out_rows:
                        yield batch()
                        out.clear()
        if out:
            yield batch()

    return df.mapInArrow(run, struct)


def fold(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """The rows that `fn` gives for all rows of a partition; it reads them one after the other, so what it keeps is up to it."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = list(fn(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], [f.name for f in arrow])

    return df.mapInArrow(run, struct)
