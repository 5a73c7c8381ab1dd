"""Directory trees as tables (S1-S5): one row a file, bytes only where a query needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.config import Config

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _table(raw: DataFrame, config: Config, root: str) -> DataFrame:
    local = F.regexp_replace("path", r"^file:(//)?", "")
    base = root.rstrip("/") + "/"
    relative = F.when(F.startswith(local, F.lit(base)), F.substr(local, F.lit(len(base) + 1))).otherwise(local)
    parts = F.split(relative, "/")
    files = raw.select(F.xxhash64(local).alias("file_id"), relative.alias("path"), parts[0].alias("project"), "length", "content")
    return files.where(_wanted(F.col("path"), config)).select(
        "file_id", "path", "project", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"), F.col("length").alias("n_bytes"), F.decode("content", "UTF-8").alias("content"))


def _wanted(path: Column, config: Config) -> Column:
    """an extension of the list, and no ignored directory on the way (the root itself included)."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*[e.lstrip(".") for e in config.extensions])
    dirs = F.split(F.regexp_replace(path, r"(^|/)[^/]*$", ""), "/")
    return ext & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in config.ignore])) if config.ignore else ext


def scan(spark: SparkSession, config: Config, root: str | None = None) -> DataFrame:
    """(file_id, path, project, ext, n_bytes, content) of a tree; content is read only where it is selected.

    The file source plans no split for a file of length 0, so empty files give no row.
    """
    root = root or config.path
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _table(raw, config, root)


def scan_stream(spark: SparkSession, config: Config, root: str | None = None) -> DataFrame:
    """The same as a stream; each file comes once."""
    root = root or config.path
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(root)
    return _table(raw, config, root)
