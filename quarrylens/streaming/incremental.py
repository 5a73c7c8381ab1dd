"""Incremental analysis of arriving files (S2, A4) with Structured Streaming.

Files come as micro-batches. Counts are kept by stateful aggregation; issues
are appended to a table batch by batch, exactly once by batch number. Both end
with what there is now (availableNow) or go on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.lines import line_count
from quarrylens.operators.style import issues
from quarrylens.session import checkpoint_dir


def extension_counts(stream: DataFrame) -> DataFrame:
    """Files and lines by extension, over all that has come."""
    return stream.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext")).agg(
        F.count("*").alias("files"), F.sum(line_count(F.col("content"))).cast("bigint").alias("lines"))


def append_issues(stream: DataFrame, table: str, checkpoint: str):
    """Style issues of each micro-batch, written under its batch number so that a repeated batch replaces itself."""
    def batch(files: DataFrame, number: int) -> None:
        issues(files.select("file_id", "path", "content")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The php_files table read as a stream, counted to the end; late rows are rows like any other."""
    static = spark.read.parquet(f"{sf_dir}/php_files.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/php_files.parquet*")
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = extension_counts(stream.where(F.col("content").isNotNull()).select("path", "content"))

    def keep(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out")

    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES = {"stream_file_count": stream_file_count}
ORACLE = {
    "stream_file_count": """SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, count(*) AS files,
CAST(sum(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN right(content, 1) = chr(10) THEN 0 ELSE 1 END END) AS BIGINT) AS lines
FROM php_files WHERE content IS NOT NULL GROUP BY 1""",
}
