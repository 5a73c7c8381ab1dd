"""Problem 2: per-key results where a few keys hold most rows.

Both results use algebraic aggregates only: a task combines its rows in a hash
table (spilling when it is full), so a key that holds a third of all rows sends
one partial row per task, not its rows. Distinct lines take two such steps, by
(key, line) and then by key. A null key is no key; null lines are not counted
as lines. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.sources.tables import table

#: A key is heavy from this share of its tool's rows on.
HEAVY_SHARE = 0.04


_TOOLS = "tool IN ('style', 'analyse')"  # an enumeration of two


def _keys(issues: DataFrame, *more: str) -> DataFrame:
    """(tool, field, key_text, more...) of every non-null code and filename."""
    fields = F.expr("inline(array(struct('code' AS field, code AS key_text), struct('filename' AS field, filename AS key_text)))")
    return issues.where(_TOOLS).select("tool", *more, fields).where("key_text IS NOT NULL")


def _weighed(keys: DataFrame, issues: DataFrame) -> DataFrame:
    """`keys` with whether each holds HEAVY_SHARE of its tool's rows, null keys among them; the totals are one row a tool from a scan of that column."""
    totals = issues.where(_TOOLS).groupBy("tool").agg(F.count("*").alias("tool_rows"))
    return keys.join(totals, "tool").withColumn("heavy", F.col("rows") >= HEAVY_SHARE * F.col("tool_rows"))


def heavy_keys(issues: DataFrame) -> DataFrame:
    """(tool, field, key_text, rows, tool_rows, heavy): counts alone, so that only one row a key and task is shuffled."""
    return _weighed(_keys(issues).groupBy("tool", "field", "key_text").agg(F.count("*").alias("rows")), issues)


def per_key(issues: DataFrame) -> DataFrame:
    """(tool, field, key_text, rows, distinct_lines, tool_rows, heavy) of every non-null code and filename."""
    lines = _keys(issues, "line").groupBy("tool", "field", "key_text", "line").agg(F.count("*").alias("n"))
    return _weighed(lines.groupBy("tool", "field", "key_text").agg(F.sum("n").alias("rows"), F.count("line").alias("distinct_lines")), issues)


def _named(df: DataFrame) -> DataFrame:
    tool = F.when(F.col("tool") == "analyse", "analysis").otherwise(F.col("tool"))
    return df.withColumn("field_name", F.concat_ws("_", tool, "field"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names the heavy keys."""
    issues = table(spark, sf_dir, "issues", "tool", "code", "filename")
    return _named(heavy_keys(issues)).where("heavy").select("field_name", "key_text")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and distinct lines of every key."""
    issues = table(spark, sf_dir, "issues", "tool", "code", "filename", "line")
    return _named(per_key(issues)).select("field_name", "key_text", F.col("rows").alias("n_rows"), "distinct_lines", "heavy")


_KEYS = """
WITH k AS (
  SELECT CASE tool WHEN 'analyse' THEN 'analysis' ELSE tool END || '_code' AS field_name, code AS key_text, line FROM issues
  WHERE tool IN ('style', 'analyse')
  UNION ALL
  SELECT CASE tool WHEN 'analyse' THEN 'analysis' ELSE tool END || '_filename', filename, line FROM issues
  WHERE tool IN ('style', 'analyse')
), t AS (SELECT field_name, count(*) AS total FROM k GROUP BY field_name),
g AS (SELECT field_name, key_text, count(*) AS n_rows, count(DISTINCT line) AS distinct_lines FROM k
      WHERE key_text IS NOT NULL GROUP BY field_name, key_text)
"""
ORACLE = {
    "p2_found": _KEYS + "SELECT g.field_name, key_text FROM g JOIN t USING (field_name) WHERE n_rows >= 0.04 * total",
    "p2_counts": _KEYS + "SELECT g.field_name, key_text, n_rows, distinct_lines, n_rows >= 0.04 * total AS heavy FROM g JOIN t USING (field_name)",
}
QUERIES = {"p2_found": found, "p2_counts": counts}
