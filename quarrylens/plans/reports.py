"""Grouped reports over scan results and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrylens.operators.overrides import suppress
from quarrylens.sources.tables import table


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a scan: a read error counts as one error, a null count as none."""
    r = table(spark, sf_dir, "file_results", "path", "project", "error_count", "first_error", "read_error", "scanned_at")
    bad = F.col("read_error").isNotNull() & (F.col("read_error") != "")
    return r.select("path", F.coalesce("project", F.split("path", "/")[0]).alias("project"),
                    F.when(bad, 1).otherwise(F.coalesce("error_count", F.lit(0))).alias("errors"),
                    F.when(bad, F.col("read_error")).otherwise(F.nullif("first_error", F.lit(""))).alias("first_error"), "scanned_at")


_RESULTS = """r AS (SELECT path, coalesce(project, split_part(path, '/', 1)) AS project,
  CASE WHEN read_error <> '' THEN 1 ELSE coalesce(error_count, 0) END AS errors,
  CASE WHEN read_error <> '' THEN read_error ELSE nullif(first_error, '') END AS first_error, scanned_at FROM file_results)"""


def percent(passing: Column, total: Column) -> Column:
    """100 where there is nothing to pass."""
    return F.when(total == 0, 100.0).otherwise(F.round(passing * 100.0 / total, 4))


def compat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, passing, failing, percentage and errors per project and overall (project null)."""
    g = _results(spark, sf_dir).rollup("project").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("errors") == 0).alias("passing_files"),
        F.count_if(F.col("errors") > 0).alias("failing_files"), F.sum("errors").cast("bigint").alias("total_parse_errors"),
        F.grouping("project").cast("int").alias("overall"))
    return g.withColumn("compatibility_pct", percent(F.col("passing_files"), F.col("total_files")))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last scan of each path wins; one hash aggregate, no sort of whole groups."""
    order = F.struct("scanned_at", "errors", F.coalesce("first_error", F.lit("")))
    return _results(spark, sf_dir).where(F.col("path").isNotNull()).groupBy("path").agg(
        F.max_by(F.struct("project", "errors", "first_error", "scanned_at"), order).alias("r")).select("path", "r.*")


_LATEST = _RESULTS + """, l AS (SELECT * FROM r WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, errors DESC, coalesce(first_error, '') DESC) = 1)"""


def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of every path."""
    return _latest(spark, sf_dir).select("path", "project", "errors", "first_error")


def compat_first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three failing files of each project by path; a bounded top-k a group."""
    w = W.partitionBy("project").orderBy("path")
    return (_latest(spark, sf_dir).where("errors > 0").withColumn("rank", F.row_number().over(w)).where("rank <= 3")
            .select("project", "rank", "path", "errors", "first_error"))


def first_error_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each project by path."""
    return _latest(spark, sf_dir).where("errors > 0 AND first_error IS NOT NULL").groupBy("project").agg(
        F.min_by("first_error", "path").alias("first_error"), F.count("*").alias("failing_files"))


def compat_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the report as JSON text, one row a project."""
    g = _latest(spark, sf_dir).groupBy("project").agg(F.count("*").alias("total"), F.count_if(F.col("errors") > 0).alias("failing"))
    return g.select("project", F.to_json(F.struct("project", "total", "failing")).alias("report"))


def _issues(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "issues", *columns)


_ERROR = "upper(issue_type) = 'ERROR'"


def report_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, K1: errors, warnings and affected lines of each file.

    Affected lines are counted by (file, line) first, so a file that holds a
    tenth of the rows sends one partial row a line and task.
    """
    i = _issues(spark, sf_dir, "filename", "issue_type", "line").where(F.col("filename").isNotNull())
    lines = i.groupBy("filename", "line").agg(F.count_if(F.expr(_ERROR)).alias("e"), F.count("*").alias("n"))
    return lines.groupBy("filename").agg(F.sum("e").alias("errors"), (F.sum("n") - F.sum("e")).alias("warnings"), F.count("line").alias("affected_lines"))


def report_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's totals."""
    return _issues(spark, sf_dir, "issue_type", "filename").agg(
        F.count_if(F.expr(_ERROR)).alias("total_errors"), F.count("*").alias("total_issues"), F.countDistinct("filename").alias("files"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: each issue as a line of the text report; the fixable ones are marked."""
    mark = F.when(F.col("fixable"), "[x] ").otherwise("")
    text = F.format_string("%4d | %-7s | %s%s (%s)", F.coalesce("line", F.lit(0)), F.upper("issue_type"), mark, F.coalesce("message", F.lit("")), F.coalesce("code", F.lit("")))
    return _issues(spark, sf_dir, "issue_id", "filename", "line", "issue_type", "fixable", "message", "code").dropDuplicates(["issue_id"]).select("issue_id", "filename", text.alias("text"))


def issue_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of both tools as one listing; duplicates survive, analysis issues lose their subject."""
    i = _issues(spark, sf_dir, "tool", "filename", "line", "col", "issue_type", "fixable", "message", "code", "subject_kind", "subject_name")
    style = i.where("tool = 'style'").select("filename", "line", "col", F.upper("issue_type").alias("type"), "fixable", "message", "code", "subject_kind", "subject_name")
    null = F.lit(None).cast("string")
    analyse = i.where("tool = 'analyse'").select("filename", "line", "col", F.lit("ERROR").alias("type"), F.lit(False).alias("fixable"), "message", "code",
                                                 null.alias("subject_kind"), null.alias("subject_name"))
    return style.unionByName(analyse)


def issue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues delivered twice count once, in the state loaded last."""
    i = _issues(spark, sf_dir, "issue_id", "tool", "code", "loaded_at")
    return i.groupBy("issue_id").agg(F.max("loaded_at").alias("loaded_at"), F.max("tool").alias("tool"), F.max("code").alias("code"), F.count("*").alias("deliveries"))


DISABLED = ("PHP.VERSION", "PSR12.Files.EndFileNewline", "A.ARG.COUNT")


def issue_disabled_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose code is disabled are dropped; the filter reaches the scan."""
    i = _issues(spark, sf_dir, "tool", "code").where(F.col("code").isNull() | ~F.col("code").isin(*DISABLED))
    return i.groupBy("tool", "code").agg(F.count("*").alias("n"))


#: Level from which a code is checked (F3); codes that are not named belong to level 0.
LEVELS = {"A.PROP.TYPE": 3, "A.RETURN.TYPE": 3, "Generic.CodeAnalysis.UnreachableCode": 4, "A.ARG.TYPE": 5}


def rule_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analysis issues that a project's level admits (a null level admits all)."""
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("code")], F.lit(0))
    i = _issues(spark, sf_dir, "tool", "filename", "code").where("tool = 'analyse' AND filename IS NOT NULL AND code IS NOT NULL")
    i = i.select(F.split("filename", "/")[0].alias("project"), "code", level.alias("level")).groupBy("project", "code", "level").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "projects", "project", "analysis_level")
    return i.join(p, "project").where(F.col("analysis_level").isNull() | (F.col("level") <= F.col("analysis_level"))).groupBy("project").agg(
        F.sum("n").alias("admitted"), F.countDistinct("code").alias("codes"))


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent codes of each tool, ties by code."""
    c = _issues(spark, sf_dir, "tool", "code").where("code IS NOT NULL").groupBy("tool", "code").agg(F.count("*").alias("n"))
    w = W.partitionBy("tool").orderBy(F.desc("n"), "code")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def fix_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is fixed once for each fixable code."""
    i = _issues(spark, sf_dir, "filename", "code", "fixable").where("fixable AND filename IS NOT NULL AND code IS NOT NULL")
    return i.groupBy("filename", "code").agg(F.count("*").alias("issues")).groupBy("filename").agg(F.count("*").alias("fixes"), F.sum("issues").alias("issues"))


OVERRIDES = {"PSR1.Classes.ClassDeclaration.PascalCase": ["/Loader$/", "BatchMapper"], "Custom.Naming.Prefix": ["/^Token/"], "PHPStan.Level0.ClassModel": ["/Proxy|Gateway/"]}


def override_theta_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class issues that no override pattern of their rule suppresses."""
    i = _issues(spark, sf_dir, "issue_id", "code", "subject_kind", "subject_name").dropDuplicates(["issue_id"])
    kept = suppress(i, OVERRIDES)
    return kept.where("subject_kind = 'class'").groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("subject_name").alias("subjects"))


def parse_error_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: issues of files whose last scan found errors are dropped."""
    bad = _latest(spark, sf_dir).where("errors > 0").select(F.col("path").alias("filename"))
    i = _issues(spark, sf_dir, "filename", "code").where("filename IS NOT NULL")
    # A file with a tenth of the rows is one row here.
    per = i.groupBy("filename").agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"))
    return per.join(bad, "filename", "left_anti")


def report_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's weekly percentage with the change from the week before; repeated rows count once."""
    r = table(spark, sf_dir, "project_reports", "project", "generated_at", "total_files", "passing_files").where("project IS NOT NULL").distinct()
    r = r.withColumn("pct", percent(F.col("passing_files"), F.col("total_files")))
    w = W.partitionBy("project").orderBy("generated_at", "total_files", "passing_files")
    return r.select("project", "generated_at", "total_files", "pct", F.round(F.col("pct") - F.lag("pct").over(w), 4).alias("change"))


def sample_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested samples of the reports as rows, how often each path was named."""
    r = table(spark, sf_dir, "project_reports", "project", "sample_failures").where("project IS NOT NULL")
    return r.select("project", F.explode("sample_failures").alias("s")).groupBy("project", F.col("s.path").alias("path")).agg(
        F.count("*").alias("named"), F.max("s.error_count").alias("most_errors"))


QUERIES = {f.__name__: f for f in (
    compat_rollup, latest_scan, compat_first_failures, first_error_per_project, compat_report_json, report_by_file, report_total, report_lines, issue_listing,
    issue_dedupe, issue_disabled_codes, rule_level_filter, top_rules, fix_dedupe, override_theta_anti, parse_error_gate, report_trend, sample_failures)}
_LEVEL_SQL = "CASE code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items()) + " ELSE 0 END"
ORACLE = {
    "compat_rollup": f"""WITH {_RESULTS}
SELECT project, count(*) AS total_files, count(*) FILTER (WHERE errors = 0) AS passing_files,
  count(*) FILTER (WHERE errors > 0) AS failing_files, CAST(sum(errors) AS BIGINT) AS total_parse_errors,
  CAST(grouping(project) AS INTEGER) AS overall, round(count(*) FILTER (WHERE errors = 0) * 100.0 / count(*), 4) AS compatibility_pct
FROM r GROUP BY ROLLUP(project)""",
    "latest_scan": f"WITH {_LATEST} SELECT path, project, errors, first_error FROM l",
    "compat_first_failures": f"""WITH {_LATEST} SELECT project, row_number() OVER (PARTITION BY project ORDER BY path) AS rank, path, errors, first_error
FROM l WHERE errors > 0 QUALIFY rank <= 3""",
    "first_error_per_project": f"WITH {_LATEST} SELECT project, arg_min(first_error, path) AS first_error, count(*) AS failing_files FROM l WHERE errors > 0 AND first_error IS NOT NULL GROUP BY project",
    "compat_report_json": f"""WITH {_LATEST} SELECT project, '{{"project":"' || project || '","total":' || count(*) || ',"failing":' || count(*) FILTER (WHERE errors > 0) || '}}' AS report FROM l GROUP BY project""",
    "report_by_file": f"""SELECT filename, count(*) FILTER (WHERE {_ERROR}) AS errors, count(*) - count(*) FILTER (WHERE {_ERROR}) AS warnings,
  count(DISTINCT line) AS affected_lines FROM issues WHERE filename IS NOT NULL GROUP BY filename""",
    "report_total": f"SELECT count(*) FILTER (WHERE {_ERROR}) AS total_errors, count(*) AS total_issues, count(DISTINCT filename) AS files FROM issues",
    "report_lines": """SELECT DISTINCT issue_id, filename, printf('%4d | %-7s | %s%s (%s)', coalesce(line, 0), upper(issue_type),
  CASE WHEN fixable THEN '[x] ' ELSE '' END, coalesce(message, ''), coalesce(code, '')) AS text FROM issues""",
    "issue_listing": """SELECT filename, line, col, upper(issue_type) AS type, fixable, message, code, subject_kind, subject_name FROM issues WHERE tool = 'style'
UNION ALL SELECT filename, line, col, 'ERROR', FALSE, message, code, NULL, NULL FROM issues WHERE tool = 'analyse'""",
    "issue_dedupe": "SELECT issue_id, max(loaded_at) AS loaded_at, max(tool) AS tool, max(code) AS code, count(*) AS deliveries FROM issues GROUP BY issue_id",
    "issue_disabled_codes": f"SELECT tool, code, count(*) AS n FROM issues WHERE code IS NULL OR code NOT IN {DISABLED} GROUP BY tool, code",
    "rule_level_filter": f"""SELECT project, count(*) AS admitted, count(DISTINCT code) AS codes FROM
(SELECT split_part(filename, '/', 1) AS project, code, {_LEVEL_SQL} AS level FROM issues WHERE tool = 'analyse' AND filename IS NOT NULL AND code IS NOT NULL)
JOIN projects USING (project) WHERE analysis_level IS NULL OR level <= analysis_level GROUP BY project""",
    "top_rules": """SELECT tool, code, count(*) AS n, row_number() OVER (PARTITION BY tool ORDER BY count(*) DESC, code) AS rank FROM issues
WHERE code IS NOT NULL GROUP BY tool, code QUALIFY rank <= 10""",
    "fix_dedupe": "SELECT filename, count(DISTINCT code) AS fixes, count(*) AS issues FROM issues WHERE fixable AND filename IS NOT NULL AND code IS NOT NULL GROUP BY filename",
    "override_theta_anti": """SELECT code, count(*) AS n, count(DISTINCT subject_name) AS subjects FROM (SELECT DISTINCT issue_id, code, subject_kind, subject_name FROM issues)
WHERE subject_kind = 'class' AND NOT coalesce(
  (code = 'PSR1.Classes.ClassDeclaration.PascalCase' AND (regexp_matches(subject_name, 'Loader$') OR subject_name = 'BatchMapper'))
  OR (code = 'Custom.Naming.Prefix' AND regexp_matches(subject_name, '^Token'))
  OR (code = 'PHPStan.Level0.ClassModel' AND regexp_matches(subject_name, 'Proxy|Gateway')), FALSE) GROUP BY code""",
    "parse_error_gate": f"""WITH {_LATEST} SELECT filename, count(*) AS n, count(DISTINCT code) AS codes FROM issues
WHERE filename IS NOT NULL AND filename NOT IN (SELECT path FROM l WHERE errors > 0) GROUP BY filename""",
    "report_trend": """WITH d AS (SELECT DISTINCT project, generated_at, total_files, passing_files FROM project_reports WHERE project IS NOT NULL),
p AS (SELECT *, CASE WHEN total_files = 0 THEN 100.0 ELSE round(passing_files * 100.0 / total_files, 4) END AS pct FROM d)
SELECT project, generated_at, total_files, pct, round(pct - lag(pct) OVER (PARTITION BY project ORDER BY generated_at, total_files, passing_files), 4) AS change FROM p""",
    "sample_failures": """SELECT project, s.path AS path, count(*) AS named, max(s.error_count) AS most_errors
FROM (SELECT project, unnest(sample_failures) AS s FROM project_reports WHERE project IS NOT NULL) GROUP BY project, s.path""",
}
