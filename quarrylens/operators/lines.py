"""Files as lines, and style rules that need nothing but neighbouring lines.

A line ends at a line feed; the empty text has no lines. All of it is native
SQL: lines come from posexplode, neighbours from windows over one file, so the
partition of a window is a file and never grows with the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrylens.sources.tables import table


def is_php(path: str = "path") -> Column:
    """Whether a path's extension is PHP's."""
    return F.lower(path).rlike(r"\.(php|inc|phtml)$")


def contents(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """(file_id, path, content, project): one row a file that has content; `only` takes files out before their text is shuffled."""
    df = table(spark, sf_dir, "php_files", "file_id", "path", "content", F.col("case_id").alias("project")).where(F.col("content").isNotNull())
    return (df if only is None else df.where(only)).dropDuplicates(["file_id"])


def lines(files: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key..., line_no, text) of every line; line_no counts from 1."""
    split = F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text")
    keep = [c for c in files.columns if c != text]
    return files.where(F.col(text) != "").select(*keep, split).select(*keep, (F.col("pos") + 1).alias("line_no"), "text")


def line_count(text: Column) -> Column:
    """A4: line feeds, and one more for a last line without one."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def issue(df: DataFrame, code: str, message: str, column: Column | None = None, fixable: bool = False) -> DataFrame:
    """Rows of the issue table from rows with file_id and line_no."""
    return df.select("file_id", F.col("line_no").cast("int").alias("line"), (F.lit(1) if column is None else column).cast("int").alias("col"),
                     F.lit("ERROR").alias("type"), F.lit(fixable).alias("fixable"), F.lit(message).alias("message"), F.lit(code).alias("code"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, duplicates too."""
    return reduce(DataFrame.unionByName, frames)


def end_file_newline(files: DataFrame) -> DataFrame:
    """The content is empty or does not end in a line feed; reported at line 0."""
    bad = files.where((F.col("content") == "") | ~F.endswith(F.col("content"), F.lit("\n")))
    return issue(bad.withColumn("line_no", F.lit(0)), "PSR12.Files.EndFileNewline", "File must end with a newline", fixable=True)


def trailing_whitespace(all_lines: DataFrame) -> DataFrame:
    """Space or tab as the last character of a line; a carriage return hides it. The column is in bytes."""
    bad = all_lines.where(F.col("text").rlike(r"[ \t]\z"))
    return issue(bad, "PSR12.Files.EndFileNoTrailingWhitespace", "Trailing whitespace", F.octet_length("text"), True)


def space_before_semicolon(all_lines: DataFrame) -> DataFrame:
    """Every semicolon after a space or tab, but in lines that are comments."""
    code = all_lines.where(F.col("text").rlike(r"[ \t];") & ~F.ltrim(F.regexp_replace("text", "^[ \t]+", "")).rlike(r"^(//|#)"))
    hits = code.withColumn("hit", F.explode(F.regexp_extract_all("text", F.lit(r"[ \t];"), F.lit(0))))
    return issue(hits, "PSR12.Files.NoSpaceBeforeSemicolon", "Space before semicolon")


def blank_line_after_open(all_lines: DataFrame) -> DataFrame:
    """The line after the first line that is exactly the open tag must be empty."""
    w = W.partitionBy("file_id").orderBy("line_no")
    seen = all_lines.withColumn("next", F.lead("text").over(w)).where("text = '<?php'")
    first = seen.groupBy("file_id").agg((F.min("line_no") + 1).alias("line_no"), F.min_by(F.coalesce("next", F.lit("")), "line_no").alias("next"))
    return issue(first.where(F.col("next") != ""), "PSR12.Files.MissingBlankLineAfterPHPOpeningTag", "Missing blank line after open tag", fixable=True)


def class_brace(all_lines: DataFrame) -> DataFrame:
    """The brace of a class stands on the next line."""
    t = F.regexp_replace("text", r"^[ \t]+|[ \t\r]+\z", "")
    w = W.partitionBy("file_id").orderBy("line_no")
    seen = all_lines.withColumn("t", t).withColumn("next", F.lead("t").over(w)).where(F.col("t").rlike("^(class|interface|trait|enum) "))
    same = F.contains(F.col("t"), F.lit("{"))
    bad = seen.where(same | (~same & F.col("next").isNotNull() & (F.col("next") != "{")))
    bad = bad.withColumn("line_no", F.when(same, F.col("line_no")).otherwise(F.col("line_no") + 1))
    return issue(bad, "PSR12.Classes.OpenBraceOnOwnLine", "Opening brace of a class must be on its own line", fixable=True)


def else_if(all_lines: DataFrame) -> DataFrame:
    """`else if` in two words; lines with a quote are left out."""
    bad = all_lines.where(F.col("text").rlike(r"\belse[ \t]+if\b") & ~F.col("text").rlike("['\"]"))
    return issue(bad, "PSR12.ControlStructures.ElseIfDeclaration", "Use elseif", F.regexp_instr("text", F.lit(r"\belse[ \t]+if\b")), True)


def native_style(files: DataFrame) -> DataFrame:
    """All native style rules as one issue table; every rule is a branch over the same lines."""
    all_lines = lines(files.select("file_id", "content"))
    return union_all([end_file_newline(files), trailing_whitespace(all_lines), space_before_semicolon(all_lines), blank_line_after_open(all_lines),
                      class_brace(all_lines), else_if(all_lines)])


def style_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.8: the native rules over all PHP files."""
    files = contents(spark, sf_dir, is_php())
    return native_style(files)


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with extension, size and lines."""
    t = F.col("content")
    return contents(spark, sf_dir).select("file_id", "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"),
                                          F.octet_length(t).cast("bigint").alias("n_bytes"), line_count(t).cast("bigint").alias("n_lines"))


def line_count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: totals of the corpus."""
    t = F.col("content")
    return contents(spark, sf_dir).agg(F.count("*").alias("files"), F.sum(line_count(t)).cast("bigint").alias("lines"), F.sum(F.octet_length(t)).cast("bigint").alias("bytes"))


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every line of every file."""
    return lines(contents(spark, sf_dir).select("file_id", "content")).select("file_id", "line_no", F.length("text").alias("n_chars"))


def line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later occurrences of a line that is not blank, within a file."""
    ls = lines(contents(spark, sf_dir).select("file_id", "content")).where(F.trim(F.regexp_replace("text", r"\s+", "")) != "")
    w = W.partitionBy("file_id", "text").orderBy("line_no")
    return ls.withColumn("nth", F.row_number().over(w)).where("nth > 1").groupBy("file_id").agg(F.count("*").alias("repeats"), F.max("nth").cast("bigint").alias("most"))


def doc_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that an earlier document has already, with the owner.

    Texts meet by a 256-bit hash, so the shuffle moves hashes and ids only.
    """
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    owners = d.groupBy("h").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("h", "owner")
    return d.join(owners, "h").where("doc_id <> owner").select("doc_id", "owner")


def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a project's configuration scans: extension listed, no directory ignored."""
    f = table(spark, sf_dir, "php_files", "file_id", "case_id", "path").distinct()
    p = table(spark, sf_dir, "projects", "project", "extensions", "ignore_dirs")
    f = f.withColumn("ext", F.regexp_extract("path", r"\.([^./]+)$", 1)).withColumn("dirs", F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/"))
    f = f.join(p, f.case_id == p.project).where(F.array_contains("extensions", F.col("ext")) & ~F.arrays_overlap("dirs", F.coalesce("ignore_dirs", F.array().cast("array<string>"))))
    return f.select("file_id", "project", "path")


def placeholder_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printf placeholders a line, doubled percent signs apart."""
    ls = lines(contents(spark, sf_dir).select("file_id", "content")).where(F.contains(F.col("text"), F.lit("sprintf(")))
    n = F.regexp_count(F.replace("text", F.lit("%%"), F.lit("")), F.lit("%"))
    return ls.groupBy("file_id").agg(F.count("*").alias("calls"), F.sum(n).cast("bigint").alias("placeholders"))


_CONTENTS = "c AS (SELECT DISTINCT file_id, path, content FROM php_files WHERE content IS NOT NULL)"
_LINES = _CONTENTS + """, l AS (SELECT file_id, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM c WHERE content <> '')"""
_COUNT = "CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN right(content, 1) = chr(10) THEN 0 ELSE 1 END END"
_T = "regexp_replace(regexp_replace(text, '^[ \\t]+', ''), '[ \\t\\r]+$', '')"
QUERIES = {f.__name__: f for f in (style_native, file_inventory, line_count_total, line_explode, line_duplicates, doc_duplicates, ignore_filter, placeholder_count)}
ORACLE = {
    "style_native": f"""WITH {_LINES}, x AS (SELECT * FROM l WHERE regexp_matches(lower(path), '\\.(php|inc|phtml)$')),
w AS (SELECT *, {_T} AS t, lead(text) OVER (PARTITION BY file_id ORDER BY line_no) AS nxt FROM x),
b AS (SELECT *, lead(t) OVER (PARTITION BY file_id ORDER BY line_no) AS nt FROM w),
o AS (SELECT * FROM w WHERE text = '<?php' QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) = 1),
i AS (
SELECT file_id, 0 AS line, 1 AS col, TRUE AS fixable, 'File must end with a newline' AS message, 'PSR12.Files.EndFileNewline' AS code FROM c
  WHERE regexp_matches(lower(path), '\\.(php|inc|phtml)$') AND (content = '' OR right(content, 1) <> chr(10))
UNION ALL SELECT file_id, line_no, octet_length(encode(text)), TRUE, 'Trailing whitespace', 'PSR12.Files.EndFileNoTrailingWhitespace' FROM x WHERE right(text, 1) IN (' ', chr(9))
UNION ALL SELECT file_id, line_no, 1, FALSE, 'Space before semicolon', 'PSR12.Files.NoSpaceBeforeSemicolon' FROM
  (SELECT file_id, line_no, unnest(regexp_extract_all(text, '[ \\t];')) FROM x WHERE NOT regexp_matches(text, '^[ \\t]*(//|#)'))
UNION ALL SELECT file_id, line_no + 1, 1, TRUE, 'Missing blank line after open tag', 'PSR12.Files.MissingBlankLineAfterPHPOpeningTag' FROM o WHERE nxt <> ''
UNION ALL SELECT file_id, CASE WHEN contains(t, '{{') THEN line_no ELSE line_no + 1 END, 1, TRUE, 'Opening brace of a class must be on its own line', 'PSR12.Classes.OpenBraceOnOwnLine'
  FROM b WHERE regexp_matches(t, '^(class|interface|trait|enum) ') AND (contains(t, '{{') OR (nt IS NOT NULL AND nt <> '{{'))
UNION ALL SELECT file_id, line_no, strpos(text, regexp_extract(text, '\\belse[ \\t]+if\\b')), TRUE, 'Use elseif', 'PSR12.ControlStructures.ElseIfDeclaration'
  FROM x WHERE regexp_matches(text, '\\belse[ \\t]+if\\b') AND NOT regexp_matches(text, '[''"]'))
SELECT file_id, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, 'ERROR' AS type, fixable, message, code FROM i""",
    "file_inventory": f"WITH {_CONTENTS} SELECT file_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, CAST(octet_length(encode(content)) AS BIGINT) AS n_bytes, CAST({_COUNT} AS BIGINT) AS n_lines FROM c",
    "line_count_total": f"WITH {_CONTENTS} SELECT count(*) AS files, CAST(sum({_COUNT}) AS BIGINT) AS lines, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM c",
    "line_explode": f"WITH {_LINES} SELECT file_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(text) AS INTEGER) AS n_chars FROM l",
    "line_duplicates": f"""WITH {_LINES}, d AS (SELECT file_id, row_number() OVER (PARTITION BY file_id, text ORDER BY line_no) AS nth FROM l WHERE trim(regexp_replace(text, '\\s+', '', 'g')) <> '')
SELECT file_id, count(*) AS repeats, max(nth) AS most FROM d WHERE nth > 1 GROUP BY file_id""",
    "doc_duplicates": "SELECT doc_id, owner FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner FROM documents WHERE text IS NOT NULL) WHERE doc_id <> owner",
    "ignore_filter": """WITH f AS (SELECT DISTINCT file_id, case_id, path FROM php_files)
SELECT file_id, project, path FROM f JOIN projects ON case_id = project WHERE list_contains(extensions, regexp_extract(path, '\\.([^./]+)$', 1))
AND NOT list_has_any(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), coalesce(ignore_dirs, []))""",
    "placeholder_count": f"""WITH {_LINES} SELECT file_id, count(*) AS calls, CAST(sum(length(replace(text, '%%', '')) - length(replace(replace(text, '%%', ''), '%', ''))) AS BIGINT) AS placeholders
FROM l WHERE contains(text, 'sprintf(') GROUP BY file_id""",
}
