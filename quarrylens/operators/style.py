"""Style issues, reports and fixes over tables of files (2.8, K1-K7, A14, F2, F8)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.lines import native_style
from quarrylens.operators.php_tables import php_files
from quarrylens.operators.rowmap import flat_map
from quarrylens.php import style
from quarrylens.session import spread

SCHEMA = "file_id long, line int, col int, type string, fixable boolean, message string, code string, subject_kind string, subject_name string"
#: Rules that run where none are named (F2).
DEFAULTS = ("PSR1.Classes.ClassDeclaration.PascalCase", "PSR12.Classes.OpenBraceOnOwnLine", "PSR12.ControlStructures.ElseIfDeclaration", "PSR12.Files.EndFileNewline",
            "PSR12.Files.EndFileNoTrailingWhitespace", "PSR12.Files.NoSpaceBeforeSemicolon")


def selected(rules: Iterable[str] | None) -> tuple[str, ...] | None:
    """none named gives the defaults, `all` everything (None), unknown codes nothing."""
    rules = list(rules or ())
    if not rules:
        return DEFAULTS
    return None if "all" in rules else tuple(dict.fromkeys(rules))


def issues(files: DataFrame, rules: Iterable[str] | None = ("all",)) -> DataFrame:
    """Issues of the native and of the token rules; only chosen branches are built."""
    codes = selected(rules)
    python = [c for c in style.RULES if codes is None or c in codes]

    def make():
        def rows(file_id, content):
            for line, col, message, fixable, kind, name, code in style.check(content, python):
                yield file_id, line, col, "ERROR", fixable, message, code, kind, name

        return rows

    out = flat_map(spread(files.select("file_id", "content")), make, SCHEMA) if python else None
    native = native_style(files)
    if codes is not None:
        native = native.where(F.col("code").isin(*codes))
    null = F.lit(None).cast("string")
    native = native.withColumns({"subject_kind": null, "subject_name": null})
    return native.unionByName(out) if out is not None else native


def masked_lines(files: DataFrame) -> DataFrame:
    """lines with what is no code blanked."""
    def make():
        return lambda file_id, content: ((file_id, n, t) for n, t in enumerate(style.mask(content).split("\n"), 1)) if content else ()

    return flat_map(spread(files.select("file_id", "content")), make, "file_id long, line_no int, code_only string")


def fixed_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, path, content, applied_codes) of files that fixers change; inputs are never overwritten."""
    codes = found.where("fixable").groupBy("file_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))

    def make():
        def rows(file_id, path, content, wanted):
            fresh, done = style.apply_fixers(content, wanted)
            if done:
                yield file_id, path, fresh, done

        return rows

    return flat_map(files.select("file_id", "path", "content").join(codes, "file_id"), make, "file_id long, path string, content string, applied_codes array<string>")


def text_report(found: DataFrame, files: DataFrame) -> DataFrame:
    """K1: the report as (path, seq, text) in order: heading and counts of each file, then its issues by line and column.

    Nothing is collected by file: the rows are sorted by range over path and
    place, so a file with a tenth of all issues spreads over several tasks.
    """
    i = found.join(files.select("file_id", "path"), "file_id")
    lines = i.groupBy("path", "line").agg(F.count_if(F.col("type") == "ERROR").alias("e"), F.count("*").alias("n"))
    g = lines.groupBy("path").agg(F.sum("e").alias("e"), (F.sum("n") - F.sum("e")).alias("w"), F.count("line").alias("l"))
    head = F.concat(F.lit("FILE: "), "path", F.lit("\n" + "-" * 80 + "\n"), F.format_string("FOUND %d ERRORS AND %d WARNING%s AFFECTING %d LINE%s\n", "e", "w", F.when(F.col("w") == 1, "").otherwise("S"), "l", F.when(F.col("l") == 1, "").otherwise("S")),
                    F.lit("-" * 80))
    row = F.format_string("%4d | %-7s | %s%s\n     |         | (%s)", "line", "type", F.when(F.col("fixable"), "[x] ").otherwise(""), "message", "code")
    heads = g.select("path", F.lit(-1).alias("line"), F.lit(0).alias("col"), F.lit("").alias("code"), head.alias("text"))
    return heads.unionByName(i.select("path", "line", "col", "code", row.alias("text"))).orderBy("path", "line", "col", "code", "text")


def style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.8: issues per code over all PHP files."""
    return issues(php_files(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


def style_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 over all PHP files."""
    f = php_files(spark, sf_dir)
    return text_report(issues(f), f)


def fix_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: what the fixers change, as hashes."""
    f = php_files(spark, sf_dir)
    return fixed_files(f, issues(f)).select("file_id", F.md5("content").alias("md5"), F.array_join("applied_codes", ",").alias("codes"))


QUERIES = {f.__name__: f for f in (style_rules, style_report, fix_apply)}
ORACLE: dict[str, str] = {}
