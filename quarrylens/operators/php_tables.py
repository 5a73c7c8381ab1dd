"""PHP files as tables: tokens, parse errors, syntax nodes and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.lines import contents, is_php
from quarrylens.operators.rowmap import flat_map
from quarrylens.php import facts as php_facts
from quarrylens.php.grammar import first_error
from quarrylens.php.lexer import tokens as lex
from quarrylens.php.parser import locate, parse
from quarrylens.session import spread


def php_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose extension is PHP's, one row each."""
    return contents(spark, sf_dir, is_php())


def tokens(files: DataFrame) -> DataFrame:
    """Every token but white space, with line and column from 1 and character offset."""

    def make():
        def rows(file_id, content):
            at = locate(content)
            seq = 0
            for kind, a, b in lex(content):
                if kind != "ws":
                    line, col = at(a)
                    yield file_id, seq, kind, content[a:b], line, col, a
                    seq += 1

        return rows

    return flat_map(spread(files.select("file_id", "content")), make, "file_id long, seq int, type string, literal string, line int, col int, offset int")


def parse_errors(files: DataFrame) -> DataFrame:
    """The first grammar error of each file that has one."""

    def make():
        def rows(file_id, path, content):
            e = first_error(content)
            if e:
                line, col = locate(content)(e[0])
                yield file_id, path, line, col, e[1]

        return rows

    return flat_map(spread(files.select("file_id", "path", "content")), make, "file_id long, path string, line int, col int, message string")


def nodes(files: DataFrame, bodies: bool = True) -> DataFrame:
    """Syntax nodes; descendants of a node are its ids up to `last`. S10: `bodies` False leaves function bodies out."""

    def make():
        def rows(file_id, content):
            found, error, _ = parse(content, bodies)
            at = locate(content)
            for n in found:
                line, col = at(n[5])
                yield file_id, n[0], None if n[1] < 0 else n[1], n[9], n[2], n[3], n[4], line, col, n[6], n[7], n[8]

        return rows

    return flat_map(spread(files.select("file_id", "content")), make,
                    "file_id long, node_id int, parent_id int, last int, role string, ordinal int, node_type string, line int, col int, name string, value string, attrs string")


def facts(files: DataFrame) -> DataFrame:
    """Declarations, references and local issues of files without grammar errors (F8), with the project of each file."""

    def make():
        def rows(file_id, path, project, content):
            found, error, _ = parse(content)
            return ((*r, project) for r in php_facts.facts(file_id, path, content, found)) if not error else ()

        return rows

    project = F.coalesce("project", F.lit("")) if "project" in files.columns else F.lit("")
    return flat_map(spread(files.select("file_id", "path", project.alias("project"), "content")), make, f"{php_facts.SCHEMA}, project string")


def php_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every kind a file, as counts."""
    return tokens(php_files(spark, sf_dir)).groupBy("file_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("literal")).alias("n_chars"))


def php_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All syntax nodes."""
    return nodes(php_files(spark, sf_dir))


def php_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without their bodies, with the class they belong to (J19: containment by id interval)."""
    n = nodes(php_files(spark, sf_dir), bodies=False)
    fn = n.where("node_type IN ('Function', 'InterfaceMethod') AND name IS NOT NULL")
    owner = n.where("node_type IN ('Class', 'Interface', 'Trait', 'Enum')").select("file_id", F.col("node_id").alias("parent_id"), F.col("name").alias("class_name"))
    return fn.join(owner, ["file_id", "parent_id"], "left").select("file_id", "class_name", "name", F.col("value").alias("return_type"), "attrs", "line")


def parse_report(files: DataFrame) -> DataFrame:
    """Parse results of `files` per project, with the first failure; each file is read and parsed once."""

    def make():
        def rows(file_id, path, project, content):
            e = first_error(content)
            lines = 0 if not content else content.count("\n") + (not content.endswith("\n"))
            if e:
                line, col = locate(content)(e[0])
                yield path, project, lines, f"line {line}:{col}: {e[1]}"
            else:
                yield path, project, lines, None

        return rows

    r = flat_map(spread(files.select("file_id", "path", "project", "content")), make, "path string, project string, lines long, error string")
    g = r.groupBy("project").agg(F.count("*").alias("total_files"), F.count("error").alias("failing_files"), F.sum("lines").cast("bigint").alias("lines"),
                                 F.min_by("path", F.when(F.col("error").isNotNull(), F.col("path"))).alias("first_path"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("path"))).alias("first_error"))
    return g.withColumn("compatibility_pct", F.round(100.0 - 100.0 * F.col("failing_files") / F.col("total_files"), 4))


def php_parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse results of our own per project, with the first failures."""
    return parse_report(php_files(spark, sf_dir).withColumn("project", F.split("path", "/")[0]))


QUERIES = {f.__name__: f for f in (php_tokens, php_nodes, php_signatures, php_parse_report)}
ORACLE: dict[str, str] = {}
