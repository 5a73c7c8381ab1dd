"""What the operators on source files share: the rows to read and the language of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import spread
from quarrylens.sources.tables import table

#: Language of each extension, letter case aside (fixed values).
LANGUAGES = {"php": "php", "inc": "php", "phtml": "php", "js": "js", "json": "json", "lock": "json", "yml": "yml", "yaml": "yml", "sql": "sql"}


def language(path: str | None) -> str | None:
    """Language that the extension of `path` names, or None."""
    if not path:
        return None
    base = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


def language_column(path):
    """The same as a column expression."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def files(spark: SparkSession, sf_dir: str, *columns: str, spreading: bool = True) -> DataFrame:
    """Rows of php_files that have content, pruned to `columns`, in enough partitions for Python work.

    Rows of a file that was scanned again are still there: the functions behind
    are pure, so equal contents give equal rows and `once` drops the rest. That
    way no content is shuffled.
    """
    df = table(spark, sf_dir, "php_files").select(*columns).where(F.col("content").isNotNull())
    return spread(df) if spreading else df


def once(df: DataFrame) -> DataFrame:
    """Equal rows once (a file with several rows counts once)."""
    return df.distinct()
