from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import quarrylens.plans.catalogue as catalogue
from quarrylens.php.grammar import first_error
from quarrylens.php.lexer import tokens
from tests.conftest import plain


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    theirs = sorted(repr(tuple(plain(v) for v in r)) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(name, spark, sf_dir):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_llm_subpackage_is_optional():
    """Nothing outside llm imports it, but the entry point where it can."""
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quarrylens.llm" not in p.read_text(), p


def _php(sf_dir):
    rows = {}
    for r in duckdb.sql(f"SELECT file_id, path, content, level, case_id FROM '{sf_dir}/php_files.parquet' WHERE content IS NOT NULL AND regexp_matches(lower(path), '\\.(php|inc|phtml)$')").fetchall():
        rows[r[0]] = r[1:]
    return rows


def test_tokens_and_parse_report_against_brute_force(spark, sf_dir):
    """Whole tables through Spark against plain loops over the same files."""
    want, failing, total = Counter(), Counter(), Counter()
    for i, (path, content, _, _) in _php(sf_dir).items():
        for kind, _, _ in tokens(content):
            if kind != "ws":
                want[i, kind] += 1
        total[path.split("/")[0]] += 1
        failing[path.split("/")[0]] += first_error(content) is not None
    assert {(r.file_id, r.type): r.n for r in catalogue.QUERIES["php_tokens"](spark, sf_dir).collect()} == dict(want)
    got = {r.project: (r.total_files, r.failing_files) for r in catalogue.QUERIES["php_parse_report"](spark, sf_dir).collect()}
    assert got == {p: (n, failing[p]) for p, n in total.items()} and sum(failing.values()) > 0


def test_fixed_files_still_parse(spark, sf_dir):
    from quarrylens.operators import style
    from quarrylens.operators.php_tables import php_files

    files = php_files(spark, sf_dir)
    fixed = style.fixed_files(files, style.issues(files))
    before = {i: first_error(c) is None for i, (_, c, _, _) in _php(sf_dir).items()}
    rows = fixed.select("file_id", "content").collect()
    assert rows and all(first_error(r.content) is None for r in rows if before[r.file_id])


def test_files_at_their_levels(spark, make_tables):
    from quarrylens.operators import level0

    d = make_tables(php_files=("file_id long, case_id string, level int", [(1, "p", 0), (1, "p", None), (2, "p", None), (3, "q", None), (4, None, 5)]),
                    projects=("project string, analysis_level int", [("p", 3), ("p", 3), ("q", None), (None, 1)]))
    levels = level0.file_levels(spark, d)
    assert {r.file_id: r.level for r in levels.collect()} == {1: 0, 2: 3, 3: None, 4: 5}
    found = spark.createDataFrame([(i, c) for i in (1, 2, 3, 4, 9) for c in (level0.SYMBOLS, "A.RETURN.TYPE", "A.ARG.TYPE", "Other")], "file_id long, code string")
    kept = {i: {r.code for r in level0.at_levels(found, levels).where(f"file_id = {i}").collect()} for i in (1, 2, 3, 4, 9)}
    assert [len(kept[i]) for i in (1, 2, 3, 4, 9)] == [2, 3, 4, 4, 4] and "A.RETURN.TYPE" not in kept[1] and "A.ARG.TYPE" not in kept[2]
