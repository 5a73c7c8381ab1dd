from __future__ import annotations

import random

from quarrylens.operators import skew
from quarrylens.operators.asof import nearest_before
from quarrylens.operators.hierarchy import closure, nearest
from quarrylens.operators.overrides import normalise, suppress

ISSUES = "tool string, code string, filename string, line int"


def test_closure_of_a_cycle_and_a_chain(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("p", "q"), ("q", "r"), ("r", "s"), ("p", "s"), ("p", None)]
    df = spark.createDataFrame(edges, "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in closure(df, "child", "parent").collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2,
                   ("p", "q"): 1, ("p", "r"): 2, ("p", "s"): 1, ("q", "r"): 1, ("q", "s"): 2, ("r", "s"): 1}


def test_closure_of_random_graphs_against_breadth_first_search(spark):
    rng = random.Random(11)
    edges = [(g, f"{g}-{rng.randrange(14)}", f"{g}-{rng.randrange(14)}") for g in range(12) for _ in range(rng.choice([8, 14, 22]))]
    want = {}
    out = {}
    for _, a, b in edges:
        out.setdefault(a, set()).add(b)
    for start in out:
        level, seen, depth = {start}, {start}, 0
        while level:
            depth += 1
            level = {b for a in level for b in out.get(a, ())} - seen
            seen |= level
            want.update({(start, b): depth for b in level})
    got = closure(spark.createDataFrame([(a, b) for _, a, b in edges], "c string, p string"), "c", "p")
    assert {(r.node, r.ancestor): r.depth for r in got.collect()} == want


def test_nearest_takes_the_least_distance(spark):
    pairs = closure(spark.createDataFrame([(4, 3), (3, 2), (2, 1)], "c int, p int"), "c", "p")
    got = {r.node: r.ancestor for r in nearest(pairs, spark.createDataFrame([(1,), (2,)], "id int"), "id").collect()}
    assert got == {4: 2, 3: 2, 2: 1}


def test_nearest_before_against_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.choice("abc"), rng.randrange(30), i) for i in range(60)]
    right = list({(k, p): (k, p, f"{k}{p}") for k, p in ((rng.choice("abz"), rng.randrange(30)) for _ in range(25))}.values())
    got = nearest_before(spark.createDataFrame(left, "k string, pos int, id int"), spark.createDataFrame(right, "k string, pos int, name string"), "k", "pos", "name")
    want = {i: max(((p, n) for kk, p, n in right if kk == k and p <= pos), default=(0, None))[1] for k, pos, i in left}
    assert {r.id: r["name"] for r in got.collect()} == want


def test_heavy_keys_with_nulls_ties_and_other_tools(spark, make_tables):
    rows = [("style", "A", "f", 1)] * 4 + [("style", None, "g", None)] * 92 + [("style", "B", None, 2)] * 4 + [("analyse", "A", "f", 1), (None, "A", "f", 1), ("odd", "A", "f", 1)]
    d = make_tables(issues=(ISSUES, rows))
    got = {(r.field_name, r.key_text) for r in skew.found(spark, d).collect()}
    assert got == {("style_code", "A"), ("style_code", "B"), ("style_filename", "f"), ("style_filename", "g"), ("analysis_code", "A"), ("analysis_filename", "f")}
    counts = {(r.field_name, r.key_text): (r.n_rows, r.distinct_lines) for r in skew.counts(spark, d).collect()}
    assert counts["style_filename", "g"] == (92, 0) and counts["style_code", "A"] == (4, 1)


def test_heavy_keys_of_an_empty_table(spark, make_tables):
    d = make_tables(issues=(ISSUES + ", field string, heavy int", []))
    assert skew.found(spark, d).count() == 0 and skew.counts(spark, d).count() == 0


def test_patterns_and_suppression(spark):
    assert normalise("Foo.Bar") == r"^Foo\.Bar$" and normalise("/^X/") == "^X" and normalise(" ") is None and normalise("//") is None
    rows = [(1, "C", "class", "OldXService"), (2, "C", "class", "Other"), (3, "C", "function", "OldXx"), (4, "D", "class", "OldXy"), (5, "C", None, None)]
    df = spark.createDataFrame(rows, "id int, code string, subject_kind string, subject_name string")
    assert sorted(r.id for r in suppress(df, {"C": ["/^Old[A-Z]/", ""]}).collect()) == [2, 3, 4, 5]
