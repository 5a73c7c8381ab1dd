"""Problem 7."""

from __future__ import annotations

from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import parse_check as pc
from quarrylens.llm.data_grammars import json_parses, sql_parses, yaml_parses
from quarrylens.llm.js_grammar import parses as js_parses

YAML_GOOD = ["a: 1\nb:\n  - x\n  - y: 2\n    z: 3\nc: {a: 1, b: [2,3]}\n", "- a\n- b:\n    c\n- - x\n  - y\n", "a:\n- b\n- c\nd: |\n  text: x\n  more\ne: >-\n  x\nf: 'it''s'\n",
             "{\n  \"a\": 1,\n  \"b\": [1,\n 2]\n}\n", "# c\n", "", "a: &x\n  b: 1\nc: *x\nd: !!str 1\n", "plain text\nover lines\n", "---\na: 1\n---\nb: 2\n...\n", "a: b\n  continued here\nc: d\n",
             "? a\n: b\n", "key: http://x.y/z:1\n", "'quoted': \"a\\\"b\" # c\n", "a:\n  b:\n    c\n\n  d:\n    e: f\n"]
YAML_BAD = ["a: b: c\n", "a: [1, 2\nb: 3\n", "a: \"open\nb: 1\n", "a:\n\tb: 1\n", "a: 1\n  b: 2\n", "a:\n    b: 1\n  c: 2\n", "- a\nb: 1\n", "a: 1\n- b\n", "- : x: y: z\n",
            "<<<<<<< HEAD\na: 1\n=======\na: 2\n>>>>>>> side\n", "a: 1\n<<<<<<< HEAD\nb: 2\n", "<?php\nnamespace A;\nfunction f(): int\n{\n}\n", "a: @x\n", "a: }\n"]
JS_GOOD = ["", "'use strict';\nconst f = async (a, {b = 1, ...c}) => { for await (const x of y) { yield_(x) } }\n", "class A extends B { static #x = 1; get y() { return `a${b}c` } async *z() {} static { } }",
           "import a, {b as c} from 'x'; export default function () {} export * as q from 'z'\n", "let r = /[/]x/g.test(s) ? a / b / c : {a, 'b': 1, [c]: 2, d() {}}\na\n++b", "!function(){for(var t=0,n=e.length;t<n;t++)if(e[t]>7)return e[t];return-0}();", "x?.y?.[0]?.(1); a ??= b; l: for (;;) { break l }", "if (a) b\nelse c\ndo x(); while (1) y()"]
JS_BAD = ["function (", "const = 1;", "a b", "{", "x = ;", "<?php echo 1;", "for (;;", "<<<<<<< HEAD\na();", "'open", "/* open", "return }", "function f() { if (a) { }", "const a;"]


@pytest.mark.parametrize("text", YAML_GOOD)
def test_yaml(text):
    assert yaml_parses(text)


@pytest.mark.parametrize("text", YAML_BAD)
def test_not_yaml(text):
    assert not yaml_parses(text)


@pytest.mark.parametrize("text", JS_GOOD)
def test_js(text):
    assert js_parses(text)


@pytest.mark.parametrize("text", JS_BAD)
def test_not_js(text):
    assert not js_parses(text)


def test_json_and_sql():
    assert json_parses('﻿{"a": [1, 2.5e3, null]}') and not json_parses("{'a': 1}") and not json_parses('{"a": 1,}') and not json_parses("") and not json_parses("NaN")
    assert sql_parses("-- c\nINSERT INTO t (a, b) VALUES (1, 'x''y'), (2, NULL);\nSELECT * FROM t") and sql_parses("")
    assert not sql_parses("INSERT INTO t (a VALUES (1);") and not sql_parses("INSERT INTO t VALUES (1,);") and not sql_parses("hello world") and not sql_parses("SELECT a FROM")


PIECES = ["<?php\n", "$a = [1, (2)];\n", "if ($x) {\n", "}\n", "'str\n ing';\n", "/* c\n } */\n", "<<<EOT\n { \nEOT;\n", "?>\nhtml {\n<?php\n", "// } \n", "\"a\n{$b}\";\n", "f(\n", ");\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12), st.integers(1, 40))
def test_chunk_maps_reduce_to_the_whole(parts, size):
    text = "<?php\n" + "".join(parts)
    cut = pc.chunks(text, size)
    assert "".join(cut) == text
    maps = [pc.chunk_map(c, ("EOT",)) for c in cut]
    whole = pc.chunk_map(text, ("EOT",))
    left = reduce(pc.combine, maps)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = pc.combine(m, right)
    assert left == right
    assert left["html"] == whole["html"]
    assert pc.balanced(text, size) == pc.balanced(text, 1 << 20)


def test_found_with_nulls_empties_rescans_and_clashing_columns(spark, file_tables):
    rows = [(1, "p", "p/a.php", "<?php $a = 1;"), (2, "p", "p/b.PHP", "<?php $a = ;"), (2, "p", "p/b.PHP", None), (3, "p", "p/c.json", ""), (4, "p", "p/d.yml", ""), (5, "p", "p/e.php", ""), (6, "p", "p/f.txt", "{{{"),
            (7, None, "p/g.js", "var a = 1"), (8, "p", "p/h.lock", "{}"), (9, "p", "p/i.php", None), (2, "p", "p/b.PHP", "<?php $a = ;"), (10, "p", "p/k.php", "<?php\n" + "$a = [1, 2];\n" * 9000), (11, "p", "p/l.php", "<?php\n" + "$a = [1, 2];\n" * 9000 + "{")]
    assert sorted(r.file_id for r in pc.found(spark, file_tables(rows)).collect()) == [2, 3, 5, 11]
    assert pc.found(spark, file_tables([])).count() == 0


HALT = "<?php\n" + "$a = [1, 2];\n" * 9000 + "__halt_compiler();\n" + "data } ) {\n" * 20
SPLIT = [("php", "<?php\n$a = \"x\n{$b[\"k\n\"]}\n\";\n$c = <<<EOT\n } \nEOT;\n/* ( \n */ f(\n1\n);\n?>\nhtml {\n<?= 1 ?>\n", True), ("php", "<?php\nf([\n1\n)];\n", False), ("php", "<?php\n__halt_compiler();\n} ' \n", True),
         ("js", "#!x\nlet a = `t\n${b + `u\n${'}'}`}\n`\n/* { \n */ f(\n/[(]/)\nvar s = 'q\\\nr'\nx = {a}\n/'b\n", False), ("js", "let a = `t\n${b + `u\n${'}'}`}\n`\n/* { \n */ f(\n/[(]/)\nvar s = 'q\\\nr'\nreturn_\n", True), ("js", "a = 1\n#!x\n", False),
         ("json", '{"a": [\n"}",\n1\n]}\n', True), ("json", '{"a": [\n1\n}]\n', False), ("sql", "/* ( \n*/ INSERT INTO t (a,\nb) VALUES ('it''s\n)', 2);\n-- (\nSELECT 1;\n", True), ("sql", "SELECT (\n1;\n", False), ("sql", "SELECT a /* (\n", False)]


@pytest.mark.parametrize("lang,text,good", SPLIT)
@pytest.mark.parametrize("size", [1, 12, 1 << 20])
def test_every_language_by_its_maps(lang, text, good, size):
    assert (pc.first_failure(lang, text, size) is None) == good


def test_files_of_usual_length_are_reduced(monkeypatch):
    assert pc.first_failure("php", HALT) is None
    joined = []
    monkeypatch.setattr(pc, "combine", lambda a, b, f=pc.combine: joined.append(1) or f(a, b))
    for lang, text in (("php", "<?php\n" + "$a = [1];\n" * 400), ("js", "a = [1];\n" * 400), ("json", "[\n" + "1,\n" * 900 + "1]"), ("sql", "SELECT (1);\n" * 400)):
        joined.clear()
        assert pc.first_failure(lang, text) is None and joined, lang


def test_long_files_are_cut_over_partitions(spark, file_tables):
    """Five megabytes of PHP in segments that any task may read, with strings, comments and heredocs over their edges."""
    block = "<?php\n$a = [1, f(2)];\n$b = 'it\n) }';\n/* {\n ( */\n$c = <<<EOT\n } {$a[\"k\n\"]} (\nEOT;\nif ($x) {\n  g(\n1);\n}\n?>\ntext {\n"
    long = block * (5_000_000 // len(block))
    rows = [(1, "p", "p/a.php", long), (2, "p", "p/b.php", long + "<?php }\n"), (3, "p", "p/c.php", long + "<?php f(1 2);\n"), (4, "p", "p/d.php", "<?php f();"), (2, "p", "p/b.php", long + "<?php }\n"), (5, "p", "p/e.php", long + "<?php 'open\n")]
    got = {r.file_id: (r.stage, r.failure) for r in pc.parse_results(spark, file_tables(rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: "maps", 3: "statements", 4: None, 5: "maps"}


def test_segments_of_any_size_agree(spark, file_tables):
    rows = [(i, "p", f"p/{i}.{lang}", text) for i, (lang, text, _) in enumerate(SPLIT)]
    for segment in (1, 30):
        got = {r.file_id: r.failure is None for r in pc.parse_results(spark, file_tables(rows), segment).collect()}
        assert got == {i: good for i, (_, _, good) in enumerate(SPLIT)}


@pytest.mark.parametrize("lang,text", [("php", "<?php $a = " + "[" * 5000 + "]" * 5000 + ";"), ("js", "a = " + "[" * 5000 + "]" * 5000), ("json", "[" * 50_000 + "]" * 50_000), ("yml", "a: " + "[" * 500 + "]" * 500)])
def test_no_depth_is_too_deep(lang, text):
    assert pc.first_failure(lang, text) is None
    assert pc.first_failure(lang, text.replace("]", "", 1)) is not None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["[", "]", "{", "}", ",", ":", '"a"', "1", "-0.5e3", "01", "null", "nul", " ", "\n", '"\\u12"', '"\\n"', "\"a\nb\""]), max_size=9))
def test_json_agrees_with_the_standard_library(parts):
    import json

    text = "".join(parts)
    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    assert json_parses(text) == good and (pc.first_failure("json", text, 1) is None) == good
