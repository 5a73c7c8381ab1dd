"""Problems 1, 4, 5 and 10 on small fixtures."""

from __future__ import annotations

import pytest

from quarrylens.llm import language, licenses, pairs, truncation

REFS = [("MIT", "MIT License", "Whoever holds a copy of this work may run it, change it and hand it on, provided that this paragraph travels along."),
        ("Apache-2.0", "Apache License 2.0", "Use and redistribution are granted together with any patent rights needed to do so; changed files must say that they were changed."),
        ("GPL-3.0-only", "GNU General Public License v3.0 only", "Pass this program on only under the third edition of these public terms, source included; no other edition applies."),
        ("GPL-3.0-or-later", "GNU General Public License v3.0 or later", "Pass this program on under the third edition of these public terms or, if you prefer, any edition that follows it, source included."),
        ("BSD-3-Clause", "BSD 3-Clause License", "Source and binary copies are welcome on three terms: keep the line, repeat it, and never advertise with the names of the authors."), ("Proprietary", "Proprietary", "Confidential work of its owner. Passing it on needs a signed agreement.")]
EN = "The parser keeps all pending orders when the queue is empty and this rule sorts the remaining rows before the report is written"
DE = "Der Import sortiert die leeren Spalten und die Warteschlange prüft alle offenen Aufträge bevor der Bericht erscheint"
ZH = "解析器在不改动原文件的情况下检查旧的条目并且拒绝自己的状态"
CODE = "<?php\n// $this->send($result, true);\n// The parser keeps all pending orders\n$sql = 'SELECT id, label FROM rows WHERE a = ? ORDER BY id';\n$m = 'Der Import prüft die leeren Spalten';\n/**\n * The rule sorts the remaining rows. {@see X}\n * @param int $a Der Import sortiert die leeren Spalten\n */\nfunction f($a) {}\n/* 解析器检查旧的条目 */\n$t = <<<EOT\n// The parser keeps all pending orders\nEOT;\n# Copyright (c) 2020 Some Company Name Here\n"


def test_natural_language_in_code(spark, file_tables):
    docs = [(i, EN, "en", "s") for i in range(5)] + [(10 + i, DE, "DE", "s") for i in range(5)] + [(20 + i, ZH, "zh", "s") for i in range(5)] + [(30, None, "en", "s"), (31, "x", None, "s"), (32, "", "xx", None)]
    rows = [(1, "p", "p/a.php", CODE), (1, "p", "p/a.php", None), (2, "p", "p/b.yml", "# The parser keeps all pending orders\na: 1\n"), (3, "p", "p/c.js", ""), (4, "p", "p/d.php", None), (1, "p", "p/a.php", CODE)]
    d = file_tables(rows, docs=docs)
    got = {(r.file_id, r.line): r["lang"] for r in language.found(spark, d).collect()}
    assert got == {(1, 3): "en", (1, 5): "de", (1, 6): "en", (1, 11): "zh", (2, 1): "en"}
    shares = {(r.file_id, r["lang"]): r.share for r in language.shares(spark, d).collect()}
    assert shares[2, "en"] == pytest.approx(37 / 43, abs=0.01)
    assert language.found(spark, file_tables([], docs=docs)).count() == 0


def test_wrongly_decoded_letters_are_read_again():
    assert language.repair("archivÃ©s prÃ¼ft") == "archivés prüft" and language.repair("plain é") == "plain é"


def test_licenses(spark, file_tables):
    h = "<?php\n/*\n * {}\n */\nnamespace A;\nclass B {{}}\n// MIT License\n".format
    files = [
        ("mit", h("SPDX-License-Identifier: mit"), "MIT", "no"), ("choice", h("SPDX-License-Identifier: MIT OR Apache-2.0"), "Apache-2.0 OR MIT", "no"),
        ("both", h("SPDX-License-Identifier: MIT\n * It is covered by the New BSD; see there."), "BSD-3-Clause AND MIT", "yes"), ("none", h("Nothing here about mit einem Wort."), "MIT", "no"),
        ("points", h("See the license shipped with this project."), "MIT", "no"), ("other", h("Distributed under the Harbour Terms as agreed."), "UNKNOWN", "no"),
        ("gpl", h("Released under the GPLv3 or later."), "GPL-3.0-or-later", "yes"), ("gplonly", h("GNU GPL version 3"), "GPL-3.0-only", "yes"),
        ("notice", h(REFS[1][2].upper().replace(" TOGETHER", "\n * together") + ", and no more than that"), "Apache-2.0", "yes"), ("typo", h(REFS[2][2].replace("edition of", "editoin of")), "GPL-3.0-only", "yes"),
        ("plus", h("It is covered by the GPL-3.0+; see there."), "GPL-3.0-or-later", "yes"), ("prose", h("Written at Apache 2.0 speed, not licensed under the GPL version 3."), "MIT", "no"),
        ("word", h("This proprietary protocol parser reads frames."), "MIT", "no"), ("title", h("Apache License 2.0\n *\n * Copyright 2020 A"), "Apache-2.0", "yes"),
        ("null", None, "MIT", "no"), ("empty", "", "MIT", "no"), ("pick", h("You may choose between the MIT License and the Apache License 2.0, whichever suits you."), "Apache-2.0 OR MIT", "no")]
    rows = [(i, "p", f"p/{n}.php", c) for i, (n, c, _, _) in enumerate(files)] + [(99, "q", "q/x.php", h("SPDX-License-Identifier: MIT")), (98, "u", "u/x.php", "<?php\n"), (0, "p", "p/mit.php", None)]
    repo = [("p", "p/LICENSE", REFS[0][2]), ("p", "p/LICENSE", REFS[0][2]), ("p", "p/README.md", None), ("q", "q/composer.json", '{"license": ["GPL-3.0-only", "Apache-2.0"]}'), (None, "z/LICENSE", "MIT License"),
            ("c", "c/LICENSE", REFS[0][2]), ("c", "c/composer.json", '{"license": "apache-2.0"}')]
    d = file_tables(rows, repo=repo, refs=REFS, projects=[(p, []) for p in "pquc"])
    got = {(r.scope, r.subject): (r.license_id, r.conflict) for r in licenses.found(spark, d).collect()}
    assert {n: got["file", f"p/{n}.php"] for n, *_ in files} == {n: (i, c) for n, _, i, c in files}
    assert got["file", "q/x.php"] == ("MIT", "yes") and got["file", "u/x.php"] == ("UNKNOWN", "no")
    assert [got["repo", p] for p in "pquc"] == [("MIT", "no"), ("Apache-2.0 OR GPL-3.0-only", "no"), ("UNKNOWN", "no"), ("Apache-2.0 AND MIT", "yes")]
    evidence = {r.path: r for r in licenses.evidence(spark, d).collect()}
    assert evidence["p/typo.php"].coverage == 1.0 and "editoin" in evidence["p/typo.php"].altered


def test_pairs(spark, file_tables):
    text = ("<?php\n/** Keeps all the pending orders. */\nfunction a($x) { return '} /** no */ function z() {'; }\nclass C {\n    /**\n     * Gets the shared row.\n     */\n    function getSharedRow() {}\n"
            "    /**\n     * 解析器检查旧的条目\n     * @param int $a the first one\n     */\n    #[Route('/x', ['GET'])]\n    final public static function &c(int $a): ?int { /* } */ return fn() => 1; }\n    /** {@inheritdoc} */ function d() {}\n"
            "    /** The rule sorts remaining rows. */\n    private $x;\n    function e() {}\n}\n$t = <<<'X'\n/** Demo of a sample block. */\nfunction sample() {}\nX;\ninterface I {\n    /** The rule sorts remaining rows */\n\n    public function m();\n}\n")
    d = file_tables([(1, "p", "p/a.php", text), (1, "p", "p/a.php", text), (2, "p", "p/b.js", "/** The rule sorts remaining rows */\nfunction a() {}"), (3, "p", "p/c.php", None), (4, "p", "p/d.php", "")])
    assert sorted((r.file_id, r.line, r.func_name) for r in pairs.found(spark, d).collect()) == [(1, 3, "a"), (1, 14, "c"), (1, 27, "m")]
    full = {r.func_name: r for r in pairs.pairs(spark, d).collect()}
    assert full["c"].description == "解析器检查旧的条目" and [tuple(p) for p in full["c"].params] == [("$a", "int", "the first one")]
    assert full["a"].code.endswith("function z() {'; }") and full["m"].code.endswith("();")


def test_truncation(spark, make_tables):
    pad = lambda s, n, mark: s[: n - len(mark)] + mark
    long = "The parser keeps all pending orders when the queue is empty. " * 9
    rows = [(1, "The parser keeps all orders.", "a"), (2, "The parser keeps all ord", "a"), (3, None, "a"), (4, "  ", "a"), (5, "", None), (6, "One sentence. And (an open bra", None), (7, "Done.\n\n```php\n$a = 1;\n", "a"),
            (8, "Done.\n\n```php\n$a = 1;\n```", "a"), (9, "A sentence with a broken \ufffd", "a"), (10, "It is done.\n\n-- \nthe tools team", "a"), (11, "It is done.\n\n-- \nthe to", "a"), (12, "Fix row sorter", "c"), (13, "Short complete sentence…", "m"), (14, "See (v2.", "a")]
    rows += [(100 + i, "It is done.\n\n-- \nthe tools team", "a") for i in range(6)] + [(200 + i, pad(long, 120, "…"), "m") for i in range(5)] + [(300 + i, f"Add thing number {i}\n\nThe rule sorts the rows.", "c") for i in range(4)]
    d = make_tables(documents=("doc_id long, text string, source string, how string, n_chars string", [(*r, "x", "y") for r in rows]))
    assert sorted(r.doc_id for r in truncation.found(spark, d).collect()) == [2, 6, 7, 9, 11, 14, 200, 201, 202, 203, 204]
    rates = {r.source: (r.texts, r.truncated) for r in truncation.rates(spark, d).collect()}
    assert rates["m"] == (6, 5) and rates["c"] == (5, 0) and rates[None] == (1, 1)
    assert truncation.found(spark, make_tables(documents=("doc_id long, text string, source string", []))).count() == 0


def test_the_stack_reads_whole_texts(spark, make_tables):
    """What stays open anywhere is evidence, unless the source's terminated texts leave it open too."""
    open_ = {'He said "this is the end.': ['"'], "We (first sentence. Second sentence.": ["("], "An unclosed <b>tag here.": ["<b>"], "Run `a (b` and “c.": ["“"], "„Ja“, «no», »doch« (b) 1) <br> <i>x</i> \\( it's.": [],
             "A\n```\n( \" <b>\n```\nDone.": [], "A\n```\nx": ["fence"], "(a [b) c.": [], "Say `x": ["`"], "「はい。": ["「"]}
    for text, want in open_.items():
        assert truncation.left_open(text) == want, text
    rows = [(i, t, "a") for i, t in enumerate(open_)] + [(100 + i, "All is done here.", "a") for i in range(20)] + [(200 + i, f"Measure {i} is 5\" wide.", "inch") for i in range(9)]
    rows += [(300 + i, f"first thing. and thing {i}", "plain") for i in range(9)] + [(400, "A whole text. It ends.", "plain"), (401, "No end. Of text", ""), (402, "Whole.", "")]
    long = "The parser keeps all pending orders when the queue is empty. " * 9
    rows += [(500 + i, long[:119] + "…", "m") for i in range(6)] + [(510, long, "m"), (511, "So it goes…", "m"), (600, "Done. " + "x" * 5000 + "\n\n-- \n" + "long " * 30 + "name", "s"), (601, "a\n\n-- \n" + "long " * 30 + "na", "s")]
    rows += [(610 + i, "a\n\n-- \n" + "long " * 30 + "name", "s") for i in range(4)]
    d = make_tables(documents=("doc_id long, text string, source string", rows))
    got = {r.doc_id: r.reason for r in truncation.judged(truncation._docs(spark, d)).collect() if r.truncated}
    assert got == {**{i: "open" for i, w in enumerate(open_.values()) if w}, 401: "terminator", 601: "signature", **{500 + i: "limit" for i in range(6)}}


def test_unclosed_functions_take_linear_time():
    """A megabyte of functions that never close is read in seconds, each still found; masking changes nothing else."""
    import time

    body = '/** Adds the two given values together. */\nfunction f%d(int $a) { if ($a) { $b = "x}"; } /* { */ foo($a);\n'
    for unit in (body, '/** Adds the two given values together. */\nfunction f%d(int $a \n'):
        text = "<?php\n" + "".join(unit % i for i in range(1_000_000 // len(unit)))
        t = time.perf_counter()
        got = list(pairs.functions(text))
        assert time.perf_counter() - t < 20 and [x[1] for x in got] == [f"f{i}" for i in range(1_000_000 // len(unit))]
        assert not any(x[4] for x in got)
    closed = "/** Adds the two given values together. */\nfunction a() { return 1; }\n"
    got = list(pairs.functions("<?php\n" + closed + body % 0 + closed.replace(" a(", " b(")))
    assert [(x[1], x[4]) for x in got] == [("a", "{ return 1; }"), ("f0", None), ("b", "{ return 1; }")]
    assert pairs.mask_unclosed("f(a { ( ) '(' }") == "f\x01a { ( ) '(' }"
