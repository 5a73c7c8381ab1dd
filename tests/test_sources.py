from __future__ import annotations

import pytest

from quarrylens import cli, config
from quarrylens.operators import php_tables, style
from quarrylens.php.style import apply_fixers, check, mask
from quarrylens.sources.files import scan, scan_stream
from quarrylens.streaming.incremental import append_issues, extension_counts


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a/x.php": "<?php\nclass bad_name {\n}\n", "a/vendor/y.php": "<?php\n", "b/z.php": "<?php $a = ;", "b/n.txt": "no", "b/empty.php": ""}.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "src"


def test_scan_prunes_and_reads(spark, tree):
    c = config.Config(str(tree), ("php",), ("vendor",))
    f = scan(spark, c)
    assert {r.path: (r.project, r.content) for r in f.collect()} == {"a/x.php": ("a", "<?php\nclass bad_name {\n}\n"), "b/z.php": ("b", "<?php $a = ;")}
    assert {r.path for r in php_tables.parse_errors(f).collect()} == {"b/z.php"}
    assert "content" not in f.select("path", "n_bytes")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_stream_sees_each_file_once(spark, tree, tmp_path):
    s = scan_stream(spark, config.Config(str(tree), ("php",)))
    for _ in range(2):
        append_issues(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("code = 'PSR1.Classes.ClassDeclaration.PascalCase'").count() == 1
    q = extension_counts(s).writeStream.outputMode("complete").format("memory").queryName("exts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM exts").collect()] == [("php", 3, 5)]


def test_config(tmp_path, capsys):
    (tmp_path / "config.yaml").write_text("path: src\nanalysis_level: 3\nextensions:\n  - php\n  - inc\nignore: [vendor, \".git\"]\nrules:\n  - all\noverrides:\n  Some.Rule:\n    - /^X/\n    - Plain\n")
    assert config.discover(tmp_path) == tmp_path / "config.yaml" and config.discover(tmp_path / "none") is None
    c = config.load(tmp_path / "config.yaml")
    assert c == config.Config("src", ("php", "inc"), ("vendor", ".git"), ("all",), 3, {"Some.Rule": ["/^X/", "Plain"]})
    (tmp_path / "again.yaml").write_text(config.dump(c))
    assert config.load(tmp_path / "again.yaml") == c
    (tmp_path / "bad.yaml").write_text("overrides:\n  A:\n    - /(/\n")
    with pytest.raises(Exception):
        config.load(tmp_path / "bad.yaml")
    assert cli.main(["list-style-rules"]) == 0 and "PascalCase" in capsys.readouterr().out


def test_selection_masks_and_fixers(spark):
    assert style.selected([]) == style.DEFAULTS and style.selected(["all", "x"]) is None and style.selected(["x", "x", "y"]) == ("x", "y")
    text = "<?php\n$a = 'if(x){'; // if(y){\n/* a\n b */ if($a){ f($a,1); }\n"
    assert mask(text).count("\n") == text.count("\n") and len(mask(text)) == len(text) and "y" not in mask(text)
    fixed, done = apply_fixers(text, ["PSR12.ControlStructures.ControlStructureSpacing", "Generic.Functions.FunctionCallArgumentSpacing", "unknown"])
    assert fixed == "<?php\n$a = 'if(x){'; // if(y){\n/* a\n b */ if ($a) { f($a, 1); }\n" and len(done) == 2
    assert apply_fixers(fixed, done) == (fixed, [])
    assert not check(fixed, done)
    f = spark.createDataFrame([(1, "p/a.php", text), (2, "p/b.php", "")], "file_id long, path string, content string")
    found = style.issues(f)
    assert {r.path: r.applied_codes for r in style.fixed_files(f, found).collect()}["p/a.php"] == ["Generic.Functions.FunctionCallArgumentSpacing", "PSR12.ControlStructures.ControlStructureSpacing"]
    report = [r.text for r in style.text_report(found, f).collect()]
    assert report[0].startswith("FILE: p/a.php\n") and "AFFECTING 2 LINES" in report[0] and "[x] " in report[1] and len(report) == 2 + found.count()
    assert style.masked_lines(f).where("file_id = 1").count() == 5
