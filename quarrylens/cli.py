"""Command line: style, analyse, tokens, ast, compat, fix, list-files, list-style-rules, config (2.11, K1-K12)."""

from __future__ import annotations

import argparse
import sys

from quarrylens import config as cfg
from quarrylens.php.style import RULES

COMMANDS = ("style", "analyse", "tokens", "ast", "compat", "fix", "list-files", "list-style-rules", "config")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarrylens")
    p.add_argument("command", nargs="?", default="style", choices=COMMANDS)
    p.add_argument("path", nargs="?")
    p.add_argument("-c", "--config")
    p.add_argument("-o", "--output", help="folder for the result; without it the text goes to the screen")
    p.add_argument("--rules", help="codes between commas, or all")
    p.add_argument("--level", type=int)
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    found = a.config or cfg.discover(".")
    c = cfg.load(found) if found else cfg.Config()
    root = a.path or c.path
    if a.command == "list-style-rules":
        print("\n".join(sorted(RULES)))
        return 0
    if a.command == "config":
        print(cfg.dump(c), end="")
        return 0
    from quarrylens.operators import level0, php_tables, style
    from quarrylens.operators.overrides import suppress
    from quarrylens.session import build_session
    from quarrylens.sources.files import scan

    spark = build_session("quarrylens", a.master, **{"spark.ui.showConsoleProgress": "false"})
    files = scan(spark, c, root)
    rules = a.rules.split(",") if a.rules else c.rules
    level = a.level if a.level is not None else c.analysis_level
    if a.command == "list-files":
        out = files.select("path").orderBy("path")
    elif a.command == "tokens":
        out = php_tables.tokens(files).join(files.select("file_id", "path"), "file_id").select("path", "seq", "type", "literal", "line", "col").orderBy("path", "seq")
    elif a.command == "ast":
        out = php_tables.nodes(files).join(files.select("file_id", "path"), "file_id").orderBy("path", "node_id")
    elif a.command == "compat":
        out = php_tables.parse_report(files).orderBy("project")
    elif a.command == "analyse":
        out = level0.analyse(files.drop("project"), level)  # one tree is one project
    elif a.command == "fix":
        out = style.fixed_files(files, style.issues(files, rules))
    else:
        out = style.text_report(suppress(style.issues(files, rules), c.overrides), files)
    if a.output:
        (out.write.mode("errorifexists").json if a.command not in ("style",) else out.select("text").write.mode("errorifexists").text)(a.output)
    else:
        headings = 0
        for r in out.toLocalIterator():
            print(r["text"] if "text" in out.columns else "\t".join(str(v) for v in r))
            headings += a.command == "style" and r["line"] < 0
        if a.command == "style":
            print(f"{headings} files with issues")
    return 0


if __name__ == "__main__":
    sys.exit(main())
