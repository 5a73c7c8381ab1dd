"""Problem 5: functions paired with their documentation.

One recursive pattern takes comment, signature and balanced body together;
strings, other comments and heredocs are alternatives of the same scan, so code
inside them is never taken for code. The body is looked at, not consumed: named
functions inside it are found too. A function of a broken file whose body never
closes is paired without body; from the first such one on, brackets that never
close are masked by one scan, so none of them is followed to the end again and
a file takes time in proportion to its length (times the depth of functions
that lie in each other).

Pairs with an empty or trivial description are dropped: fewer than three words
that are not in the function's name split at case changes, in Chinese and
Japanese fewer than six characters. Null content and files of other languages
give no row; a file with several rows counts once.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.scan import comment_lines
from quarrylens.llm.sources import files, language, once
from quarrylens.operators.rowmap import flat_map
from quarrylens.php.lexer import line_of, line_starts

_ID = r"[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*"
#: A line feed within a string, but not before a line that reads as code: there a quote was left open.
_FEED = r"\n(?!\s*(?:\}|\$\w+\s*=|(?:public|private|protected|final|abstract|static|function|return|foreach|if|throw)\b))"
_TEXT = rf"""'[^'\\\n]*+(?:(?:\\.|{_FEED})[^'\\\n]*+)*+'|"[^"\\\n]*+(?:(?:\\.|{_FEED})[^"\\\n]*+)*+"|`[^`\n]*+`"""
_COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|(?://|\#(?!\[))[^\r\n?]*+(?:\?(?!>)[^\r\n?]*+)*+"
_HEREDOC = rf"(?<!<)<<<[ \t]*(?:\"(?P<q>{_ID})\"|'(?P<q>{_ID})'|(?P<q>{_ID}))\r?\n(?:(?![ \t]*(?P=q)\b)[^\n]*+\n)*+(?:[ \t]*(?P=q)\b|[^\n]*+\Z)"
_SCAN = regex.compile(
    rf"""
(?P<doc>/\*\*(?=\s)[^*]*+(?:\*(?!/)[^*]*+)*+\*/)
(?:\s++|(?P<attribute>\#\[(?:[^\[\]'"]++|{_TEXT}|(?P<brackets>\[(?:[^\[\]'"]++|{_TEXT}|(?&brackets))*+\]))*+\])|\b(?:public|protected|private|static|abstract|final|readonly)\b)*+
\b(?P<word>function)\b(?:\s++|&)++(?P<name>{_ID})\s*+
(?=(?P<signature>(?P<parens>\((?:[^()'"/\#`]++|{_TEXT}|{_COMMENT}|[/\#]|(?&parens))*+\))\s*+(?::\s*+[^{{;\x01]*+)?)
   (?P<body>\{{(?:[^{{}}'"/\#`<]++|{_TEXT}|{_COMMENT}|{_HEREDOC}|[/\#<]|(?&body))*+\}}|;)?|)
|{_COMMENT}|{_TEXT}|{_HEREDOC}|\?>(?:(?!<\?(?:php\b|=)).)*+
""",
    regex.X | regex.S,
)
_BRACKETS = regex.compile(rf"(?P<bracket>[(){{}}])|{_COMMENT}|{_TEXT}|{_HEREDOC}", regex.S)
_PARAM = re.compile(r"@param\s+(?:(?P<type>[^\s$]+)\s+)?(?:&|\.\.\.)*(?P<name>\$\w+)?[ \t]*(?P<text>.*)", re.S)
_INLINE = re.compile(r"\{@[^}]*\}", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿々ー]")
_CASE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z\x80-\U0010ffff]+|\d+")


def description(doc: str) -> str:
    """Text of a PHPDoc before its first tag, inline tags taken out."""
    out = []
    for x in comment_lines("doc", doc):
        if x.startswith("@"):
            break
        out.append(x)
    return " ".join(_INLINE.sub(" ", "\n".join(out)).split())


def params(doc: str) -> list[tuple[str | None, str | None, str]]:
    """(name, type, description) of each @param, with its further lines."""
    tags: list[list[str]] = []
    for x in comment_lines("doc", doc):
        if x.startswith("@"):
            tags.append([x])
        elif tags:
            tags[-1].append(x)
    out = []
    for t in tags:
        m = _PARAM.match("\n".join(t))
        if m:
            out.append((m["name"], m["type"], " ".join(m["text"].split())))
    return out


def trivial(text: str, name: str) -> bool:
    """Whether a description says nothing beyond the function's name."""
    if len(_CJK.findall(text)) >= 6:
        return False
    own = {w.lower() for w in _CASE.findall(name)}
    return sum(1 for w in _WORD.findall(text) if w.lower() not in own and not _CJK.match(w)) < 3


def functions(content: str):
    """(offset of `function`, name, PHPDoc, signature, body or None) of each documented named function."""
    start = re.search(r"<\?(?:php\b|=)", content, re.I)
    if not start:
        return
    at, text, masked = start.start(), content, False
    closed = content.rfind("*/") + 2
    if "/*" in content[closed:]:  # comments that never close
        text = content[:closed] + content[closed:].replace("/*", "/\x01")
    while at >= 0:
        scan, at = _SCAN.finditer(text, at), -1
        for m in scan:
            if not m["name"]:
                continue
            yield m.start("word"), m["name"], m["doc"], m["signature"], m["body"]
            if not masked and not m["body"]:
                text, masked, at = mask_unclosed(text, start.start()), True, m.end()
                break


def mask_unclosed(text: str, start: int = 0) -> str:
    """`text` with each round or curly bracket that never closes replaced, lengths kept."""
    stacks: dict[str, list[int]] = {"(": [], "{": []}
    for m in _BRACKETS.finditer(text, start):
        c = m["bracket"]
        if c in stacks:
            stacks[c].append(m.start())
        elif c and stacks["(" if c == ")" else "{"]:
            stacks["(" if c == ")" else "{"].pop()
    out, i = [], 0
    for at in sorted(stacks["("] + stacks["{"]):
        out += (text[i:at], "\x01")
        i = at + 1
    return "".join((*out, text[i:]))


def _pairs(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    def make():
        def rows(file_id, path, content):
            starts = None
            if language(path) != "php":
                return
            for at, name, doc, signature, body in functions(content):
                text = description(doc)
                if trivial(text, name):
                    continue
                starts = starts or line_starts(content)
                row = file_id, line_of(starts, at), name
                yield (*row, text, params(doc), f"function {name}{signature or ''}{body or ''}") if full else row

        return rows

    schema = "file_id long, line int, func_name string"
    if full:
        schema += ", description string, params array<struct<name: string, type: string, description: string>>, code string"
    # A documented function needs a doc comment and the word, so other files are filtered out in the scan's stage.
    src = files(spark, sf_dir, "file_id", "path", "content").where(F.col("content").contains("/**") & F.col("content").contains("function"))
    return once(flat_map(src, make, schema))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, False)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-description pairs with parameters."""
    return _pairs(spark, sf_dir, True)
