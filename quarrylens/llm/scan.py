"""Comments and quoted strings of source text in any of the known languages, also where it does not parse.

`pieces(lang, text)` gives (kind, start, end): `line` (// # --), `block`,
`doc` (PHPDoc and its like), `html` (<!-- -->), `sq` and `dq` strings. Heredocs
and code lie between them. Where a quote or comment has no end, one character
is skipped and the scan goes on behind it.
"""

from __future__ import annotations

import re

from quarrylens.php.lexer import heredoc_end

_ID = r"[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*"
_SQ, _DQ = r"'[^'\\]*(?:\\.[^'\\]*)*'", r'"[^"\\]*(?:\\.[^"\\]*)*"'
_BLOCK = r"/\*[^*]*(?:\*(?!/)[^*]*)*\*/"
_PHP = re.compile(
    rf"(?P<doc>/\*\*(?=\s){_BLOCK[3:]})|(?P<block>{_BLOCK})|(?P<line>(?://|\#(?!\[))[^\r\n?]*(?:\?(?!>)[^\r\n?]*)*)"
    rf"|(?P<sq>{_SQ})|(?P<dq>{_DQ})|(?P<tick>`[^`]*`)|<<<[ \t]*(?:\"(?P<l1>{_ID})\"|'(?P<l2>{_ID})'|(?P<l3>{_ID}))\r?\n|(?P<close>\?>)",
    re.S,
)
_HTML = re.compile(r"(?P<html><!--.*?-->)|(?P<open><\?(?:php(?=\s|\Z)|=))", re.S | re.I)
_JS = re.compile(
    rf"(?P<doc>/\*\*(?=\s){_BLOCK[3:]})|(?P<block>{_BLOCK})|(?P<line>//[^\r\n]*)|(?P<sq>'[^'\\\r\n]*(?:\\.[^'\\\r\n]*)*')|(?P<dq>\"[^\"\\\r\n]*(?:\\.[^\"\\\r\n]*)*\")"
    r"|(?P<tick>`[^`\\]*(?:\\.[^`\\]*)*`)|(?P<regex>(?<=[=(,:!&|?{};\n])[ \t]*/(?![*/])(?:[^\\/\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/)",
    re.S,
)
_SQL = re.compile(rf"(?P<line>--[^\r\n]*|^[ \t]*\#[^\r\n]*)|(?P<block>{_BLOCK})|(?P<sq>'[^'\\]*(?:(?:\\.|'')[^'\\]*)*')|(?P<dq>\"[^\"]*\")", re.S | re.M)
_YML = re.compile(r"(?P<line>(?:^|(?<=\s))\#[^\r\n]*)|(?P<sq>(?<=[\s:,\[{(-])'[^'\r\n]*(?:''[^'\r\n]*)*')|(?P<dq>(?<=[\s:,\[{(-])\"[^\"\\\r\n]*(?:\\.[^\"\\\r\n]*)*\")", re.M)
_JSON = re.compile(r"(?P<dq>\"[^\"\\\r\n]*(?:\\.[^\"\\\r\n]*)*\")|(?P<sq>'[^'\\\r\n]*(?:\\.[^'\\\r\n]*)*')|(?P<line>//[^\r\n]*)")
_PLAIN = {"js": _JS, "sql": _SQL, "yml": _YML, "json": _JSON}
_COMMENTS = frozenset(("line", "block", "doc", "html"))
#: A string is taken for a stray quote where it runs over a statement's end and more code.
_STRAY = re.compile(r"[;{]\s*\n\s*(?:\$\w+|return|\}|public|private|protected|final|function|if|foreach)")

Piece = tuple[str, int, int]


def pieces(lang: str | None, text: str) -> list[Piece]:
    """See the module's docstring; an unknown language has none."""
    if lang == "php":
        return _php(text)
    pattern = _PLAIN.get(lang)
    if pattern is None:
        return []
    return [(m.lastgroup, m.start(), m.end()) for m in pattern.finditer(text) if m.lastgroup not in ("tick", "regex")]


def _php(text: str) -> list[Piece]:
    out: list[Piece] = []
    i, n = 0, len(text)
    php = False
    while i < n:
        m = (_PHP if php else _HTML).search(text, i)
        if not m:
            break
        kind, i = m.lastgroup, m.end()
        if kind == "open":
            php = True
        elif kind == "close":
            php = False
        elif kind in ("l1", "l2", "l3"):
            end = heredoc_end(text, m["l1"] or m["l2"] or m["l3"], i)
            i = end if end >= 0 else m.start() + 3
        elif kind in ("sq", "dq", "tick") and "\n" in m.group() and _STRAY.search(m.group()):
            i = m.start() + 1
        elif kind == "block" and "\n" in m.group() and re.search(r"\n\s*/\*|;\s*\n\s*\$\w+ =", m.group()):
            i = m.start() + 2
        elif kind != "tick":
            out.append((kind, m.start(), i))
    if php:  # a comment that the end of the text cut off
        m = re.compile(r"/\*(?:(?!\*/).)*\Z", re.S).search(text, out[-1][2] if out else 0)
        if m and all(x.strip().startswith("*") for x in m.group().split("\n")[1:]):
            out = [x for x in out if x[2] <= m.start()]
            out.append(("doc" if re.match(r"/\*\*\s", m.group()) else "block", m.start(), n))
    return out


def is_comment(kind: str) -> bool:
    return kind in _COMMENTS


_LEAD = re.compile(r"^[ \t]*(?:/\*+!?|\*+/?|//+|\#+|--+|<!--)?[ \t]*")


def comment_lines(kind: str, raw: str) -> list[str]:
    """Lines of a comment without its marks."""
    body = raw
    if kind in ("block", "doc"):
        body = re.sub(r"^/\*+!?", "", body)
        body = re.sub(r"\**\*/$", "", body)
        return [re.sub(r"^[ \t]*\*+[ \t]?", "", x).strip() for x in body.split("\n")]
    if kind == "html":
        return [x.strip() for x in body[4:-3].split("\n")]
    return [re.sub(r"^(?://+|\#+|--+)", "", body).strip()]


_ESC = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def string_value(lang: str | None, raw: str) -> str:
    """What a quoted string says, near enough for reading it."""
    q, body = raw[0], raw[1:-1]
    if lang in ("sql", "yml") and q == "'":
        return body.replace("''", "'")
    if "\\" not in body:
        return body
    if lang == "php" and q == "'":
        return re.sub(r"\\(['\\])", r"\1", body)

    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "uU" and len(c) > 1:
            return chr(int(c.strip("u{}"), 16))
        return _ESC.get(c, c)

    return re.sub(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|.)", one, body, flags=re.S)
