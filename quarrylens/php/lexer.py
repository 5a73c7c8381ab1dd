"""PHP tokenizer (S7): one compiled pattern per lexer mode, tokens as tuples.

`tokens(text)` gives (kind, start, end) triples. Kinds are: `inline` (text
outside tags), `open`, `open_echo`, `close`, `ws`, `comment`, `doc`, `var`,
`id`, `qid` (name with a backslash), `num`, `str` (single quoted), `dq` (double
quoted), `heredoc`, `cast`, `attr` (the two characters that open an attribute),
lower-case keywords, and operators as themselves. Text that is no PHP token
ends the list with one `bad` token that reaches to the end.
"""

from __future__ import annotations

import re

#: Reserved words of the language (fixed values).
KEYWORDS = frozenset(
    """abstract and array as break callable case catch class clone const continue declare default do echo else elseif
    empty enddeclare endfor endforeach endif endswitch endwhile eval exit extends final finally fn for foreach function
    global goto if implements include include_once instanceof insteadof interface isset list match namespace new or
    print private protected public readonly require require_once return static switch throw trait try unset use var
    while xor yield die __halt_compiler enum""".split()
)
_ID = r"[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*"
_LINE = r"[^\r\n?]*(?:\?(?!>)[^\r\n?]*)*"
_PHP = re.compile(
    rf"""(?P<ws>[ \t\r\n]+)
|(?P<variable>\${_ID})
|(?P<word>{_ID})(?P<qid>(?:\\{_ID})+)?
|(?P<rooted>\\{_ID}(?:\\{_ID})*)
|(?P<doc>/\*\*(?=[ \t\r\n])[^*]*(?:\*(?!/)[^*]*)*\*/)
|(?P<comment>(?://|\#(?!\[)){_LINE}|/\*[^*]*(?:\*(?!/)[^*]*)*\*/)
|(?P<open_comment>/\*)
|(?P<str>[bB]?'[^'\\]*(?:\\.[^'\\]*)*')
|(?P<dq>[bB]?"[^"\\]*(?:\\.[^"\\]*)*")
|(?P<shell>`[^`\\]*(?:\\.[^`\\]*)*`)
|(?P<num>0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[bB][01]+(?:_[01]+)*|0[oO][0-7]+(?:_[0-7]+)*
   |(?:[0-9]+(?:_[0-9]+)*)?\.[0-9]+(?:_[0-9]+)*(?:[eE][+-]?[0-9]+)?|[0-9]+(?:_[0-9]+)*\.?(?:[eE][+-]?[0-9]+)?)
|(?P<heredoc><<<[ \t]*(?:"(?P<l1>{_ID})"|'(?P<l2>{_ID})'|(?P<l3>{_ID}))\r?\n)
|(?P<cast>\([ \t]*(?i:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)[ \t]*\))
|(?P<close>\?>(?:\r?\n)?)
|(?P<attr>\#\[)
|(?P<op><=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|&&|\|\||\?\?|\+\+|--|->|=>|::|==|!=|<>|<=|>=|<<|>>|[-+*/%.&|^]=|\*\*|[-+*/%=<>!.,;:?()\[\]{{}}&|^~@$\\])
""",
    re.X | re.S,
)
_OPEN = re.compile(r"<\?(?:php(?=[ \t\r\n]|\Z)|=)", re.I)
_INTERPOLATION = re.compile(r"\{\$|\$\{")


def _double_quoted_end(text: str, i: int) -> int:
    """End of the double-quoted string that starts at i, or -1; code inside {$...} may hold quotes."""
    n = len(text)
    i += 1
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == '"':
            return i + 1
        elif c in "{$" and text[i : i + 2] in ("{$", "${"):
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                elif c in "'\"":
                    m = re.compile(rf"{c}[^{c}\\]*(?:\\.[^{c}\\]*)*{c}", re.S).match(text, i)
                    if not m:
                        return -1
                    i = m.end() - 1
                i += 1
        else:
            i += 1
    return -1


def heredoc_end(text: str, label: str, start: int) -> int:
    """Place just after the closing label of a heredoc whose body starts at `start`, or -1."""
    m = re.compile(rf"^[ \t]*{re.escape(label)}(?![0-9A-Za-z_\x80-\U0010ffff])", re.M).search(text, start)
    return m.end() if m else -1


def tokens(text: str) -> list[tuple[str, int, int]]:
    """The whole text as tokens; see the module's docstring. An empty text has none."""
    out: list[tuple[str, int, int]] = []
    i, n = 0, len(text)
    if text.startswith("\ufeff"):
        i = 1
    while 0 <= i < n:
        m = _OPEN.search(text, i)
        if not m:
            out.append(("inline", i, n))
            return out
        if m.start() > i:
            out.append(("inline", i, m.start()))
        out.append(("open_echo" if m.group() == "<?=" else "open", m.start(), m.end()))
        i = _code(text, m.end(), out.append)
    return out


def _code(text: str, i: int, add) -> int:
    """Adds the tokens of code from i on; gives the place behind the closing tag, or -1 where nothing more is read."""
    n = len(text)
    while i < n:
        for m in _PHP.finditer(text, i):
            if m.start() != i:
                add(("bad", i, n))
                return -1
            kind, j = m.lastgroup, m.end()
            if kind == "word":
                kind = m.group()
                if kind not in KEYWORDS:
                    kind = kind.lower()
                    if kind not in KEYWORDS:
                        kind = "id"
            elif kind == "op":
                kind = m.group()
            elif kind == "dq":
                if _INTERPOLATION.search(text, i, j):
                    j = _double_quoted_end(text, text.index('"', i))
            elif kind == "heredoc" or kind in ("l1", "l2", "l3"):
                kind = "heredoc"
                j = heredoc_end(text, m["l1"] or m["l2"] or m["l3"], j)
            elif kind == "open_comment":
                j = -1
            elif kind == "shell":
                kind = "dq"
            elif kind == "rooted":
                kind = "qid"
            if j < 0:
                add(("bad", i, n))
                return -1
            add((kind, i, j))
            i = j
            if kind == "close":
                return i
            if kind == "__halt_compiler":
                return -1
            if j != m.end():  # the token ends elsewhere, so the scan starts again behind it
                break
        else:
            if i < n:
                add(("bad", i, n))
            return -1
    return -1


def line_of(starts: list[int], offset: int) -> int:
    """1-based line of a character offset; `starts` as of line_starts()."""
    from bisect import bisect_right

    return bisect_right(starts, offset)


def line_starts(text: str) -> list[int]:
    """Offsets at which lines start; lines end at a line feed only."""
    return [0, *(m.end() for m in re.finditer("\n", text))]
