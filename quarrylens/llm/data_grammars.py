"""Local grammars for JSON, YAML and SQL (problem 7)."""

from __future__ import annotations

import re

from quarrylens.php.grammar import Bad as BracketError
from quarrylens.php.grammar import allow_depth, brackets


# ---------------------------------------------------------------- YAML
class _Bad(Exception):
    pass


_DQ = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_SQ = re.compile(r"'(?:[^']|'')*'", re.S)
_PROPS = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)+")
_BLOCK = re.compile(r"[|>][0-9+-]*[ \t]*(?:#.*)?$")


class _Yaml:
    """A line-wise reader of block structure; flow collections and scalars are checked where they stand."""

    def __init__(self, text: str):
        self.lines = [x.rstrip("\r") for x in text.removeprefix("﻿").split("\n")]
        self.n = 0

    def parse(self) -> None:
        #: Open collections as [column, kind]; kind is "map" or "seq".
        stack: list[list] = []
        pending = -1  # column of a key or dash that still waits for a block value
        scalar = -1  # column of the parent of a plain scalar that may go on
        lines = self.lines
        while self.n < len(lines):
            raw = lines[self.n]
            body = raw.lstrip(" ")
            if not body.strip() or body.lstrip().startswith("#"):
                self.n += 1
                continue
            if raw.startswith(("---", "...")) and raw[3:4] in ("", " "):
                stack, pending, scalar = [], -1, -1
                rest = raw[3:].strip()
                self.n += 1
                if rest and not rest.startswith("#"):
                    self.n -= 1
                    lines[self.n] = "   " + raw[3:]
                    continue
                continue
            if raw.startswith("%") and not stack and self.n + 1 < len(lines):
                self.n += 1
                continue
            col = len(raw) - len(body)
            if body[0] == "\t":
                if scalar >= 0 and self.value_free(body.strip()):
                    self.n += 1
                    continue
                raise _Bad
            parent = stack[-1][0] if stack else -1
            if scalar != -1 and col > scalar and not (stack and col <= parent and scalar == parent):
                # a further line of a plain scalar
                if not self.value_free(body):
                    raise _Bad
                self.n += 1
                continue
            while stack and (col < stack[-1][0] or (col == stack[-1][0] and stack[-1][1] == "seq" and not re.match(r"-(?:\s|$)", body))):
                stack.pop()
                pending = -1
                if not stack:  # the root collection is over, so nothing may follow it
                    raise _Bad
            scalar = -1
            pending, scalar = self.entry(stack, col, body, pending)

    def value_free(self, s: str) -> bool:
        """Whether a line can go on a plain scalar: no mapping value in it."""
        s = re.sub(r"\s#.*$", "", s)
        return not re.search(r":(?:\s|$)", s)

    def entry(self, stack: list, col: int, body: str, pending: int) -> tuple[int, int]:
        """Reads one line (and what it carries on to); gives the new pending and scalar columns."""
        while re.match(r"-(?:[ \t]|$)", body):
            if stack and stack[-1][0] == col:
                if stack[-1][1] == "map":
                    if pending != col:
                        raise _Bad
                    stack.append([col, "seq"])
            elif not stack or pending >= 0 or stack[-1][0] < col:
                if stack and pending < 0:
                    raise _Bad
                stack.append([col, "seq"])
            else:
                raise _Bad
            rest = body[1:].lstrip(" ")
            if rest.startswith("\t"):
                rest = rest.lstrip()
            if not rest or rest.startswith("#"):
                self.n += 1
                return col, -1
            col += len(body) - len(rest)
            body, pending = rest, col - 1
        if stack and stack[-1][0] == col and stack[-1][1] == "map":
            key = True
        elif not stack or pending >= 0:
            key = False
        else:
            raise _Bad
        m = _PROPS.match(body)
        lead = m.end() if m else 0
        rest = body[lead:]
        end = self.key_end(rest)
        if end < 0:
            if key:
                raise _Bad
            return self.scalar(rest, stack[-1][0] if stack else -1)
        if not key:
            stack.append([col, "map"])
        value = rest[end + 1 :].strip(" \t")
        value = _PROPS.sub("", value + " ", count=1).strip() if value[:1] in "&!" and value else value
        if not value or value.startswith("#"):
            self.n += 1
            return col, -1
        if re.match(r"-(?:\s|$)", value):
            raise _Bad
        return self.scalar(value, col)

    def key_end(self, s: str) -> int:
        """Place of the colon that ends an implicit key, or -1."""
        if s[0] in "\"'":
            m = (_DQ if s[0] == '"' else _SQ).match(s)
            if not m:
                return -1
            t = re.match(r"[ \t]*:(?=\s|$)", s[m.end() :])
            return m.end() + t.end() - 1 if t else -1
        if s[0] in "[{":
            e = self.flow_end(s, 0)
            if e < 0:
                return -1
            t = re.match(r"[ \t]*:(?=\s|$)", s[e:])
            return e + t.end() - 1 if t else -1
        if s[0] == "?" and s[1:2] in ("", " "):
            return 0
        if s[0] == ":" and s[1:2] in ("", " "):
            return 0
        m = re.search(r":(?=\s|$)|\s#", s)
        return m.start() if m and m.group() == ":" else -1

    def flow_end(self, s: str, i: int) -> int:
        """Place after the flow collection at s[i]; -1 if it stays open."""
        stack = []
        last = ""
        while i < len(s):
            c = s[i]
            if c in "[{":
                if last == "v":
                    raise _Bad
                stack.append(c)
                last = ""
            elif c in "]}":
                if not stack or (stack.pop() == "[") != (c == "]"):
                    raise _Bad
                last = "v"
                if not stack:
                    return i + 1
            elif c in "\"'":
                m = (_DQ if c == '"' else _SQ).match(s, i)
                if not m:
                    return -1
                i = m.end() - 1
                last = "v"
            elif c == ",":
                if last == ",":
                    raise _Bad
                last = ","
            elif c == "#" and s[i - 1] in " \t\n":
                i = s.find("\n", i)
                if i < 0:
                    return -1
            elif not c.isspace():
                last = "" if c in ":-?&*!" else "p"
            i += 1
        return -1

    def scalar(self, s: str, col: int) -> tuple[int, int]:
        """Reads the value that starts with s on the present line; it may run over further lines."""
        lines = self.lines
        c = s[0]
        if _BLOCK.match(s):
            self.n += 1
            while self.n < len(lines):
                x = lines[self.n]
                if x.strip() and len(x) - len(x.lstrip(" ")) <= col:
                    break
                self.n += 1
            return -1, -1
        if c in "\"'[{":
            text, k = s, self.n
            while True:
                if c in "\"'":
                    m = (_DQ if c == '"' else _SQ).match(text)
                    e = m.end() if m else -1
                else:
                    e = self.flow_end(text, 0)
                if e >= 0:
                    break
                k += 1
                if k >= len(lines):
                    raise _Bad
                x = lines[k]
                if x.strip() and len(x) - len(x.lstrip(" ")) <= col and not (c in "[{" and x.strip()[0] in "]}"):
                    raise _Bad
                text += "\n" + x
            tail = text[e:].strip()
            if tail and not tail.startswith("#"):
                raise _Bad
            self.n = k + 1
            return -1, -1
        if c in "@`%" or c in ",]}" or (c in "|>" and s[1:2] != ""):
            raise _Bad
        if c == "*" and re.match(r"\*[^\s,\[\]{}]+\s*(?:#.*)?$", s):
            self.n += 1
            return -1, -1
        if not self.value_free(s):
            raise _Bad
        self.n += 1
        return -1, (-1 if re.search(r"\s#", s) else col)


def yaml_parses(text: str) -> bool:
    """Block and flow structure of YAML 1.2; the empty stream is fine."""
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
        return False
    allow_depth(len(text))
    try:
        _Yaml(text).parse()
    except _Bad:
        return False
    return True


# ---------------------------------------------------------------- SQL
_SQL = re.compile(
    r"""(?P<ws>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)|(?P<str>'(?:[^'\\]|''|\\.)*+'|"(?:[^"]|"")*+"|`[^`]*`)
|(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d]\w*)|(?P<par>[:@$?][\w]*)|(?P<op><=|>=|<>|!=|\|\||::|:=|[-+*/%=<>.,;()\[\]&|^~])""",
    re.X | re.S,
)
#: Words a statement may start with (fixed values).
_STARTS = frozenset(
    """select insert update delete create alter drop truncate with merge replace set use begin commit rollback start
    grant revoke explain analyze lock unlock call declare show describe values comment vacuum pragma savepoint release""".split()
)
_OPEN_ENDED = frozenset(
    """select insert update delete into from where set values and or not in like between join on by as union limit order
    group having is table = < > <= >= <> != + - * / % , .""".split()
)


def _sql_statement(t: list[tuple[str, str]]) -> bool:
    words = [x[1].lower() if x[0] == "word" else x[1] for x in t]
    if words[0] not in _STARTS and words[0] != "(":
        return False
    if words[-1] in _OPEN_ENDED and not (words[-1] == "*" and words[0] == "select"):
        return False
    for a, b in zip(words, words[1:]):
        if (a == "," and b in (",", ")")) or (a == "(" and b == ","):
            return False
    kinds = [x[0] for x in t]
    for (ka, kb), (a, b) in zip(zip(kinds, kinds[1:]), zip(words, words[1:])):
        if ka in ("num",) and kb in ("num", "str") or ka == "str" and kb == "num":
            return False
    if words[0] == "insert":
        if words[1:2] != ["into"] and words[1:2] != ["ignore"] or len(words) < 5:
            return False
        if not {"values", "select", "set", "default"} & set(words):
            return False
    if words[0] == "select" and len(words) < 2:
        return False
    return True


SQL_STATES = ("code", "'", '"', "`", "/*")
_SQL_REST = {"'": re.compile(r"(?:[^'\\]|''|\\.)*+'", re.S), '"': re.compile(r'(?:[^"]|"")*+"'), "`": re.compile("[^`]*`"), "/*": re.compile(r".*?\*/", re.S)}


def sql_scan(state: str, text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """(end state or None, tokens as (kind, text)) of a piece; parentheses are kinds of their own, strings have no text."""
    out: list[tuple[str, str]] = []
    i, n = 0, len(text)
    if state != "code":
        m = _SQL_REST[state].match(text)
        if not m:
            return state, out
        if state != "/*":
            out.append(("str", "''"))
        i = m.end()
    while i < n:
        m = _SQL.match(text, i)
        kind = m.lastgroup if m else ""
        if kind != "ws":
            if text.startswith("/*", i):
                return "/*", out
            if not m:
                return (text[i] if text[i] in _SQL_REST else None), out
            out.append(("str", "''") if kind == "str" else (m.group() if m.group() in "()" else kind, m.group()))
        i = m.end()
    return "code", out


def sql_parses_tokens(toks: list[tuple[str, str]], partner: dict[int, int]) -> bool:
    """The outline of each statement of tokens with matched parentheses."""
    start = i = 0
    while i < len(toks):
        if toks[i][1] == ";":
            if i > start and not _sql_statement(toks[start:i]):
                return False
            start = i + 1
        i = partner.get(i, i) + 1
    return start == i or _sql_statement(toks[start:])


def sql_parses(text: str) -> bool:
    """Tokens, balanced parentheses and the outline of each statement."""
    end, toks = sql_scan("code", text.removeprefix("\ufeff"))
    try:
        return end == "code" and sql_parses_tokens(toks, brackets([t[0] for t in toks]))
    except BracketError:
        return False


# ---------------------------------------------------------------- JSON
JSON_STATES = ("code", '"')
_JSON = re.compile(
    r"""(?P<ws>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<odd>"(?:[^"\\]|\\.)*+")|(?P<open>")
|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-]))|(?P<word>(?:true|false|null)\b)|(?P<op>[\[\]{}:,])|(?P<bad>[^\s"\[\]{}:,]+|\s)""",
    re.X | re.S | re.A)
_JSON_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_JSON_TOKENS = {k: (k,) for k in ("str", "num", "word", "bad", "[", "]", "{", "}", ":", ",")}


def json_scan(state: str, text: str) -> tuple[str, list[tuple[str]]]:
    """(end state, kinds of tokens) of a piece; a string over lines, or with what JSON does not know, is `bad`."""
    i = 0
    out: list[tuple[str]] = []
    if state == '"':
        m = _JSON_REST.match(text)
        if not m:
            return state, []
        i = m.end()
        out.append(_JSON_TOKENS["bad"])
    for m in _JSON.finditer(text, i):
        kind = m.lastgroup
        if kind == "open":
            return '"', out
        if kind != "ws":
            out.append(_JSON_TOKENS[m.group() if kind == "op" else "bad" if kind == "odd" else kind])
    return "code", out


#: What may follow: (kind of token, whether within an object) to the place after it; the places are named by what they wait for (fixed values).
_JSON_NEXT = {"value": ("str", "num", "word"), "first value": ("str", "num", "word"), "key": ("str",), "first key": ("str",)}


def json_parses_tokens(toks: list[tuple[str]], partner: dict[int, int] | None = None) -> bool:
    """RFC 8259 grammar of tokens, one value; an explicit stack, so any depth is fine."""
    stack: list[str] = []
    want = "value"
    for (k,) in toks:
        if want.endswith("value") and k in "[{":
            stack.append(k)
            want = "first value" if k == "[" else "first key"
        elif k in _JSON_NEXT.get(want, ()):
            want = "colon" if want.endswith("key") else "comma"
        elif k == ":" and want == "colon":
            want = "value"
        elif k == "," and want == "comma" and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif k in ("]", "}") and want in ("comma", "first value" if k == "]" else "first key") and stack and stack[-1] == ("[" if k == "]" else "{"):
            stack.pop()
            want = "comma"
        else:
            return False
    return want == "comma" and not stack


def json_parses(text: str) -> bool:
    """RFC 8259 JSON; a byte order mark is fine, NaN and Infinity are not."""
    end, toks = json_scan("code", text.removeprefix("\ufeff"))
    return end == "code" and json_parses_tokens(toks)
