"""ECMAScript grammar over tokens (for problem 7): a recursive parser with automatic semicolons."""

from __future__ import annotations

import re

from quarrylens.php.grammar import Bad as BracketError
from quarrylens.php.grammar import allow_depth, brackets

_ID = r"[A-Za-z_$\x80-\U0010ffff][0-9A-Za-z_$\x80-\U0010ffff]*"
_LEX = re.compile(
    rf"""(?P<ws>[ \t\r\n\f\v﻿\xa0  ]+)
|(?P<comment>//[^\r\n]*|/\*[^*]*(?:\*(?!/)[^*]*)*\*/|\A\#![^\r\n]*)
|(?P<bad>/\*)
|(?P<word>\#?{_ID})
|(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?(?:[\d_]+)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
|(?P<str>"[^"\\\r\n]*(?:\\(?:\r\n|[\s\S])[^"\\\r\n]*)*"|'[^'\\\r\n]*(?:\\(?:\r\n|[\s\S])[^'\\\r\n]*)*')
|(?P<tick>`)
|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!.,;:?()\[\]{{}}&|^~@])
""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*")
#: Reserved words (fixed values).
_RESERVED = frozenset(
    """break case catch class const continue debugger default delete do else export extends finally for function if import
    in instanceof new return super switch this throw try typeof var void while with null true false enum""".split()
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("|| && ?? | ^ & == != === !== < > <= >= << >> >>> + - * / % ** instanceof in".split())
_VALUE_END = frozenset(("id", "num", "str", "tpl", "regex", ")", "]", "}", "this", "super", "null", "true", "false"))


class Bad(Exception):
    pass


#: States a piece of a script may start in: as a whole, in code (behind a value or not), in a string (after a line
#: break or not), in a comment (behind a value or not), in a template. Templates that nest have further ones.
STATES = ("start", *((w, x) for w in ("code", "'", '"', "/*") for x in (False, True)), *(("`", x, (0,)) for x in (False, True)))
_STRING_REST = {q: re.compile(rf"[^{q}\\\r\n]*(?:\\(?:\r\n|[\s\S])[^{q}\\\r\n]*)*") for q in "'\""}


def scan(state, text: str):
    """(end state or None, tokens as (kind, name, line break before)) of a piece; a template literal is one `tpl` token."""
    out: list[tuple[str, str, bool]] = []
    i, n, nl, last = 0, len(text), state != "start", False
    if state == "start":
        m = re.match(r"\#![^\r\n]*", text)
        i = m.end() if m else 0
    elif state[0] == "code":
        last = state[1]
    elif state[0] == "/*":
        i, last = text.find("*/") + 2, state[1]
        if i < 2:
            return state, out
    elif state[0] in "'\"":
        i = _STRING_REST[state[0]].match(text).end()
        if text[i : i + 1] != state[0]:
            return (state if i == n else None), out
        out.append(("str", "", state[1]))
        i, nl, last = i + 1, False, True
    elif state[0] == "`":
        i, rest = _template(text, 0, state[2])
        if i < 0:
            return (("`", state[1], rest) if rest else None), out
        out.append(("tpl", "", state[1]))
        nl, last = False, True
    while i < n:
        c = text[i]
        if c == "/" and not last and (m := _REGEX.match(text, i)):
            out.append(("regex", "", nl))
            i, nl, last = m.end(), False, True
            continue
        m = _LEX.match(text, i)
        if not m:
            if c in "'\"" and _STRING_REST[c].match(text, i + 1).end() == n:
                return (c, nl), out
            return None, out
        kind, j, name = m.lastgroup, m.end(), ""
        if kind == "bad":
            return ("/*", last), out
        if kind == "ws" or kind == "comment":
            if kind == "comment" and m.group().startswith("#!"):
                return None, out
            nl = nl or "\n" in m.group()
            i = j
            continue
        if kind == "tick":
            j, rest = _template(text, i + 1, (0,))
            if j < 0:
                return (("`", nl, rest) if rest else None), out
            kind = "tpl"
        elif kind == "word":
            name = m.group()
            kind, name = (name, "") if name in _RESERVED else ("id", name)
        elif kind == "op":
            kind = m.group()
        elif kind == "num" and j < n and re.match(r"[A-Za-z_$]", text[j]):
            return None, out
        out.append((kind, name, nl))
        i, nl, last = j, False, kind in _VALUE_END
    return ("start" if state == "start" and not n else ("code", last)), out


def _template(text: str, i: int, state: tuple):
    """(place behind the template, ()), or (-1, state) where the piece ends within it: 0 for text, else the depth of
    braces in ${}, per template; last the quote of a string. No state is left where nothing can follow."""
    n, stack = len(text), list(state)
    while i < n or stack[-1] in ("'", '"'):
        d = stack[-1]
        if d in ("'", '"'):
            j = _STRING_REST[d].match(text, i).end()
            if text[j : j + 1] != d:
                return -1, tuple(stack) if j == n else ()
            stack.pop()
            i = j + 1
            continue
        c = text[i]
        i += 1
        if c == "`":
            if d:
                stack.append(0)
            else:
                stack.pop()
                if not stack:
                    return i, ()
        elif not d:
            if c == "\\":
                i += 1
            elif c == "$" and text[i : i + 1] == "{":
                stack[-1] = 1
                i += 1
        elif c in "'\"":
            stack.append(c)
        else:
            stack[-1] = d + (c == "{") - (c == "}")
    return -1, tuple(stack)


class _Parser:
    def __init__(self, toks: list[tuple[str, str, bool]], partner: dict[int, int]):
        self.k = [t[0] for t in toks] + ["eof"]
        self.w = [t[1] for t in toks] + [""]
        self.nl = [t[2] for t in toks] + [True]
        self.m = partner

    def need(self, i: int, kind: str) -> int:
        if self.k[i] != kind:
            raise Bad(i)
        return i + 1

    def semi(self, i: int) -> int:
        if self.k[i] == ";":
            return i + 1
        if self.k[i] in ("}", "eof") or self.nl[i]:
            return i
        raise Bad(i)

    def program(self) -> None:
        i = 0
        while self.k[i] != "eof":
            i = self.statement(i)

    def block(self, i: int) -> int:
        if self.k[i] != "{":
            raise Bad(i)
        end, i = self.m[i], i + 1
        while i < end:
            i = self.statement(i)
        if i != end:
            raise Bad(i)
        return end + 1

    def paren(self, i: int) -> int:
        if self.k[i] != "(":
            raise Bad(i)
        end = self.m[i]
        if self.comma(i + 1) != end:
            raise Bad(end)
        return end + 1

    def statement(self, i: int) -> int:
        k, t = self.k, self.k[i]
        if t == "{":
            return self.block(i)
        if t == ";":
            return i + 1
        if t in ("var", "const") or (t == "id" and self.w[i] == "let" and k[i + 1] in ("id", "[", "{")):
            return self.semi(self.bindings(i + 1, t == "const"))
        if t == "function" or (t == "id" and self.w[i] == "async" and k[i + 1] == "function" and not self.nl[i + 1]):
            return self.function(i + (t != "function"), True)
        if t == "class":
            return self.klass(i, True)
        if t == "if":
            i = self.statement(self.paren(i + 1))
            return self.statement(i + 1) if k[i] == "else" else i
        if t == "for":
            return self.for_(i + 1)
        if t in ("while", "with"):
            return self.statement(self.paren(i + 1))
        if t == "do":
            i = self.paren(self.need(self.statement(i + 1), "while"))
            return i + 1 if k[i] == ";" else i
        if t in ("break", "continue"):
            return self.semi(i + 2 if k[i + 1] == "id" and not self.nl[i + 1] else i + 1)
        if t in ("return", "throw"):
            if k[i + 1] in (";", "}", "eof") or self.nl[i + 1]:
                if t == "throw":
                    raise Bad(i)
                return self.semi(i + 1)
            return self.semi(self.comma(i + 1))
        if t == "switch":
            i = self.paren(i + 1)
            if k[i] != "{":
                raise Bad(i)
            end, i = self.m[i], i + 1
            while i < end:
                i = self.need(self.comma(i + 1) if k[i] == "case" else self.need(i, "default"), ":")
                while i < end and k[i] not in ("case", "default"):
                    i = self.statement(i)
            return end + 1
        if t == "try":
            i = self.block(i + 1)
            if k[i] not in ("catch", "finally"):
                raise Bad(i)
            if k[i] == "catch":
                i += 1
                if k[i] == "(":
                    if self.pattern(i + 1) != self.m[i]:
                        raise Bad(i)
                    i = self.m[i] + 1
                i = self.block(i)
            return self.block(i + 1) if k[i] == "finally" else i
        if t == "debugger":
            return self.semi(i + 1)
        if t == "import" and k[i + 1] not in ("(", "."):
            return self.import_(i + 1)
        if t == "export":
            return self.export(i + 1)
        if t == "id" and k[i + 1] == ":":
            return self.statement(i + 2)
        return self.semi(self.comma(i))

    def names(self, i: int) -> int:
        """{a, b as c} of import and export."""
        k, end = self.k, self.m[i]
        i += 1
        while i < end:
            i = self.word(i)
            if self.w[i] == "as":
                i = self.word(i + 1)
            if i != end:
                i = self.need(i, ",")
        return end + 1

    def word(self, i: int) -> int:
        if self.k[i] == "id" or self.k[i] == "str" or self.k[i] in _RESERVED:
            return i + 1
        raise Bad(i)

    def from_(self, i: int) -> int:
        if self.w[i] != "from":
            raise Bad(i)
        return self.semi(self.need(i + 1, "str"))

    def import_(self, i: int) -> int:
        k = self.k
        if k[i] == "str":
            return self.semi(i + 1)
        if k[i] == "id":
            i += 1
            if k[i] != ",":
                return self.from_(i)
            i += 1
        if k[i] == "*":
            if self.w[i + 1] != "as":
                raise Bad(i)
            return self.from_(self.need(i + 2, "id"))
        if k[i] != "{":
            raise Bad(i)
        return self.from_(self.names(i))

    def export(self, i: int) -> int:
        k = self.k
        if k[i] == "default":
            i += 1
            if k[i] == "function":
                return self.function(i, False)
            if k[i] == "class":
                return self.klass(i, False)
            return self.semi(self.assign(i))
        if k[i] == "*":
            i += 1
            if self.w[i] == "as":
                i = self.word(i + 1)
            return self.from_(i)
        if k[i] == "{":
            i = self.names(i)
            return self.from_(i) if self.w[i] == "from" else self.semi(i)
        if k[i] in ("var", "const", "function", "class") or self.w[i] in ("let", "async"):
            return self.statement(i)
        raise Bad(i)

    def bindings(self, i: int, must: bool, no_in: bool = False) -> int:
        while True:
            plain = self.k[i] == "id"
            i = self.pattern(i)
            if self.k[i] == "=":
                i = self.assign(i + 1, no_in)
            elif (must or not plain) and not (no_in and (self.k[i] == "in" or self.w[i] == "of")):
                raise Bad(i)
            if self.k[i] != ",":
                return i
            i += 1

    def pattern(self, i: int) -> int:
        k = self.k
        if k[i] == "id":
            return i + 1
        if k[i] == "[":
            end, i = self.m[i], i + 1
            while i < end:
                if k[i] == ",":
                    i += 1
                    continue
                i = self.pattern(i + 1 if k[i] == "..." else i)
                if k[i] == "=":
                    i = self.assign(i + 1)
                if i != end:
                    i = self.need(i, ",")
            return end + 1
        if k[i] == "{":
            end, i = self.m[i], i + 1
            while i < end:
                if k[i] == "...":
                    i = self.pattern(i + 1)
                else:
                    plain = k[i] == "id"
                    i = self.key(i)
                    if k[i] == ":":
                        i = self.pattern(i + 1)
                    elif not plain:
                        raise Bad(i)
                    if k[i] == "=":
                        i = self.assign(i + 1)
                if i != end:
                    i = self.need(i, ",")
            return end + 1
        raise Bad(i)

    def for_(self, i: int) -> int:
        k = self.k
        if self.w[i] == "await":
            i += 1
        if k[i] != "(":
            raise Bad(i)
        end, i = self.m[i], i + 1
        if k[i] in ("var", "const") or (self.w[i] == "let" and k[i + 1] in ("id", "[", "{")):
            i = self.bindings(i + 1, False, True)
        elif k[i] != ";":
            i = self.comma(i, True)
        if k[i] == "in" or self.w[i] == "of":
            if self.comma(i + 1) != end:
                raise Bad(i)
        else:
            i = self.need(i, ";")
            if k[i] != ";":
                i = self.comma(i)
            i = self.need(i, ";")
            if i != end and self.comma(i) != end:
                raise Bad(i)
        return self.statement(end + 1)

    def params(self, i: int) -> int:
        k = self.k
        if k[i] != "(":
            raise Bad(i)
        end, i = self.m[i], i + 1
        while i < end:
            i = self.pattern(i + 1 if k[i] == "..." else i)
            if k[i] == "=":
                i = self.assign(i + 1)
            if i != end:
                i = self.need(i, ",")
        return end + 1

    def function(self, i: int, named: bool) -> int:
        i = self.need(i, "function")
        if self.k[i] == "*":
            i += 1
        if self.k[i] == "id":
            i += 1
        elif named:
            raise Bad(i)
        return self.block(self.params(i))

    def key(self, i: int) -> int:
        k = self.k
        if k[i] in ("id", "str", "num") or k[i] in _RESERVED:
            return i + 1
        if k[i] == "[":
            if self.assign(i + 1) != self.m[i]:
                raise Bad(i)
            return self.m[i] + 1
        raise Bad(i)

    def method_head(self, i: int) -> int:
        """Skips static, async, get, set and * before a key."""
        k = self.k
        while self.w[i] in ("static", "async", "get", "set") and k[i + 1] not in ("(", "=", ";", "}", ",", ":"):
            i += 1
        return i + 1 if k[i] == "*" else i

    def klass(self, i: int, named: bool) -> int:
        k = self.k
        i += 1
        if k[i] == "id":
            i += 1
        elif named:
            raise Bad(i)
        if k[i] == "extends":
            i = self.unary(i + 1)
        if k[i] != "{":
            raise Bad(i)
        end, i = self.m[i], i + 1
        while i < end:
            if k[i] == ";":
                i += 1
                continue
            if self.w[i] == "static" and k[i + 1] == "{":
                i = self.block(i + 1)
                continue
            i = self.key(self.method_head(i))
            if k[i] == "(":
                i = self.block(self.params(i))
            else:
                if k[i] == "=":
                    i = self.assign(i + 1)
                i = self.semi(i)
        return end + 1

    def comma(self, i: int, no_in: bool = False) -> int:
        i = self.assign(i, no_in)
        while self.k[i] == ",":
            i = self.assign(i + 1, no_in)
        return i

    def assign(self, i: int, no_in: bool = False) -> int:
        k = self.k
        if self.w[i] == "yield":
            i += 1
            if k[i] == "*":
                i += 1
            if k[i] in (")", "]", "}", ",", ";", ":", "eof") or self.nl[i]:
                return i
            return self.assign(i, no_in)
        j = i + 1 if self.w[i] == "async" and k[i + 1] in ("id", "(") and not self.nl[i + 1] else i
        if k[j] == "id" and k[j + 1] == "=>":
            return self.arrow(j + 1, no_in)
        if k[j] == "(" and k[self.m[j] + 1] == "=>":
            return self.arrow(self.params(j), no_in)
        start = i
        i = self.binary(i, no_in)
        if k[i] == "?":
            i = self.need(self.assign(i + 1), ":")
            return self.assign(i, no_in)
        if k[i] in _ASSIGN:
            if k[start] in ("num", "str", "regex", "tpl") and i == start + 1:
                raise Bad(i)
            return self.assign(i + 1, no_in)
        return i

    def arrow(self, i: int, no_in: bool) -> int:
        i += 1
        return self.block(i) if self.k[i] == "{" else self.assign(i, no_in)

    def binary(self, i: int, no_in: bool) -> int:
        i = self.unary(i)
        while self.k[i] in _BINARY and not (no_in and self.k[i] == "in"):
            i = self.unary(i + 1)
        return i

    def unary(self, i: int) -> int:
        k = self.k
        while k[i] in ("!", "~", "+", "-", "typeof", "void", "delete", "++", "--") or (self.w[i] == "await" and k[i + 1] not in (")", ";", ",", ".", "=")):
            i += 1
        i = self.postfix(self.primary(i))
        if k[i] in ("++", "--") and not self.nl[i]:
            i += 1
        return i

    def primary(self, i: int) -> int:
        k, t = self.k, self.k[i]
        if t in ("id", "num", "str", "tpl", "regex", "this", "super", "null", "true", "false"):
            if t == "id" and self.w[i] == "async" and k[i + 1] == "function":
                return self.function(i + 1, False)
            return i + 1
        if t == "(":
            return self.paren(i)
        if t == "[":
            end, i = self.m[i], i + 1
            while i < end:
                if k[i] == ",":
                    i += 1
                    continue
                i = self.assign(i + 1 if k[i] == "..." else i)
                if i != end:
                    i = self.need(i, ",")
            return end + 1
        if t == "{":
            end, i = self.m[i], i + 1
            while i < end:
                if k[i] == "...":
                    i = self.assign(i + 1)
                else:
                    i = self.method_head(i)
                    plain = k[i] == "id"
                    i = self.key(i)
                    if k[i] == "(":
                        i = self.block(self.params(i))
                    elif k[i] == ":":
                        i = self.assign(i + 1)
                    elif k[i] == "=" and plain:
                        i = self.assign(i + 1)
                    elif not plain:
                        raise Bad(i)
                if i != end:
                    i = self.need(i, ",")
            return end + 1
        if t == "function":
            return self.function(i, False)
        if t == "class":
            return self.klass(i, False)
        if t == "new":
            if k[i + 1] == ".":
                return i + 3
            return self.primary(i + 1)
        if t == "import":
            return i + 1
        raise Bad(i)

    def postfix(self, i: int) -> int:
        k = self.k
        while True:
            t = k[i]
            if t == "." or t == "?.":
                i += 1
                if t == "?." and k[i] in ("(", "["):
                    continue
                if k[i] != "id" and k[i] not in _RESERVED:
                    raise Bad(i)
                i += 1
            elif t == "(":
                end, j = self.m[i], i + 1
                while j < end:
                    j = self.assign(j + 1 if k[j] == "..." else j)
                    if j != end:
                        j = self.need(j, ",")
                i = end + 1
            elif t == "[":
                if self.comma(i + 1) != self.m[i]:
                    raise Bad(i)
                i = self.m[i] + 1
            elif t == "tpl":
                i += 1
            else:
                return i


def parses_tokens(toks: list[tuple[str, str, bool]], partner: dict[int, int]) -> bool:
    """Whether tokens with matched brackets are a script or module."""
    allow_depth(len(toks))
    try:
        _Parser(toks, partner).program()
    except (Bad, IndexError, KeyError):
        return False
    return True


def parses(text: str) -> bool:
    """Whether the text is a script or module; the empty text is."""
    end, toks = scan("start", text.removeprefix("\ufeff"))
    try:
        return end is not None and end[0] in ("s", "code") and parses_tokens(toks, brackets([t[0] for t in toks]))
    except BracketError:
        return False
