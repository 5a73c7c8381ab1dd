"""PHP 8.4 grammar over token kinds (S9, E2): local grammars for balanced statements.

Brackets are matched first, in one pass; after that a statement is a span
between two known places, and spans whose kinds were seen before are looked up
instead of parsed. Only grammar is checked, never names, types or other rules
of the compiler.
"""

from __future__ import annotations

import sys

from quarrylens.php.lexer import KEYWORDS, tokens

_SKIP = frozenset(("ws", "comment", "doc"))
_NAMES = KEYWORDS | {"id"}
_MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
_CLOSER = {"(": ")", "[": "]", "{": "}", "attr": "]"}
_ASSIGN = frozenset("= += -= *= /= .= %= &= |= ^= <<= >>= **= ??=".split())
_BINARY = frozenset("|| && | ^ & == != === !== <> < > <= >= <=> << >> + - * / % . ** ?? and or xor".split())
#: Operators that do not chain with themselves or their neighbours.
_NON_ASSOC = {**dict.fromkeys(("==", "!=", "===", "!==", "<>", "<=>"), 1), **dict.fromkeys(("<", "<=", ">", ">="), 2)}
_PREFIX = frozenset("! ~ @ + - cast & ++ -- print new clone".split())
_SCALARS = frozenset("num str dq heredoc".split())
_LIMIT = 400_000


class Bad(Exception):
    """The source stops being grammatical at this token."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class _Span:
    """One parse of the kinds `k`; `m` holds the partner of each bracket."""

    def __init__(self, k: list[str], m: dict[int, int]):
        self.k, self.m = k, m

    # -- helpers
    def need(self, i: int, kind: str) -> int:
        if self.k[i] != kind:
            raise Bad(i, f"expected {kind}, saw {self.k[i]}")
        return i + 1

    def name(self, i: int) -> int:
        """A class-like name, possibly qualified."""
        if self.k[i] in ("id", "qid", "enum"):
            return i + 1
        raise Bad(i, f"expected a name, saw {self.k[i]}")

    def comma_list(self, i: int, end: int, item, trailing: bool = True, empty: bool = True) -> None:
        """`item`s separated by commas, filling i..end exactly."""
        if i == end:
            if empty:
                return
            raise Bad(i, "empty list")
        while True:
            i = item(i)
            if i == end:
                return
            i = self.need(i, ",")
            if i == end:
                if trailing:
                    return
                raise Bad(i, "trailing comma")

    def group(self, i: int, item, trailing: bool = True, empty: bool = True) -> int:
        end = self.m[i]
        self.comma_list(i + 1, end, item, trailing, empty)
        return end + 1

    def attributes(self, i: int) -> int:
        while self.k[i] == "attr":
            i = self.group(i, self.attribute, empty=False)
        return i

    def attribute(self, i: int) -> int:
        i = self.name(i)
        return self.arguments(i) if self.k[i] == "(" else i

    # -- types
    def type(self, i: int) -> int:
        k = self.k
        if k[i] == "?":
            return self.type_atom(i + 1)
        while True:
            if k[i] == "(" :
                end = self.m[i]
                j = self.type_atom(i + 1)
                while j != end:
                    j = self.type_atom(self.need(j, "&"))
                i = end + 1
            else:
                i = self.type_atom(i)
            if k[i] == "|" or (k[i] == "&" and k[i + 1] not in ("variable", "...", "&")):
                i += 1
            else:
                return i

    def type_atom(self, i: int) -> int:
        if self.k[i] in ("id", "qid", "array", "callable", "static", "enum"):
            return i + 1
        raise Bad(i, f"expected a type, saw {self.k[i]}")

    # -- parameters and arguments
    def parameter(self, i: int) -> int:
        k = self.k
        i = self.attributes(i)
        while k[i] in ("public", "protected", "private", "readonly", "final"):
            i += 1
            if k[i] == "(" and k[i + 1] == "id":  # private(set)
                i = self.m[i] + 1
        if k[i] not in ("variable", "&", "..."):
            i = self.type(i)
        if k[i] == "&":
            i += 1
        if k[i] == "...":
            i += 1
        i = self.need(i, "variable")
        if k[i] == "=":
            i = self.expr(i + 1)
        if k[i] == "{":
            self.hooks(i)
            i = self.m[i] + 1
        return i

    def argument(self, i: int) -> int:
        k = self.k
        if k[i] == "...":
            return self.expr(i + 1)
        if k[i] in _NAMES and k[i + 1] == ":" and k[i + 2] != ":":
            i += 2
        return self.expr(i)

    def arguments(self, i: int) -> int:
        end = self.m[i]
        if self.k[i + 1] == "..." and end == i + 2:
            return end + 1
        return self.group(i, self.argument)

    # -- expressions
    def expr(self, i: int) -> int:
        k = self.k
        last = 0
        while True:
            i = self.unary(i)
            op = k[i]
            while op == "?":  # ternary
                i = i + 2 if k[i + 1] == ":" else self.need(self.expr(i + 1), ":")
                i = self.unary_chain(i)
                op = k[i]
                last = 0
                if op == "?":
                    raise Bad(i, "nested ternary without parentheses")
            if op in _BINARY:
                if op in ("and", "or", "xor", "||", "&&", "|", "^", "&", "??"):
                    last = 0
                level = _NON_ASSOC.get(op, 0)
                if level and level == last:
                    raise Bad(i, f"{op} does not chain")
                if level:
                    last = level
                i += 1
            elif op == "instanceof":
                i += 1
                if k[i] in ("id", "qid", "static", "enum"):
                    i = self.postfix(i + 1)
                else:
                    i = self.unary(i)
                op = k[i]
                if op in _BINARY:
                    i += 1
                    continue
                if op == "?":
                    i = i + 2 if k[i + 1] == ":" else self.need(self.expr(i + 1), ":")
                    continue
                return i
            else:
                return i

    def unary_chain(self, i: int) -> int:
        """The part after the colon of a ternary: operators that bind tighter than it."""
        k = self.k
        while True:
            i = self.unary(i)
            if k[i] in _BINARY and k[i] not in ("and", "or", "xor"):
                i += 1
            elif k[i] == "instanceof":
                i += 1
                i = i + 1 if k[i] in ("id", "qid", "static", "enum") else self.unary(i)
                if k[i] in _BINARY and k[i] not in ("and", "or", "xor"):
                    i += 1
                else:
                    return i
            else:
                return i

    def unary(self, i: int) -> int:
        k = self.k
        while k[i] in ("!", "~", "@", "+", "-", "cast", "&", "print", "clone"):
            if k[i] == "&" and k[i + 1] not in ("variable", "new", "id", "qid", "$", "static"):
                raise Bad(i, "did not expect & here")
            i += 1
        t = k[i]
        if t in ("++", "--"):
            return self.writable(i + 1)
        if t == "throw":
            return self.expr(i + 1)
        if t in ("include", "include_once", "require", "require_once"):
            return self.expr(i + 1)
        if t == "yield":
            i += 1
            if k[i] == "id" and self.is_from(i):
                return self.expr(i + 1)
            if k[i] in (";", ")", "]", ",", "close", "}"):
                return i
            i = self.expr(i)
            return self.expr(i + 1) if k[i] == "=>" else i
        if t in ("fn", "function") or (t == "static" and k[i + 1] in ("fn", "function")) or t == "attr":
            return self.closure(i)
        start = i
        i = self.primary(i)
        if k[i] in _ASSIGN:
            if k[start] in _SCALARS or k[i - 1] == ")" and k[start] != "list":
                raise Bad(i, "cannot assign here")
            return self.unary_assign(i + 1)
        if k[i] in ("++", "--"):
            i += 1
        return i

    def is_from(self, i: int) -> bool:
        return self.k[i + 1] not in (";", ")", ",", "]", "=>", "=", "(", "->", "::") or self.k[i + 1] == "("

    def unary_assign(self, i: int) -> int:
        if self.k[i] == "&":
            i += 1
        return self.assign_value(i)

    def assign_value(self, i: int) -> int:
        """Right side of an assignment: everything but the weak word operators."""
        k = self.k
        i = self.expr_no_words(i)
        return i

    def expr_no_words(self, i: int) -> int:
        k = self.k
        last = 0
        while True:
            i = self.unary(i)
            op = k[i]
            if op == "?":
                i = i + 2 if k[i + 1] == ":" else self.need(self.expr(i + 1), ":")
                i = self.unary_chain(i)
                if k[i] == "?":
                    raise Bad(i, "nested ternary without parentheses")
                op = k[i]
            if op in _BINARY and op not in ("and", "or", "xor"):
                if op in ("||", "&&", "|", "^", "&", "??"):
                    last = 0
                level = _NON_ASSOC.get(op, 0)
                if level and level == last:
                    raise Bad(i, f"{op} does not chain")
                if level:
                    last = level
                i += 1
            elif op == "instanceof":
                i += 1
                i = self.postfix(i + 1) if k[i] in ("id", "qid", "static", "enum") else self.unary(i)
                if k[i] in _BINARY and k[i] not in ("and", "or", "xor"):
                    i += 1
                elif k[i] == "?":
                    i = i + 2 if k[i + 1] == ":" else self.need(self.expr(i + 1), ":")
                else:
                    return i
            else:
                return i

    def writable(self, i: int) -> int:
        if self.k[i] not in ("variable", "$", "id", "qid", "static", "(", "enum"):
            raise Bad(i, f"expected a variable, saw {self.k[i]}")
        return self.primary(i)

    def closure(self, i: int) -> int:
        k = self.k
        i = self.attributes(i)
        if k[i] == "new":
            raise Bad(i, "attribute before new")
        if k[i] == "static":
            i += 1
        arrow = k[i] == "fn"
        if k[i] not in ("fn", "function"):
            raise Bad(i, f"expected a closure, saw {k[i]}")
        i += 1
        if k[i] == "&":
            i += 1
        if k[i] != "(":
            raise Bad(i, f"expected (, saw {k[i]}")
        i = self.group(i, self.parameter)
        if not arrow and k[i] == "use":
            if k[i + 1] != "(":
                raise Bad(i + 1, "expected (")
            i = self.group(i + 1, lambda j: self.need(j + 1 if k[j] == "&" else j, "variable"))
        if k[i] == ":":
            i = self.type(i + 1)
        if arrow:
            return self.expr_no_words(self.need(i, "=>"))
        if k[i] != "{":
            raise Bad(i, f"expected a body, saw {k[i]}")
        self.block(i)
        return self.postfix(self.m[i] + 1)

    def item(self, i: int) -> int:
        """An array or destructuring item."""
        k = self.k
        if k[i] == "...":
            return self.expr(i + 1)
        if k[i] == "&":
            return self.writable(i + 1)
        i = self.expr(i)
        if k[i] == "=>":
            i += 1
            i = self.writable(i + 1) if k[i] == "&" else self.expr(i)
        return i

    def items(self, i: int, end: int) -> None:
        """Array items; holes are fine (they stand in destructuring)."""
        k = self.k
        i += 1
        while i < end:
            if k[i] == ",":
                i += 1
                continue
            i = self.item(i)
            if i < end:
                i = self.need(i, ",")

    def primary(self, i: int) -> int:
        k = self.k
        t = k[i]
        if t in ("variable", "num", "str", "dq", "heredoc", "id", "qid"):
            return self.postfix(i + 1)
        if t == "(":
            end = self.m[i]
            j = self.expr(i + 1)
            if j != end:
                raise Bad(j, f"did not expect {k[j]} here")
            return self.postfix(end + 1)
        if t == "[":
            self.items(i, self.m[i])
            return self.postfix(self.m[i] + 1)
        if t in ("array", "list") and k[i + 1] == "(":
            self.items(i + 1, self.m[i + 1])
            return self.postfix(self.m[i + 1] + 1)
        if t == "new":
            return self.new(i + 1)
        if t == "match" and k[i + 1] == "(":
            return self.match(i)
        if t == "$":
            while k[i] == "$":
                i += 1
            if k[i] == "{":
                end = self.m[i]
                if self.expr(i + 1) != end:
                    raise Bad(end, "did not expect this here")
                return self.postfix(end + 1)
            return self.postfix(self.need(i, "variable"))
        if t in ("isset", "unset") and k[i + 1] == "(":
            return self.group(i + 1, self.expr, empty=False)
        if t in ("empty", "eval") and k[i + 1] == "(":
            end = self.m[i + 1]
            if self.expr(i + 2) != end:
                raise Bad(end, "did not expect this here")
            return end + 1
        if t in ("exit", "die"):
            return self.arguments(i + 1) if k[i + 1] == "(" else i + 1
        if t in ("static", "enum", "readonly", "match"):
            if t == "static" and k[i + 1] not in ("::", "("):
                raise Bad(i + 1, f"did not expect {k[i + 1]} here")
            return self.postfix(i + 1)
        raise Bad(i, f"did not expect {t} here")

    def new(self, i: int) -> int:
        k = self.k
        j = self.attributes(i)
        if k[j] in ("class", "readonly", "final"):
            j += k[j] in ("readonly", "final")
            j = self.need(j, "class")
            if k[j] == "(":
                j = self.arguments(j)
            j = self.heritage(j)
            if k[j] != "{":
                raise Bad(j, "expected a class body")
            self.members(j, "class")
            return self.postfix(self.m[j] + 1)
        if k[i] in ("id", "qid", "static", "enum"):
            i += 1
            while k[i] == "::" and k[i + 1] == "variable":
                i += 2
        elif k[i] == "(":
            end = self.m[i]
            if self.expr(i + 1) != end:
                raise Bad(end, "did not expect this here")
            i = end + 1
        elif k[i] in ("variable", "$"):
            i = i + 1 if k[i] == "variable" else self.need(i + 1, "variable")
            while True:
                if k[i] in ("->", "?->", "::") and k[i + 1] in _NAMES | {"variable"}:
                    i += 2
                elif k[i] == "[":
                    end = self.m[i]
                    if self.expr(i + 1) != end:
                        raise Bad(end, "did not expect this here")
                    i = end + 1
                else:
                    break
        else:
            raise Bad(i, f"did not expect {k[i]} here")
        if k[i] == "(":
            i = self.arguments(i)
        return self.postfix(i)

    def match(self, i: int) -> int:
        k, body = self.k, self.m[i + 1] + 1
        if self.expr(i + 2) != self.m[i + 1] or k[body] != "{":
            raise Bad(body, f"did not expect {k[body]} here")

        def arm(j: int) -> int:
            if k[j] == "default" and k[j + 1] in ("=>", ","):
                j += 1
                j += k[j] == ","
            else:
                while True:
                    j = self.expr(j)
                    if k[j] != ",":
                        break
                    j += 1
                    if k[j] == "=>":
                        break
            return self.expr(self.need(j, "=>"))

        return self.postfix(self.group(body, arm))

    def postfix(self, i: int) -> int:
        k = self.k
        while True:
            t = k[i]
            if t == "(":
                i = self.arguments(i)
            elif t == "[":
                end = self.m[i]
                if end != i + 1 and self.expr(i + 1) != end:
                    raise Bad(end, "did not expect this here")
                i = end + 1
            elif t == "->" or t == "?->":
                i = self.member_name(i + 1)
            elif t == "::":
                i += 1
                if k[i] == "{":
                    i = self.member_name(i)
                elif k[i] in _NAMES or k[i] == "variable":
                    i += 1
                elif k[i] == "$":
                    i = self.need(i + 1, "variable")
                else:
                    raise Bad(i, f"did not expect {k[i]} here")
            else:
                return i

    def member_name(self, i: int) -> int:
        k = self.k
        if k[i] in _NAMES or k[i] == "variable":
            return i + 1
        if k[i] == "{":
            end = self.m[i]
            if self.expr(i + 1) != end:
                raise Bad(end, "did not expect this here")
            return end + 1
        if k[i] == "$":
            return self.need(i + 1, "variable")
        raise Bad(i, f"did not expect {k[i]} here")

    # -- statements
    def end(self, i: int) -> int:
        """The end of a simple statement."""
        if self.k[i] in (";", "close"):
            return i + 1
        raise Bad(i, f"semicolon missing, saw {self.k[i]}")

    def block(self, i: int) -> int:
        end = self.m[i]
        self.statements(i + 1, end)
        return end + 1

    def statements(self, i: int, end: int) -> None:
        while i < end:
            i = self.statement(i)
        if i > end:
            raise Bad(end, "statement runs on")

    def until(self, i: int, stops: tuple[str, ...]) -> int:
        while self.k[i] not in stops:
            if self.k[i] in ("}", "eof"):
                raise Bad(i, f"block never closed, saw {self.k[i]}")
            i = self.statement(i)
        return i

    def condition(self, i: int) -> int:
        if self.k[i] != "(":
            raise Bad(i, f"expected (, saw {self.k[i]}")
        end = self.m[i]
        j = self.expr(i + 1)
        if j != end:
            raise Bad(j, f"did not expect {self.k[j]} here")
        return end + 1

    def statement(self, i: int) -> int:
        k = self.k
        t = k[i]
        known = _COMPOUND.get(t)
        if t == "id" and k[i + 1] == ":":  # a label
            return i + 2
        if known is None or (t in ("static", "enum", "readonly", "match", "function", "fn", "list", "array") and not self.declares(i)):
            return self.simple(i)
        return known(self, i)

    def declares(self, i: int) -> bool:
        k, t, n = self.k, self.k[i], self.k[i + 1]
        if t == "static":
            return n == "variable" and k[i + 2] in ("=", ",", ";", "close")
        if t == "function":
            return n in _NAMES and k[i + 2] == "(" or n == "&" and k[i + 2] in _NAMES
        if t == "enum":
            return n in _NAMES and k[i + 2] in ("{", ":", "implements")
        return t == "readonly" and n in ("class", "final", "abstract", "readonly")

    def simple(self, i: int) -> int:
        """Expression statements and the like: looked up by kinds, else parsed."""
        k, m, j = self.k, self.m, i
        while k[j] != ";" and k[j] != "close":
            if j in m:
                j = m[j]
                if j < i:
                    raise Bad(j, "did not expect a closing bracket here")
            elif k[j] in ("eof", "}", ")", "]"):
                raise Bad(j, f"semicolon missing, saw {k[j]}")
            j += 1
        key = tuple(k[i : j + 1])
        seen = _KNOWN.get(key)
        if seen is None:
            try:
                seen = self.simple_parse(i) == j + 1
                if not seen:
                    seen = Bad(j - i, "did not expect this here")
            except Bad as e:
                seen = Bad(e.at - i, e.message)
            if len(_KNOWN) > _LIMIT:
                _KNOWN.clear()
            _KNOWN[key] = seen
        if seen is True:
            return j + 1
        raise Bad(i + seen.at, seen.message)

    def simple_parse(self, i: int) -> int:
        k = self.k
        t = k[i]
        if t in ("echo", "open_echo"):
            i += 1
            while True:
                i = self.expr(i)
                if k[i] != ",":
                    return self.end(i)
                i += 1
        if t == "return":
            return self.end(i + 1 if k[i + 1] in (";", "close") else self.expr(i + 1))
        if t in ("break", "continue"):
            return self.end(i + 2 if k[i + 1] == "num" else i + 1)
        if t == "global":
            return self.var_list(i + 1, False)
        if t == "unset":
            return self.end(self.group(i + 1, self.expr, empty=False) if k[i + 1] == "(" else i + 1)
        if t == "goto":
            return self.end(self.need(i + 1, "id"))
        return self.end(self.expr(i))

    def var_list(self, i: int, values: bool) -> int:
        while True:
            while self.k[i] == "$":
                i += 1
            i = self.need(i, "variable")
            if values and self.k[i] == "=":
                i = self.expr(i + 1)
            if self.k[i] != ",":
                return self.end(i)
            i += 1

    def body(self, i: int, stop: str) -> int:
        """A loop's body: a statement, or the colon form up to `stop`."""
        if self.k[i] == ":":
            return self.end(self.until(i + 1, (stop,)) + 1)
        return self.statement(i)

    def s_if(self, i: int) -> int:
        k = self.k
        i = self.condition(i + 1)
        if k[i] == ":":
            i = self.until(i + 1, ("elseif", "else", "endif"))
            while k[i] == "elseif":
                i = self.until(self.need(self.condition(i + 1), ":"), ("elseif", "else", "endif"))
            if k[i] == "else":
                i = self.until(self.need(i + 1, ":"), ("endif",))
            return self.end(self.need(i, "endif"))
        i = self.statement(i)
        while k[i] == "elseif":
            i = self.statement(self.condition(i + 1))
        if k[i] == "else":
            i = self.statement(i + 1)
        return i

    def s_for(self, i: int) -> int:
        k = self.k
        if k[i + 1] != "(":
            raise Bad(i + 1, f"expected (, saw {k[i + 1]}")
        end, j = self.m[i + 1], i + 2
        for stop in (";", ";", ")"):
            while k[j] != stop:
                j = self.expr(j)
                if k[j] == ",":
                    j += 1
                    if k[j] == stop:
                        raise Bad(j, "trailing comma")
                elif k[j] != stop:
                    raise Bad(j, f"did not expect {k[j]} here")
            j += 1
        if j != end + 1:
            raise Bad(j, "did not expect this here")
        return self.body(j, "endfor")

    def s_foreach(self, i: int) -> int:
        k = self.k
        if k[i + 1] != "(":
            raise Bad(i + 1, f"expected (, saw {k[i + 1]}")
        end = self.m[i + 1]
        j = self.need(self.expr(i + 2), "as")
        for last in (False, True):
            j = self.writable(j + 1) if k[j] == "&" else self.primary(j)
            if k[j] == "=>" and not last:
                j += 1
            else:
                break
        if j != end:
            raise Bad(j, f"did not expect {k[j]} here")
        return self.body(end + 1, "endforeach")

    def s_while(self, i: int) -> int:
        return self.body(self.condition(i + 1), "endwhile")

    def s_do(self, i: int) -> int:
        return self.end(self.condition(self.need(self.statement(i + 1), "while")))

    def s_switch(self, i: int) -> int:
        k = self.k
        i = self.condition(i + 1)
        if k[i] == "{":
            stop = self.m[i]
            close = stop + 1
        elif k[i] == ":":
            stop = close = -1
        else:
            raise Bad(i, f"expected {{, saw {k[i]}")
        i += 1
        if k[i] == ";" :
            i += 1
        while i != stop and k[i] != "endswitch":
            if k[i] == "case":
                i = self.expr(i + 1)
            elif k[i] == "default":
                i += 1
            elif k[i] == "inline" or k[i] == "close":
                i += 1
                continue
            else:
                raise Bad(i, f"expected case, saw {k[i]}")
            if k[i] not in (":", ";"):
                raise Bad(i, f"expected :, saw {k[i]}")
            i += 1
            while k[i] not in ("case", "default", "endswitch") and i != stop:
                i = self.statement(i)
        return close if stop >= 0 else self.end(i + 1)

    def s_try(self, i: int) -> int:
        k = self.k
        if k[i + 1] != "{":
            raise Bad(i + 1, f"expected {{, saw {k[i + 1]}")
        i, n = self.block(i + 1), 0
        while k[i] == "catch":
            n += 1
            if k[i + 1] != "(":
                raise Bad(i + 1, "expected (")
            end = self.m[i + 1]
            j = self.name(i + 2)
            while k[j] == "|":
                j = self.name(j + 1)
            if k[j] == "variable":
                j += 1
            if j != end or k[end + 1] != "{":
                raise Bad(j, f"did not expect {k[j]} here")
            i = self.block(end + 1)
        if k[i] == "finally":
            n += 1
            if k[i + 1] != "{":
                raise Bad(i + 1, "expected {")
            i = self.block(i + 1)
        if not n:
            raise Bad(i, "try without catch or finally")
        return i

    def s_declare(self, i: int) -> int:
        k = self.k
        if k[i + 1] != "(":
            raise Bad(i + 1, "expected (")
        i = self.group(i + 1, lambda j: self.expr(self.need(self.need(j, "id"), "=")), trailing=False, empty=False)
        if k[i] in (";", "close"):
            return i + 1
        return self.body(i, "enddeclare")

    def s_namespace(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] in _NAMES or k[i] == "qid":
            i += 1
        elif k[i] != "{":
            raise Bad(i, f"expected a name, saw {k[i]}")
        return self.block(i) if k[i] == "{" else self.end(i)

    def s_use(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] in ("function", "const"):
            i += 1

        def clause(j: int) -> int:
            if k[j] in ("function", "const") and k[j + 1] in ("id", "qid"):
                j += 1
            j = j + 1 if k[j] in _NAMES or k[j] == "qid" else self.name(j)
            if k[j] == "\\" and k[j + 1] == "{":
                return self.group(j + 1, clause, empty=False)
            if k[j] == "as":
                if k[j + 1] not in _NAMES:
                    raise Bad(j + 1, "expected a name")
                j += 2
            return j

        while True:
            i = clause(i)
            if k[i] != ",":
                return self.end(i)
            i += 1

    def s_const(self, i: int) -> int:
        k = self.k
        i += 1
        while True:
            if k[i] not in _NAMES:
                raise Bad(i, f"expected a name, saw {k[i]}")
            i = self.expr(self.need(i + 1, "="))
            if k[i] != ",":
                return self.end(i)
            i += 1

    def function_rest(self, i: int) -> int:
        """Parameters and return type; the place after them."""
        if self.k[i] != "(":
            raise Bad(i, f"expected (, saw {self.k[i]}")
        i = self.group(i, self.parameter)
        return self.type(i + 1) if self.k[i] == ":" else i

    def s_function(self, i: int) -> int:
        k = self.k
        i += 2 if k[i + 1] == "&" else 1
        i = self.function_rest(i + 1)
        if k[i] != "{":
            raise Bad(i, f"expected a body, saw {k[i]}")
        return self.block(i)

    def heritage(self, i: int) -> int:
        k = self.k
        for word in ("extends", "implements"):
            if k[i] == word:
                i = self.name(i + 1)
                while k[i] == ",":
                    i = self.name(i + 1)
        return i

    def s_class(self, i: int) -> int:
        k = self.k
        while k[i] in ("abstract", "final", "readonly"):
            i += 1
        kind = k[i]
        if kind not in ("class", "interface", "trait", "enum"):
            raise Bad(i, f"expected class, saw {kind}")
        i += 1
        if k[i] not in ("id", "enum"):
            raise Bad(i, f"expected a name, saw {k[i]}")
        i += 1
        if kind == "enum" and k[i] == ":":
            i = self.type(i + 1)
        i = self.heritage(i)
        if k[i] != "{":
            raise Bad(i, f"expected a class body, saw {k[i]}")
        self.members(i, kind)
        return self.m[i] + 1

    def s_attributed(self, i: int) -> int:
        i = self.attributes(i)
        if self.k[i] in ("class", "abstract", "final", "readonly", "interface", "trait", "enum", "function", "fn", "static", "const"):
            return self.statement(i)
        raise Bad(i, f"did not expect {self.k[i]} here")

    def members(self, i: int, kind: str) -> None:
        k, end = self.k, self.m[i]
        i += 1
        while i < end:
            i = self.member(i, kind)
        if i > end:
            raise Bad(end, "member runs on")

    def member(self, i: int, kind: str) -> int:
        k = self.k
        i = self.attributes(i)
        if k[i] == "use":
            i = self.name(i + 1)
            while k[i] == ",":
                i = self.name(i + 1)
            if k[i] == "{":
                self.adaptations(i)
                return self.m[i] + 1
            return self.end(i)
        if k[i] == "case" and kind == "enum":
            if k[i + 1] not in _NAMES:
                raise Bad(i + 1, f"expected a name, saw {k[i + 1]}")
            i += 2
            return self.end(self.expr(i + 1) if k[i] == "=" else i)
        first, seen = i, set()
        while k[i] in _MODIFIERS and not (k[i] in ("readonly", "static") and k[i + 1] == "("):
            if k[i] in seen:
                raise Bad(i, f"{k[i]} twice")
            seen.add(k[i])
            i += 1
            if k[i] == "(" and k[i + 1] == "id" and k[i - 1] in ("public", "protected", "private"):
                i = self.m[i] + 1
        if len(seen & {"public", "protected", "private"}) > 1 and k[first + 1] != "(" and k[i - 1] != ")":
            raise Bad(i, "two visibilities")
        if k[i] == "const":
            i += 1
            if not (k[i] in _NAMES and k[i + 1] == "="):
                i = self.type(i)
            return self.s_const(i - 1)
        if k[i] == "function":
            i += 2 if k[i + 1] == "&" else 1
            if k[i] not in _NAMES:
                raise Bad(i, f"expected a name, saw {k[i]}")
            i = self.function_rest(i + 1)
            if k[i] == "{":
                return self.block(i)
            return self.need(i, ";")
        if i == first:
            raise Bad(i, f"did not expect {k[i]} here")
        if k[i] != "variable":
            i = self.type(i)
        while True:
            i = self.need(i, "variable")
            if k[i] == "=":
                i = self.expr(i + 1)
            if k[i] == "{":
                self.hooks(i)
                return self.m[i] + 1
            if k[i] != ",":
                return self.need(i, ";")
            i += 1

    def hooks(self, i: int) -> None:
        k, end = self.k, self.m[i]
        i += 1
        while i < end:
            i = self.attributes(i)
            if k[i] == "final":
                i += 1
            if k[i] == "&":
                i += 1
            i = self.need(i, "id")
            if k[i] == "(":
                i = self.group(i, self.parameter)
            if k[i] == "=>":
                i = self.need(self.expr(i + 1), ";")
            elif k[i] == "{":
                i = self.block(i)
            else:
                i = self.need(i, ";")

    def adaptations(self, i: int) -> None:
        k, end = self.k, self.m[i]
        i += 1
        while i < end:
            while k[i] not in ("insteadof", "as"):
                if k[i] not in _NAMES and k[i] not in ("qid", "::"):
                    raise Bad(i, f"did not expect {k[i]} here")
                i += 1
            while k[i] != ";":
                if k[i] not in _NAMES and k[i] not in ("qid", ","):
                    raise Bad(i, f"did not expect {k[i]} here")
                i += 1
            i += 1


_KNOWN: dict[tuple[str, ...], bool | Bad] = {}
_COMPOUND = {
    ";": lambda p, i: i + 1,
    "close": lambda p, i: i + 1,
    "inline": lambda p, i: i + 1,
    "open": lambda p, i: i + 1,
    "{": _Span.block,
    "if": _Span.s_if,
    "for": _Span.s_for,
    "foreach": _Span.s_foreach,
    "while": _Span.s_while,
    "do": _Span.s_do,
    "switch": _Span.s_switch,
    "try": _Span.s_try,
    "declare": _Span.s_declare,
    "namespace": _Span.s_namespace,
    "use": _Span.s_use,
    "const": _Span.s_const,
    "function": _Span.s_function,
    "static": lambda p, i: p.var_list(i + 1, True),
    "class": _Span.s_class,
    "abstract": _Span.s_class,
    "final": _Span.s_class,
    "readonly": _Span.s_class,
    "interface": _Span.s_class,
    "trait": _Span.s_class,
    "enum": _Span.s_class,
    "attr": _Span.s_attributed,
    "__halt_compiler": lambda p, i: len(p.k) - 1,
}


def allow_depth(tokens: int) -> None:
    """Lets a recursive grammar go as deep as so many tokens can nest; calls of Python functions take no C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 40 * tokens))


def brackets(kinds: list[str]) -> dict[int, int]:
    """Partner of each bracket; raises Bad at the first that has none."""
    partner: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for i, t in enumerate(kinds):
        if t in _CLOSER:
            stack.append((_CLOSER[t], i))
        elif t in (")", "]", "}"):
            if not stack or stack[-1][0] != t:
                raise Bad(i, f"did not expect {t} here")
            j = stack.pop()[1]
            partner[j] = i
    if stack:
        raise Bad(len(kinds) - 1, "block never closed, saw EOF")
    return partner


def kinds_error(kinds: list[str], partner: dict[int, int]) -> str | None:
    """Message of the first grammar error of code kinds (neither white space nor comments) with matched brackets, or None."""
    if not any(x in ("open", "open_echo") for x in kinds):
        return "no opening tag"
    allow_depth(len(kinds))
    try:
        _Span([*kinds, "eof"], partner).statements(0, len(kinds))
    except Bad as e:
        return e.message
    except (IndexError, KeyError):
        return "unexpected end"
    return None


def first_error(text: str, toks: list[tuple[str, int, int]] | None = None) -> tuple[int, str] | None:
    """(character offset, message) of the first grammar error, or None. Text without any opening tag is an error."""
    toks = tokens(text) if toks is None else toks
    code = [x for x in toks if x[0] not in _SKIP]
    kinds = [x[0] for x in code]
    if not any(x in ("open", "open_echo") for x in kinds):
        return 0, "no opening tag"
    if kinds[-1] == "bad":
        return code[-1][1], "not a token"
    kinds.append("eof")
    code.append(("eof", len(text), len(text)))
    allow_depth(len(kinds))
    try:
        _Span(kinds, brackets(kinds)).statements(0, len(kinds) - 1)
    except Bad as e:
        at = min(e.at, len(code) - 1)
        return code[at][1], e.message
    except (IndexError, KeyError):
        return len(text), "unexpected end"
    return None
