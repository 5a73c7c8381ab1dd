"""PHP syntax nodes as rows (S9, S10, 1.3): a recursive parser that writes a flat table.

A node is (id, parent, role, ordinal, kind, start, end, name, value, extra).
Children have greater ids than their parents and ids follow the text, so the
descendants of a node are the ids up to its `last`; that makes ancestor and
descendant an interval test instead of a recursion. The grammar check of
grammar.py comes first: text with a grammar error has no nodes.
"""

from __future__ import annotations

from quarrylens.php.grammar import brackets, first_error
from quarrylens.php.lexer import KEYWORDS, line_starts, tokens

_SKIP = frozenset(("ws", "comment", "doc"))
_NAMES = KEYWORDS | {"id"}
_MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
#: Binding powers, weakest first (fixed values of the language).
_POWER = {op: p for p, ops in enumerate((
    ("or",), ("xor",), ("and",), ("= += -= *= /= .= %= &= |= ^= <<= >>= **= ??=".split()), ("?",), ("??",), ("||",), ("&&",), ("|",), ("^",), ("&",),
    ("== != === !== <> <=>".split()), ("< <= > >=".split()), (".",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"), ("instanceof",), ("**",)), 1) for op in (ops if isinstance(ops, (list, tuple)) else ops)}
_ASSIGN = _POWER["="]
_UNARY = _POWER["*"] + 1
_RIGHT = frozenset((_ASSIGN, _POWER["??"], _POWER["**"]))

Node = list  # [id, parent, role, ordinal, kind, at, name, value, extra, last]


class Tree:
    """Nodes of one file; `bodies` False leaves out what stands in function bodies."""

    def __init__(self, text: str, toks, bodies: bool = True):
        self.text, self.bodies = text, bodies
        code = [t for t in toks if t[0] not in _SKIP]
        self.k = [t[0] for t in code] + ["eof"]
        self.at = [t[1] for t in code] + [len(text)]
        self.to = [t[2] for t in code] + [len(text)]
        self.m = brackets(self.k)
        self.nodes: list[Node] = []
        self.docs = {}
        doc = None
        j = 0
        for kind, a, b in toks:
            if kind == "doc":
                doc = text[a:b]
            elif kind not in _SKIP:
                if doc is not None:
                    self.docs[a] = doc
                doc = None
                j += 1

    # -- building
    def add(self, parent: int, role: str, kind: str, i: int, name: str | None = None, value: str | None = None, extra: str | None = None) -> int:
        n = len(self.nodes)
        ordinal = 0
        if parent >= 0:
            ordinal = self.nodes[parent][10]
            self.nodes[parent][10] += 1
        self.nodes.append([n, parent, role, ordinal, kind, self.at[min(i, len(self.at) - 1)], name, value, extra, n, 0])
        return n

    def close(self, n: int) -> None:
        self.nodes[n][9] = len(self.nodes) - 1

    def word(self, i: int) -> str:
        return self.text[self.at[i] : self.to[i]]

    def span(self, i: int, j: int) -> str:
        """Text of tokens i up to j, exclusive."""
        return self.text[self.at[i] : self.to[j - 1]] if j > i else ""

    def wrap(self, n: int, parent: int, role: str, kind: str, name: str | None = None, extra: str | None = None) -> int:
        """A new node in the place of node n, which becomes its first child."""
        old = self.nodes[n]
        fresh = [n, parent, old[2], old[3], kind, old[5], name, None, extra, len(self.nodes), 1]
        for x in self.nodes[n:]:
            x[0] += 1
            x[9] += 1
            if x[1] >= n:
                x[1] += 1
        old[1], old[2], old[3] = n, role, 0
        self.nodes.insert(n, fresh)
        return n

    # -- types and parameters
    def type_end(self, i: int) -> int:
        k = self.k
        if k[i] == "?":
            i += 1
        while True:
            i = self.m[i] + 1 if k[i] == "(" else i + 1
            if k[i] == "|" or (k[i] == "&" and k[i + 1] not in ("variable", "...", "&")):
                i += 1
            else:
                return i

    def attributes(self, i: int, parent: int) -> int:
        while self.k[i] == "attr":
            end = self.m[i]
            j = i + 1
            while j < end:
                if self.k[j] in ("id", "qid"):
                    self.add(parent, "attribute", "Attribute", j, self.word(j))
                    j += 1
                    if self.k[j] == "(":
                        j = self.m[j] + 1
                j += 1
            i = end + 1
        return i

    def params(self, i: int, parent: int) -> int:
        """Parameters of the list at i; the place behind it."""
        k, end = self.k, self.m[i]
        i += 1
        while i < end:
            i = self.attributes(i, parent)
            promoted = []
            while k[i] in ("public", "protected", "private", "readonly", "final"):
                promoted.append(k[i])
                i += 1
                if k[i] == "(" and k[i + 1] == "id":
                    i = self.m[i] + 1
            t = i
            if k[i] not in ("variable", "&", "..."):
                i = self.type_end(i)
            declared = self.span(t, i)
            flags = promoted[:]
            while k[i] in ("&", "..."):
                flags.append("by-reference" if k[i] == "&" else "variadic")
                i += 1
            n = self.add(parent, "param", "Param", i, self.word(i), declared or None)
            i += 1
            if k[i] == "=":
                flags.append("optional")
                i = self.expr(i + 1, n, "default")
            if k[i] == "{":
                i = self.m[i] + 1
            self.nodes[n][8] = " ".join(flags) or None
            self.close(n)
            if k[i] == ",":
                i += 1
        return end + 1

    def arguments(self, i: int, parent: int) -> int:
        k, end = self.k, self.m[i]
        i += 1
        if k[i] == "..." and i + 1 == end:
            self.add(parent, "argument", "FirstClassCallable", i)
            return end + 1
        while i < end:
            name = None
            kind = "Argument"
            if k[i] == "...":
                kind, i = "UnpackedArgument", i + 1
            elif k[i] in _NAMES and k[i + 1] == ":" :
                name, i = self.word(i), i + 2
                kind = "NamedArgument"
            n = self.add(parent, "argument", kind, i, name)
            i = self.expr(i, n, "value")
            self.close(n)
            if k[i] == ",":
                i += 1
        return end + 1

    # -- expressions
    def expr(self, i: int, parent: int, role: str, power: int = 0) -> int:
        k = self.k
        start = len(self.nodes)
        i = self.unary(i, parent, role)
        while True:
            op = k[i]
            p = _POWER.get(op)
            if p is None or p < power:
                return i
            if op == "?":
                n = self.wrap(start, parent, "condition", "Ternary")
                i = self.expr(i + 1, n, "then") if k[i + 1] != ":" else i + 1
                i = self.expr(i + 1, n, "else", p + 1)
            elif p == _ASSIGN:
                n = self.wrap(start, parent, "target", "Assignment", None, op)
                i = self.expr(i + (2 if k[i + 1] == "&" else 1), n, "value", p)
            else:
                n = self.wrap(start, parent, "left", "Concat" if op == "." else "Binary", None, op)
                if op == "instanceof" and k[i + 1] in ("id", "qid", "static"):
                    self.add(n, "right", "Name", i + 1, self.word(i + 1))
                    i += 2
                else:
                    i = self.expr(i + 1, n, "right", p if p in _RIGHT else p + 1)
            self.close(n)

    def unary(self, i: int, parent: int, role: str) -> int:
        k, t = self.k, self.k[i]
        if t in ("!", "~", "@", "+", "-", "&", "++", "--", "print", "clone"):
            n = self.add(parent, role, "Unary", i, None, None, t)
            i = self.expr(i + 1, n, "operand", _UNARY if t not in ("print",) else _ASSIGN)
            self.close(n)
            return i
        if t == "cast":
            n = self.add(parent, role, "TypeCast", i, self.word(i).strip("() \t").lower())
            i = self.expr(i + 1, n, "operand", _UNARY)
            self.close(n)
            return i
        if t in ("throw", "include", "include_once", "require", "require_once"):
            n = self.add(parent, role, "Throw" if t == "throw" else "Include", i, None, None, t)
            i = self.expr(i + 1, n, "operand")
            self.close(n)
            return i
        if t == "yield":
            n = self.add(parent, role, "Yield", i)
            i += 1
            if k[i] == "id" and self.word(i).lower() == "from":
                i += 1
            if k[i] not in (";", ")", "]", ",", "close", "}"):
                i = self.expr(i, n, "value")
                if k[i] == "=>":
                    i = self.expr(i + 1, n, "value")
            self.close(n)
            return i
        start = len(self.nodes)
        i = self.postfix(self.primary(i, parent, role), start, parent)
        if k[i] in ("++", "--"):
            n = self.wrap(start, parent, "operand", "Unary", None, k[i])
            self.close(n)
            i += 1
        return i

    def primary(self, i: int, parent: int, role: str) -> int:
        k, t = self.k, self.k[i]
        if t == "variable":
            self.add(parent, role, "Variable", i, self.word(i)[1:])
            return i + 1
        if t in ("str", "dq", "heredoc", "num"):
            w = self.word(i)
            kind = {"str": "StringLiteral", "dq": "String", "heredoc": "Heredoc"}.get(t) or ("Float" if any(c in w for c in ".eE") and not w.lower().startswith("0x") else "Integer")
            if t == "dq" and "$" in w:
                kind = "InterpolatedString"
            self.add(parent, role, kind, i, None, w[1:-1] if t in ("str", "dq") else w)
            return i + 1
        if t in ("attr", "static", "fn", "function") and self.is_closure(i):
            return self.closure(i, parent, role)
        if t in ("id", "qid", "enum", "readonly") or (t == "static" and k[i + 1] == "::") or (t == "match" and k[i + 1] != "("):
            low = self.word(i).lower()
            kind = {"true": "Boolean", "false": "Boolean", "null": "Null"}.get(low, "Name")
            self.add(parent, role, kind, i, self.word(i))
            return i + 1
        if t == "(":
            j = self.expr(i + 1, parent, role)
            return j + 1
        if t == "[" or (t in ("array", "list") and k[i + 1] == "("):
            n = self.add(parent, role, "Array", i, None, None, None if t == "[" else t)
            i = self.items(i if t == "[" else i + 1, n)
            self.close(n)
            return i
        if t == "new":
            return self.new(i, parent, role)
        if t == "match":
            n = self.add(parent, role, "Match", i)
            body = self.m[i + 1] + 1
            self.expr(i + 2, n, "subject")
            j, end = body + 1, self.m[body]
            while j < end:
                arm = self.add(n, "arm", "MatchArm", j)
                if k[j] == "default" and k[j + 1] in ("=>", ","):
                    j += 1 + (k[j + 1] == ",")
                else:
                    while k[j] != "=>":
                        j = self.expr(j, arm, "condition")
                        j += k[j] == ","
                j = self.expr(j + 1, arm, "value")
                self.close(arm)
                j += k[j] == ","
            self.close(n)
            return end + 1
        if t in ("isset", "empty", "eval", "exit", "die", "unset"):
            n = self.add(parent, role, "FunctionCall", i, t)
            i = self.arguments(i + 1, n) if k[i + 1] == "(" else i + 1
            self.close(n)
            return i
        if t == "$":
            n = self.add(parent, role, "Variable", i, None, None, "dynamic")
            while k[i] == "$":
                i += 1
            if k[i] == "{":
                self.expr(i + 1, n, "name")
                i = self.m[i]
            self.close(n)
            return i + 1
        self.add(parent, role, "Name", i, self.word(i))
        return i + 1

    def is_closure(self, i: int) -> bool:
        while self.k[i] == "attr":
            i = self.m[i] + 1
        return self.k[i] in ("fn", "function") or (self.k[i] == "static" and self.k[i + 1] in ("fn", "function"))

    def closure(self, i: int, parent: int, role: str) -> int:
        k = self.k
        n = self.add(parent, role, "Function", i, None, None, None)
        i = self.attributes(i, n)
        flags = []
        if k[i] == "static":
            flags.append("static")
            i += 1
        arrow = k[i] == "fn"
        flags.append("arrow" if arrow else "closure")
        i += 1
        if k[i] == "&":
            i += 1
        i = self.params(i, n)
        if k[i] == "use":
            for j in range(i + 2, self.m[i + 1]):
                if k[j] == "variable":
                    self.add(n, "use", "Variable", j, self.word(j)[1:])
            i = self.m[i + 1] + 1
        if k[i] == ":":
            j = self.type_end(i + 1)
            self.nodes[n][7] = self.span(i + 1, j)
            i = j
        self.nodes[n][8] = " ".join(flags)
        if arrow:
            i = self.expr(i + 1, n, "body", _ASSIGN)
        else:
            if self.bodies:
                self.block(i, n, "body")
            i = self.m[i] + 1
        self.close(n)
        return i

    def items(self, i: int, parent: int) -> int:
        k, end = self.k, self.m[i]
        i += 1
        while i < end:
            if k[i] == ",":
                i += 1
                continue
            kind = "ArrayItem"
            n = self.add(parent, "item", kind, i)
            if k[i] in ("...", "&"):
                self.nodes[n][8] = k[i]
                i += 1
            i = self.expr(i, n, "value")
            if k[i] == "=>":
                self.nodes[n + 1][2] = "key"
                self.nodes[n][4] = "KeyValue"
                i = self.expr(i + 1 + (k[i + 1] == "&"), n, "value")
            self.close(n)
        return end + 1

    def new(self, i: int, parent: int, role: str) -> int:
        k = self.k
        n = self.add(parent, role, "New", i)
        i = self.attributes(i + 1, n)
        if k[i] in ("class", "readonly", "final"):
            while k[i] != "class":
                i += 1
            if k[i + 1] == "(":
                i = self.arguments(i + 1, n) - 1
            i = self.class_rest(i, n, "class", "Class", None, [])
        else:
            if k[i] == "(":
                self.expr(i + 1, n, "class")
                i = self.m[i] + 1
            elif k[i] in ("variable", "$"):
                self.add(n, "class", "Variable", i, self.word(i).lstrip("$"))
                i += 1
                while k[i] in ("->", "?->", "::") or k[i] == "[":
                    i = self.m[i] + 1 if k[i] == "[" else i + 2
            else:
                self.nodes[n][6] = self.word(i)
                i += 1
            if k[i] == "(":
                i = self.arguments(i, n)
        self.close(n)
        return i

    def postfix(self, i: int, start: int, parent: int) -> int:
        k = self.k
        while True:
            t = k[i]
            if t == "(":
                base = self.nodes[start]
                if base[4] == "Name" and base[9] == start and len(self.nodes) == start + 1:
                    base[4] = "FunctionCall"
                    n = start
                else:
                    n = self.wrap(start, parent, "callee", "FunctionCall")
                i = self.arguments(i, n)
            elif t == "[":
                n = self.wrap(start, parent, "array", "ArrayAccess")
                end = self.m[i]
                if end > i + 1:
                    self.expr(i + 1, n, "index")
                i = end + 1
            elif t in ("->", "?->"):
                j = i + 1
                name = self.word(j) if k[j] in _NAMES or k[j] == "variable" else None
                j = self.m[j] + 1 if k[j] == "{" else j + 1
                if k[j] == "(":
                    n = self.wrap(start, parent, "object", "MethodCall", name)
                    self.nodes[n][5] = self.at[i]
                    i = self.arguments(j, n)
                else:
                    n = self.wrap(start, parent, "object", "PropertyFetch", name)
                    self.nodes[n][5] = self.at[i]
                    i = j
            elif t == "::":
                j = i + 1
                name = self.word(j) if k[j] in _NAMES or k[j] == "variable" else None
                j = self.m[j] + 1 if k[j] == "{" else j + 1
                base = self.nodes[start]
                cls = base[6] if base[4] == "Name" else None
                if k[j] == "(":
                    n = self.wrap(start, parent, "class", "StaticCall", name, cls)
                    i = self.arguments(j, n)
                else:
                    n = self.wrap(start, parent, "class", "ClassConstFetch", name, cls)
                    i = j
            else:
                return i
            self.close(n)

    # -- statements
    def block(self, i: int, parent: int, role: str) -> int:
        """The statements within the braces at i; the place behind them."""
        end, i = self.m[i], i + 1
        while i < end:
            i = self.statement(i, parent, role)
        return end + 1

    def condition(self, i: int, parent: int) -> int:
        self.expr(i + 1, parent, "condition")
        return self.m[i] + 1

    def body(self, i: int, parent: int, role: str, stops: tuple[str, ...]) -> int:
        """A statement, a block, or the colon form up to one of `stops`."""
        k = self.k
        if k[i] == ":":
            i += 1
            while k[i] not in stops:
                i = self.statement(i, parent, role)
            return i
        if k[i] == "{":
            return self.block(i, parent, role)
        return self.statement(i, parent, role)

    def semi(self, i: int) -> int:
        return i + 1 if self.k[i] in (";", "close") else i

    def statement(self, i: int, parent: int, role: str) -> int:
        k, t = self.k, self.k[i]
        if t in (";", "close", "open", "inline"):
            return i + 1
        if t == "{":
            n = self.add(parent, role, "Block", i)
            i = self.block(i, n, "body")
            self.close(n)
            return i
        method = _STATEMENTS.get(t)
        if t == "attr":
            j = i
            while k[j] == "attr":
                j = self.m[j] + 1
            if k[j] in ("fn", "static") or (k[j] == "function" and (k[j + 1] == "(" or k[j + 1] == "&" and k[j + 2] == "(")):
                method = None
            else:
                return self.declaration(i, parent, role)
        if t == "static" and not (k[i + 1] == "variable" and k[i + 2] in ("=", ",", ";", "close")):
            method = None
        if t == "function" and not (k[i + 1] in _NAMES or (k[i + 1] == "&" and k[i + 2] in _NAMES)):
            method = None
        if t in ("enum", "readonly", "match") and not (t == "enum" and k[i + 1] in _NAMES and k[i + 2] in ("{", ":", "implements") or t == "readonly" and k[i + 1] in ("class", "final", "abstract")):
            method = None
        if t == "id" and k[i + 1] == ":":
            self.add(parent, role, "Label", i, self.word(i))
            return i + 2
        if method:
            return method(self, i, parent, role)
        n = self.add(parent, role, "ExpressionStmt", i)
        i = self.semi(self.expr(i, n, "expr"))
        self.close(n)
        return i

    def s_simple(self, i: int, parent: int, role: str) -> int:
        k, t = self.k, self.k[i]
        kind = {"return": "Return", "echo": "Echo", "open_echo": "Echo", "break": "Break", "continue": "Continue", "global": "Global", "goto": "Goto", "const": "Constant", "static": "StaticVarDecl"}[t]
        if t in ("const", "static"):
            i += 1
            while True:
                n = self.add(parent, role, kind, i, self.word(i).lstrip("$"))
                i += 1
                if k[i] == "=":
                    i = self.expr(i + 1, n, "value")
                self.close(n)
                if k[i] != ",":
                    return self.semi(i)
                i += 1
        n = self.add(parent, role, kind, i)
        i += 1
        if t == "goto":
            self.nodes[n][6] = self.word(i)
            i += 1
        while k[i] not in (";", "close"):
            i = self.expr(i, n, "value")
            i += k[i] == ","
        self.close(n)
        return i + 1

    def s_if(self, i: int, parent: int, role: str) -> int:
        k = self.k
        n = self.add(parent, role, "If", i)
        i = self.condition(i + 1, n)
        colon = k[i] == ":"
        i = self.body(i, n, "then", ("elseif", "else", "endif"))
        while k[i] == "elseif":
            e = self.add(n, "elseif", "ElseIf", i)
            i = self.body(self.condition(i + 1, e), e, "then", ("elseif", "else", "endif"))
            self.close(e)
        if k[i] == "else":
            e = self.add(n, "else", "Else", i)
            i = self.body(i + 1, e, "then", ("endif",))
            self.close(e)
        if colon:
            i = self.semi(i + 1)
        self.close(n)
        return i

    def s_loop(self, i: int, parent: int, role: str) -> int:
        k, t = self.k, self.k[i]
        n = self.add(parent, role, {"while": "While", "for": "For", "foreach": "Foreach"}[t], i)
        end = self.m[i + 1]
        j = i + 2
        if t == "while":
            self.expr(j, n, "condition")
        elif t == "foreach":
            j = self.expr(j, n, "subject") + 1
            parts = []
            while j < end:
                parts.append(len(self.nodes))
                j = self.expr(j + (k[j] == "&"), n, "value", _ASSIGN + 1)
                j += k[j] == "=>"
            if len(parts) == 2:
                self.nodes[parts[0]][2] = "key"
        else:
            while j < end:
                if k[j] in (";", ","):
                    j += 1
                    continue
                j = self.expr(j, n, "header")
        i = end + 1
        colon = k[i] == ":"
        i = self.body(i, n, "body", (f"end{t}",))
        if colon:
            i = self.semi(i + 1)
        self.close(n)
        return i

    def s_do(self, i: int, parent: int, role: str) -> int:
        n = self.add(parent, role, "DoWhile", i)
        i = self.body(i + 1, n, "body", ())
        i = self.semi(self.condition(i + 1, n))
        self.close(n)
        return i

    def s_switch(self, i: int, parent: int, role: str) -> int:
        k = self.k
        n = self.add(parent, role, "Switch", i)
        i = self.condition(i + 1, n)
        braces = k[i] == "{"
        end = self.m[i] if braces else -1
        i += 1
        while i != end and k[i] != "endswitch":
            if k[i] not in ("case", "default"):
                i += 1
                continue
            c = self.add(n, "case", "SwitchCase", i, k[i])
            i = self.expr(i + 1, c, "condition") if k[i] == "case" else i + 1
            i += 1
            while i != end and k[i] not in ("case", "default", "endswitch"):
                i = self.statement(i, c, "body")
            self.close(c)
        self.close(n)
        return i + 1 if braces else self.semi(i + 1)

    def s_try(self, i: int, parent: int, role: str) -> int:
        k = self.k
        n = self.add(parent, role, "Try", i)
        i = self.block(i + 1, n, "body")
        while k[i] == "catch":
            c = self.add(n, "catch", "Catch", i)
            end = self.m[i + 1]
            for j in range(i + 2, end):
                if k[j] in ("id", "qid"):
                    self.add(c, "type", "Name", j, self.word(j))
                elif k[j] == "variable":
                    self.nodes[c][6] = self.word(j)[1:]
            i = self.block(end + 1, c, "body")
            self.close(c)
        if k[i] == "finally":
            i = self.block(i + 1, n, "finally")
        self.close(n)
        return i

    def s_declare(self, i: int, parent: int, role: str) -> int:
        n = self.add(parent, role, "Declare", i, self.span(i + 2, self.m[i + 1]))
        i = self.m[i + 1] + 1
        if self.k[i] in (";", "close"):
            i += 1
        else:
            colon = self.k[i] == ":"
            i = self.body(i, n, "body", ("enddeclare",))
            i = self.semi(i + 1) if colon else i
        self.close(n)
        return i

    def s_namespace(self, i: int, parent: int, role: str) -> int:
        k = self.k
        n = self.add(parent, role, "Namespace", i)
        i += 1
        if k[i] != "{":
            self.nodes[n][6] = self.word(i)
            i += 1
        i = self.block(i, n, "body") if k[i] == "{" else self.semi(i)
        self.close(n)
        return i

    def s_use(self, i: int, parent: int, role: str) -> int:
        k = self.k
        i += 1
        what = "class"
        if k[i] in ("function", "const"):
            what, i = k[i], i + 1
        while True:
            prefix = self.word(i).lstrip("\\")
            place = i
            i += 1
            if k[i] == "\\" and k[i + 1] == "{":
                end, i = self.m[i + 1], i + 2
                while i < end:
                    w = what
                    if k[i] in ("function", "const"):
                        w, i = k[i], i + 1
                    name = f"{prefix}\\{self.word(i)}"
                    alias = name.rsplit("\\", 1)[-1]
                    p = i
                    i += 1
                    if k[i] == "as":
                        alias, i = self.word(i + 1), i + 2
                    self.add(parent, role, "Use", p, name, alias, w)
                    i += k[i] == ","
                i = end + 1
            else:
                alias = prefix.rsplit("\\", 1)[-1]
                if k[i] == "as":
                    alias, i = self.word(i + 1), i + 2
                self.add(parent, role, "Use", place, prefix, alias, what)
            if k[i] != ",":
                return self.semi(i)
            i += 1

    def declaration(self, i: int, parent: int, role: str) -> int:
        """A function or class-like, with attributes and modifiers before it."""
        k, first = self.k, i
        holder = self.add(parent, role, "Function", i)
        i = self.attributes(i, holder)
        flags = []
        while k[i] in ("abstract", "final", "readonly"):
            flags.append(k[i])
            i += 1
        node = self.nodes[holder]
        if k[i] == "function":
            i += 1 + (k[i + 1] == "&")
            node[6] = self.word(i)
            i = self.function_rest(i + 1, holder)
        elif k[i] == "const":
            self.nodes.pop()
            if parent >= 0:
                self.nodes[parent][10] -= 1
            return self.s_simple(i, parent, role)
        else:
            kind = {"class": "Class", "interface": "Interface", "trait": "Trait", "enum": "Enum"}[k[i]]
            node[4], node[6] = kind, self.word(i + 1)
            i = self.class_rest(i + 1, holder, None, kind, holder, flags)
        node[5] = self.at[first]
        self.close(holder)
        return i

    def function_rest(self, i: int, n: int) -> int:
        k = self.k
        i = self.params(i, n)
        if k[i] == ":":
            j = self.type_end(i + 1)
            self.nodes[n][7] = self.span(i + 1, j)
            i = j
        if k[i] == "{":
            if self.bodies:
                self.block(i, n, "body")
            return self.m[i] + 1
        return i + 1

    def class_rest(self, i: int, parent: int, role: str | None, kind: str, n: int | None, flags: list[str]) -> int:
        """Heritage and members, from the name (or the word class of an anonymous one)."""
        k = self.k
        if n is None:
            n = self.add(parent, role, kind, i, None, None, "anonymous")
        i += 1
        if k[i] == ":":
            j = self.type_end(i + 1)
            self.nodes[n][7] = self.span(i + 1, j)
            i = j
        while k[i] in ("extends", "implements"):
            what = k[i]
            i += 1
            while True:
                self.add(n, what, "Name", i, self.word(i))
                i += 1
                if k[i] != ",":
                    break
                i += 1
        if flags:
            self.nodes[n][8] = " ".join(flags)
        end = self.m[i]
        i += 1
        while i < end:
            i = self.member(i, n)
        self.close(n)
        return end + 1

    def member(self, i: int, n: int) -> int:
        k, first = self.k, i
        if k[i] == ";":
            return i + 1
        while k[i] == "attr":
            i = self.m[i] + 1
        if k[i] == "use":
            i += 1
            while True:
                self.add(n, "uses", "TraitUse", i, self.word(i))
                i += 1
                if k[i] != ",":
                    break
                i += 1
            return self.m[i] + 1 if k[i] == "{" else i + 1
        if k[i] == "case":
            c = self.add(n, "case", "EnumCase", i, self.word(i + 1))
            i += 2
            if k[i] == "=":
                i = self.expr(i + 1, c, "value")
            self.close(c)
            return i + 1
        flags = []
        while k[i] in _MODIFIERS:
            flags.append(k[i])
            i += 1
            if k[i] == "(" and k[i + 1] == "id":
                i = self.m[i] + 1
        extra = " ".join(flags) or None
        if k[i] == "function":
            place = i
            i += 1 + (k[i + 1] == "&")
            f = self.add(n, "method", "InterfaceMethod" if self.nodes[n][4] == "Interface" else "Function", place, self.word(i), None, extra)
            self.attributes(first, f)
            i = self.function_rest(i + 1, f)
            self.close(f)
            return i
        if k[i] == "const":
            i += 1
            declared = None
            if not (k[i] in _NAMES and k[i + 1] == "="):
                j = self.type_end(i)
                declared, i = self.span(i, j), j
            while True:
                c = self.add(n, "const", "Constant", i, self.word(i), declared, extra)
                i = self.expr(i + 2, c, "value")
                self.close(c)
                if k[i] != ",":
                    return i + 1
                i += 1
        declared = None
        if k[i] != "variable":
            j = self.type_end(i)
            declared, i = self.span(i, j), j
        while True:
            p = self.add(n, "property", "Property", i, self.word(i)[1:], declared, extra)
            i += 1
            if k[i] == "=":
                i = self.expr(i + 1, p, "default")
            self.close(p)
            if k[i] == "{":
                return self.m[i] + 1
            if k[i] != ",":
                return i + 1
            i += 1


_STATEMENTS = {
    **dict.fromkeys(("return", "echo", "open_echo", "break", "continue", "global", "goto", "const", "static"), Tree.s_simple),
    **dict.fromkeys(("while", "for", "foreach"), Tree.s_loop), "if": Tree.s_if, "do": Tree.s_do, "switch": Tree.s_switch, "try": Tree.s_try, "declare": Tree.s_declare,
    "namespace": Tree.s_namespace, "use": Tree.s_use, **dict.fromkeys(("function", "class", "abstract", "final", "readonly", "interface", "trait", "enum"), Tree.declaration),
}


def parse(text: str, bodies: bool = True, toks: list | None = None) -> tuple[list[Node], tuple[int, str] | None, Tree | None]:
    """(nodes in order, first error or None, the tree)."""
    toks = tokens(text) if toks is None else toks
    error = first_error(text, toks)
    if error:
        return [], error, None
    tree = Tree(text, toks, bodies)
    i, n = 0, len(tree.k) - 1
    namespace = -1
    while i < n:
        if tree.k[i] == "namespace" and namespace >= 0:
            tree.close(namespace)
            namespace = -1
        before = len(tree.nodes)
        i = tree.statement(i, namespace, "stmt" if namespace < 0 else "body")
        if len(tree.nodes) > before and tree.nodes[before][4] == "Namespace" and tree.k[i - 1] == ";":
            namespace = before  # a namespace without braces holds what follows
    if namespace >= 0:
        tree.close(namespace)
    return tree.nodes, None, tree


def locate(text: str):
    """Function from a character offset to (line, column), both from 1."""
    from bisect import bisect_right

    starts = line_starts(text)

    def at(offset: int) -> tuple[int, int]:
        line = bisect_right(starts, offset)
        return line, offset - starts[line - 1] + 1

    return at
