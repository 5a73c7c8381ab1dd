"""What a file declares and refers to, and issues that need no other file (S9-S11, J15, W2-W4, W11, A8, A12, 2.7).

`facts(nodes, ...)` walks the flat node table once. Facts are rows of one
schema; the cross-file rules join them, see operators/level0.py.
"""

from __future__ import annotations

from collections import defaultdict

from quarrylens.functions.types import BUILTINS
from quarrylens.php.builtins import SUPERGLOBALS
from quarrylens.php.flow import Flow, empty_statements
from quarrylens.php.parser import locate
from quarrylens.php.style import mask

SCHEMA = ("file_id long, path string, kind string, cls string, fn string, name string, key string, alt string, line int, col int, "
          "low int, high int, flags string, extra string")
_CLASSLIKE = frozenset(("Class", "Interface", "Trait", "Enum"))
_SPECIAL = frozenset(("self", "static", "parent"))
_EXITS = frozenset(("exit", "die"))


class _File:
    def __init__(self, file_id: int, path: str, text: str, nodes: list):
        self.file_id, self.path, self.nodes = file_id, path, nodes
        self.at = locate(text)
        self.kids: dict[int, list[int]] = defaultdict(list)
        n = len(nodes)
        self.ns, self.cls, self.fn = [-1] * n, [-1] * n, [-1] * n
        for x in nodes:
            i, p = x[0], x[1]
            if p >= 0:
                self.kids[p].append(i)
                kind = nodes[p][4]
                self.ns[i] = p if kind == "Namespace" else self.ns[p]
                self.cls[i] = p if kind in _CLASSLIKE else self.cls[p]
                self.fn[i] = p if kind in ("Function", "InterfaceMethod") else self.fn[p]
        self.aliases: dict[tuple[int, str], dict[str, str]] = defaultdict(dict)
        for x in nodes:
            if x[4] == "Use" and x[6]:
                self.aliases[self.ns[x[0]], x[8]][(x[7] or "").lower()] = x[6]
        self.out: list[tuple] = []

    # -- names
    def space(self, i: int) -> str:
        s = self.ns[i]
        return (self.nodes[s][6] or "") if s >= 0 else ""

    def resolve(self, i: int, name: str) -> str:
        """First segment by alias, else the namespace; key in lower case."""
        low = name.lower()
        if low in _SPECIAL:
            return low
        if name.startswith("\\"):
            return low[1:]
        head, _, rest = name.partition("\\")
        space = self.space(i)
        if head.lower() == "namespace" and rest:
            return f"{space}\\{rest}".strip("\\").lower()
        target = self.aliases[self.ns[i], "class"].get(head.lower())
        if target:
            return (target + ("\\" + rest if rest else "")).lower()
        return f"{space}\\{name}".strip("\\").lower()

    def class_key(self, c: int) -> str | None:
        if c < 0:
            return None
        name = self.nodes[c][6]
        if not name:
            return f"class@{self.path}:{c}"
        return f"{self.space(c)}\\{name}".strip("\\").lower()

    def add(self, kind: str, i: int, name=None, key=None, alt=None, low=None, high=None, flags=None, extra=None) -> None:
        line, col = self.at(self.nodes[i][5])
        f = self.fn[i]
        while f >= 0 and not self.nodes[f][6]:
            f = self.fn[f]
        self.out.append((self.file_id, self.path, kind, self.class_key(self.cls[i]), self.nodes[f][6] if f >= 0 else None, name, key, alt, line, col, low, high, flags, extra))

    def issue(self, code: str, i: int, message: str) -> None:
        self.add("issue", i, message, code)

    # -- walks
    def bounds(self, f: int) -> tuple[int, int]:
        """A10: least and most arguments; -1 for a variadic list."""
        params = [self.nodes[k] for k in self.kids[f] if self.nodes[k][2] == "param"]
        least = 0
        for n, p in enumerate(params):
            if not {"optional", "variadic"} & set((p[8] or "").split()):
                least = n + 1
        return least, -1 if any("variadic" in (p[8] or "") for p in params) else len(params)

    def arguments(self, i: int) -> tuple[int, bool]:
        """Number of arguments, and whether it is not known."""
        args = [self.nodes[k] for k in self.kids[i] if self.nodes[k][2] == "argument"]
        return len(args), any(a[4] in ("UnpackedArgument", "FirstClassCallable", "NamedArgument") for a in args)

    def types_in(self, i: int, declared: str | None) -> None:
        if not declared:
            return
        for w in declared.replace("?", "|").replace("(", "|").replace(")", "|").replace("&", "|").split("|"):
            w = w.strip()
            if w and w.lower().lstrip("\\") not in BUILTINS and w.lower() not in _SPECIAL:
                self.add("ref_class", i, w, self.resolve(i, w), extra="type")

    def walk(self) -> None:
        for x in self.nodes:
            i, kind, name, value, extra = x[0], x[4], x[6], x[7], x[8]
            if kind in _CLASSLIKE:
                key = self.class_key(i)
                heirs = [(self.nodes[k][2], self.resolve(k, self.nodes[k][6])) for k in self.kids[i] if self.nodes[k][2] in ("extends", "implements", "uses")]
                self.add("decl_class", i, name, key, flags=extra, extra=kind.lower())
                if kind == "Enum":
                    self.enum_values(i)
                for n, (role, target) in enumerate(heirs):
                    self.add("edge", i, role, key, target, low=n, extra=kind.lower())
                    self.add("ref_class", i, target, target, extra=role)
            elif kind in ("Function", "InterfaceMethod") and x[2] == "method":
                low, high = self.bounds(i)
                owner = self.class_key(x[1])
                body = any(self.nodes[k][2] == "body" for k in self.kids[i])
                flags = (extra or "") + (" interface" if kind == "InterfaceMethod" else "")
                self.add("decl_method", i, name, (name or "").lower(), owner, low, high, flags.strip(), value)
                self.types_in(i, value)
                if "abstract" in flags.split():
                    if body:
                        self.issue("PHPStan.Level0.ClassModel", i, f"Abstract method {name} has a body")
                    if "private" in flags.split() and self.nodes[x[1]][4] != "Trait":
                        self.issue("PHPStan.Level0.ClassModel", i, f"Abstract method {name} is private")
                    if "final" in flags.split():
                        self.issue("PHPStan.Level0.ClassModel", i, f"Abstract method {name} is final")
                    if self.nodes[x[1]][4] == "Class" and "abstract" not in (self.nodes[x[1]][8] or "").split():
                        self.issue("PHPStan.Level0.ClassModel", i, f"Class {self.nodes[x[1]][6]} is not abstract but has the abstract method {name}")
            elif kind == "Function" and name:
                low, high = self.bounds(i)
                self.add("decl_function", i, name, f"{self.space(i)}\\{name}".strip("\\").lower(), None, low, high)
                self.types_in(i, value)
            elif kind == "Param":
                self.types_in(i, value)
            elif kind == "Property":
                self.add("decl_property", i, name, (name or "").lower(), flags=extra, extra=value)
                self.types_in(i, value)
            elif kind == "Constant":
                if x[2] == "const":
                    self.add("decl_const", i, name, name, flags=extra)
                else:
                    self.add("decl_constant", i, name, f"{self.space(i)}\\{name}".strip("\\").lower())
            elif kind == "EnumCase":
                self.add("decl_const", i, name, name, flags="case")
            elif kind == "New" and name and name.lower() not in _SPECIAL:
                n, unknown = self.arguments(i)
                self.add("new", i, name, self.resolve(i, name), low=n, flags="unknown" if unknown else None)
                self.add("ref_class", i, name, self.resolve(i, name), extra="new")
            elif kind == "Attribute" and name:
                self.add("ref_class", i, name, self.resolve(i, name), extra="attribute")
            elif kind == "Name" and x[2] == "type":
                self.add("ref_class", i, name, self.resolve(i, name), extra="catch")
            elif kind == "Binary" and extra == "instanceof":
                right = [self.nodes[k] for k in self.kids[i] if self.nodes[k][2] == "right"]
                if right and right[0][4] == "Name" and right[0][6].lower() not in _SPECIAL:
                    self.add("ref_class", i, right[0][6], self.resolve(i, right[0][6]), extra="instanceof")
            elif kind == "FunctionCall" and name:
                n, unknown = self.arguments(i)
                low = name.lower().lstrip("\\")
                full = low if name.startswith("\\") else (self.aliases[self.ns[i], "function"].get(low) or f"{self.space(i)}\\{name}").strip("\\").lower()
                self.add("call", i, name, full, low, n, flags="unknown" if unknown else None)
                if low in ("class_exists", "interface_exists", "function_exists", "method_exists", "defined"):
                    for k in self.kids[i]:
                        for v in self.kids[k]:
                            if self.nodes[v][4] in ("StringLiteral", "String"):
                                self.add("guard", i, low, (self.nodes[v][7] or "").replace("\\\\", "\\").lstrip("\\").lower())
                            elif self.nodes[v][4] == "ClassConstFetch" and self.nodes[v][6] == "class" and self.nodes[v][8]:
                                self.add("guard", i, low, self.resolve(i, self.nodes[v][8]))
                if low in ("sprintf", "printf") and not unknown:
                    self.printf(i, n)
            elif kind == "MethodCall" and name and not name.startswith("$"):
                base = self.nodes[self.kids[i][0]] if self.kids[i] else None
                if base and base[4] == "Variable" and base[6] == "this" and self.cls[i] >= 0:
                    n, unknown = self.arguments(i)
                    self.add("this_call", i, name, name.lower(), self.class_key(self.cls[i]), n, flags="unknown" if unknown else None)
            elif kind == "StaticCall" and name and extra and not name.startswith("$"):
                n, unknown = self.arguments(i)
                low = extra.lower()
                owner = self.class_key(self.cls[i]) if low in ("self", "static") else low if low == "parent" else self.resolve(i, extra)
                self.add("static_call", i, name, name.lower(), owner, n, flags="unknown" if unknown else None)
                if low not in _SPECIAL:
                    self.add("ref_class", i, extra, self.resolve(i, extra), extra="static call")
            elif kind == "ClassConstFetch" and extra and name:
                low = extra.lower()
                if low not in _SPECIAL:
                    self.add("ref_class", i, extra, self.resolve(i, extra), extra="constant")
                if name != "class" and not name.startswith("$") and low != "parent":
                    self.add("const_fetch", i, name, name, self.class_key(self.cls[i]) if low in ("self", "static") else self.resolve(i, extra))
            elif kind == "PropertyFetch" and name and not name.startswith("$"):
                base = self.nodes[self.kids[i][0]] if self.kids[i] else None
                if base and base[4] == "Variable" and base[6] == "this" and self.cls[i] >= 0:
                    self.add("this_property", i, name, name.lower(), self.class_key(self.cls[i]))
            elif kind == "Include":
                self.include(i)
            elif kind == "Array":
                self.duplicate_keys(i)
            elif kind in ("If", "ElseIf", "While", "DoWhile"):
                for k in self.kids[i]:
                    if self.nodes[k][2] == "condition":
                        for j in range(k, self.nodes[k][9] + 1):
                            if self.nodes[j][4] == "Assignment":
                                self.issue("Generic.CodeAnalysis.AssignmentInCondition", j, "Assignment inside a condition")
            elif kind == "Unary" and extra in ("++", "--"):
                kid = self.nodes[self.kids[i][0]] if self.kids[i] else None
                if kid and kid[4] in ("Integer", "StringLiteral", "FunctionCall", "MethodCall"):
                    self.issue("PHPStan.Level0.Language", i, f"{extra} on something that is no variable")
        self.gotos()
        self.unreachable()
        self.variables()
        self.side_effects()
        Flow(self).run()

    def include(self, i: int) -> None:
        """The path of an include that is written out, relative to the file's folder."""
        e = self.nodes[self.kids[i][0]] if self.kids[i] else None
        if e and e[4] == "Concat" and len(self.kids[e[0]]) == 2:
            left, right = (self.nodes[k] for k in self.kids[e[0]])
            if (left[4], (left[6] or "").upper()) != ("Name", "__DIR__"):
                return
            e = right
        if e and e[4] == "StringLiteral" and e[7]:
            parts: list[str] = self.path.split("/")[:-1]
            for p in e[7].split("/"):
                if p == ".." and parts:
                    parts.pop()
                elif p not in ("", ".", ".."):
                    parts.append(p)
            self.add("include", i, e[7], "/".join(parts))

    def printf(self, i: int, n: int) -> None:
        """Placeholders against arguments."""
        first = self.kids[i][0] if self.kids[i] else -1
        lit = self.nodes[self.kids[first][0]] if first >= 0 and self.kids[first] else None
        if lit and lit[4] in ("StringLiteral", "String") and "$" not in (lit[7] or ""):
            want = (lit[7] or "").replace("%%", "").count("%")
            if want > n - 1:
                self.issue("PHPStan.Level0.Invocation", i, f"{want} placeholders but {n - 1} values")

    def duplicate_keys(self, i: int) -> None:
        """Second and later occurrences of a literal key."""
        seen = set()
        for k in self.kids[i]:
            if self.nodes[k][4] == "KeyValue":
                key = self.nodes[self.kids[k][0]]
                if key[4] in ("StringLiteral", "Integer"):
                    v = (key[4], key[7])
                    if v in seen:
                        self.issue("PHPStan.Level0.Language", k, f"Key {key[7]} stands twice")
                    seen.add(v)

    def enum_values(self, i: int) -> None:
        """Cases that share a value; a case of a backed enum needs one."""
        by = defaultdict(list)
        for k in self.kids[i]:
            if self.nodes[k][4] == "EnumCase":
                v = [self.nodes[j] for j in self.kids[k] if self.nodes[j][2] == "value"]
                if bool(v) != bool(self.nodes[i][7]):
                    self.issue("PHPStan.Level0.ClassModel", k, f"Case {self.nodes[k][6]} and the enum's backing do not agree")
                if v and v[0][7] is not None:
                    by[v[0][7]].append(k)
        for v, ks in by.items():
            for k in ks[1:]:
                self.issue("PHPStan.Level0.ClassModel", k, f"Value {v} belongs to several cases")

    def gotos(self) -> None:
        """J7."""
        labels = {x[6] for x in self.nodes if x[4] == "Label"}
        for x in self.nodes:
            if x[4] == "Goto" and x[6] not in labels:
                self.issue("PHPStan.Level0.Language", x[0], f"No label {x[6]}")

    def ends(self, i: int) -> bool:
        """Whether a statement never goes on to the next."""
        x = self.nodes[i]
        if x[4] in ("Return", "Goto", "Break", "Continue"):
            return True
        if x[4] == "ExpressionStmt" and self.kids[i]:
            e = self.nodes[self.kids[i][0]]
            return e[4] == "Throw" or (e[4] == "FunctionCall" and (e[6] or "").lower() in _EXITS)
        if x[4] == "If":
            parts = [k for k in self.kids[i] if self.nodes[k][4] in ("ElseIf", "Else")]
            if not any(self.nodes[k][4] == "Else" for k in parts):
                return False
            bodies = [[k for k in self.kids[j] if self.nodes[k][2] == "then"] for j in (i, *parts)]
            return all(any(self.ends(k) for k in b) for b in bodies)
        return x[4] == "Block" and any(self.ends(k) for k in self.kids[i])

    def unreachable(self) -> None:
        """Statements after one that ends; nothing below them is looked at."""
        dead_to = -1
        for x in self.nodes:
            i = x[0]
            if i <= dead_to:
                continue
            groups = defaultdict(list)
            for k in self.kids[i]:
                if self.nodes[k][2] in ("body", "then", "finally") and self.nodes[k][4] not in ("Function", "Class", "Label", "Use"):
                    groups[self.nodes[k][2]].append(k)
            if x[4] in ("SwitchCase", "Namespace", "Match", "Declare"):
                continue
            for ks in groups.values():
                over = False
                for k in ks:
                    if over:
                        self.issue("Generic.CodeAnalysis.UnreachableCode", k, "This statement is never reached")
                        dead_to = max(dead_to, self.nodes[k][9])
                    over = over or self.ends(k)

    def variables(self) -> None:
        """Variables read before anything defines them; branches define by union."""
        for x in self.nodes:
            if x[4] not in ("Function", "InterfaceMethod") or "arrow" in (x[8] or "").split():
                continue
            f = x[0]
            if any(k for k in self.kids[f] if self.nodes[k][2] == "body") is False:
                continue
            known = set(SUPERGLOBALS)
            known |= {self.nodes[k][6].lstrip("$") for k in self.kids[f] if self.nodes[k][2] == "param"} | {self.nodes[k][6] for k in self.kids[f] if self.nodes[k][2] == "use" and self.nodes[k][6]}
            free = False
            reported = set()
            i = f + 1
            while i <= x[9]:
                y = self.nodes[i]
                if y[4] in ("Function", "InterfaceMethod") and "arrow" not in (y[8] or "").split():
                    i = y[9] + 1
                    continue
                if y[4] in _CLASSLIKE:
                    i = y[9] + 1
                    continue
                if y[4] == "Param":
                    known.add(y[6].lstrip("$"))
                elif y[4] == "Assignment":
                    # The value is read before the target is written.
                    t, v = self.kids[i][0], self.kids[i][-1]
                    for j in range(t, self.nodes[t][9] + 1):
                        if self.nodes[j][4] == "Variable" and self.nodes[j][6]:
                            n = self.nodes[j][6]
                            if y[8] == "=" or y[8] == "??=":
                                for k in range(v, self.nodes[v][9] + 1):
                                    z = self.nodes[k]
                                    if z[4] == "Variable" and z[6] == n and n not in known and n not in reported and not self.exempt(k):
                                        reported.add(n)
                                        self.issue("PHPStan.Level0.Variables", k, f"Variable ${n} is not defined")
                                known.add(n)
                elif y[4] == "Foreach":
                    for k in self.kids[i]:
                        if self.nodes[k][2] in ("value", "key"):
                            known |= {self.nodes[j][6] for j in range(k, self.nodes[k][9] + 1) if self.nodes[j][4] == "Variable" and self.nodes[j][6]}
                elif y[4] == "Catch" and y[6]:
                    known.add(y[6])
                elif y[4] in ("StaticVarDecl",):
                    known.add(y[6])
                elif y[4] == "Global":
                    known |= {self.nodes[j][6] for j in range(i, y[9] + 1) if self.nodes[j][4] == "Variable" and self.nodes[j][6]}
                elif y[4] == "FunctionCall" and (y[6] or "").lower() in ("extract", "parse_str"):
                    free = True
                elif y[4] == "Include" or (y[4] == "Variable" and y[6] is None):
                    free = True
                elif y[4] == "Variable" and y[6] not in known and y[6] not in reported and not free and not self.exempt(i):
                    reported.add(y[6])
                    self.issue("PHPStan.Level0.Variables", i, f"Variable ${y[6]} is not defined")
                i += 1

    def exempt(self, i: int) -> bool:
        """Reads that are fine without a definition: isset, empty, ??, references to functions."""
        p, child = self.nodes[i][1], i
        while p >= 0:
            x = self.nodes[p]
            if x[4] == "FunctionCall" and (x[6] or "").lower() in ("isset", "empty", "unset", "preg_match", "compact"):
                return True
            if x[4] == "Binary" and x[8] == "??" and self.kids[p] and self.kids[p][0] == child:
                return True
            if x[4] in ("ExpressionStmt", "Return", "Function", "If", "Foreach"):
                return False
            p, child = x[1], p
        return False

    def side_effects(self) -> None:
        """A file either declares symbols or has effects."""
        declares = effects = None
        for x in self.nodes:
            if x[1] >= 0 and self.nodes[x[1]][4] not in ("Namespace",):
                continue
            if x[4] in _CLASSLIKE or (x[4] == "Function" and x[6]) or x[4] == "Constant":
                declares = x[0] if declares is None else declares
            elif x[4] == "Echo" or (x[4] == "ExpressionStmt" and self.kids[x[0]] and self.nodes[self.kids[x[0]][0]][4] not in ("Assignment", "Name", "Throw")):
                call = self.nodes[self.kids[x[0]][0]] if x[4] == "ExpressionStmt" else None
                if not (call and call[4] == "FunctionCall" and (call[6] or "").lower() == "define"):
                    effects = x[0] if effects is None else effects
        if declares is not None and effects is not None:
            self.issue("PSR1.Files.SideEffects", effects, "The file declares symbols and has side effects")


def facts(file_id: int, path: str, text: str, nodes: list) -> list[tuple]:
    """Rows of SCHEMA for one file."""
    f = _File(file_id, path, text, nodes)
    f.walk()
    for line, col, message in empty_statements(mask(text)):
        f.out.append((file_id, path, "issue", None, None, message, "Generic.CodeAnalysis.EmptyStatement", None, line, col, None, None, None, None))
    return f.out
