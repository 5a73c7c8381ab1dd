"""Types that flow through a function, and where they do not fit (W12, J11, A9: return, property and argument types).

Inference goes forward once through a function's statements. A variable has the
type it was last given on the straight path; one that is assigned inside a
branch or loop has no known type after it. What cannot be told is unknown, and
unknown fits everything, so each row is a mismatch that the text shows.
"""

from __future__ import annotations

from quarrylens.functions import types

Atoms = frozenset
_BOOL_OPS = frozenset("== != === !== < > <= >= && || and or xor instanceof !".split())
_LITERALS = {"StringLiteral": "string", "String": "string", "InterpolatedString": "string", "Heredoc": "string", "Concat": "string", "Integer": "int", "Float": "float",
             "Boolean": "bool", "Null": "null", "Array": "array"}
_CASTS = {"int": "int", "integer": "int", "bool": "bool", "boolean": "bool", "float": "float", "double": "float", "real": "float", "string": "string", "binary": "string", "array": "array", "object": "object"}
_BRANCHES = frozenset("If ElseIf Else While DoWhile For Foreach Switch SwitchCase Try Catch Match MatchArm Ternary".split())
#: Return types of some functions of the language (fixed values).
_RETURNS = {"count": "int", "strlen": "int", "sprintf": "string", "implode": "string", "explode": "array", "array_map": "array", "array_filter": "array", "array_keys": "array", "str_replace": "string",
            "trim": "string", "strtolower": "string", "strtoupper": "string", "intdiv": "int", "in_array": "bool", "is_array": "bool", "is_null": "bool", "isset": "bool", "empty": "bool", "array_merge": "array"}


def declared(f, i: int, text: str | None) -> Atoms:
    """Atoms of a written type with class names resolved; self and static are the class itself."""
    out = set()
    for a in types.parse(text):
        if a.startswith("class:"):
            name = a[6:]
            key = (f.class_key(f.cls[i]) or "") if name in ("self", "static") else "" if name == "parent" else f.resolve(i, "\\" + name if "\\" in name and (text or "").lstrip("?").startswith("\\") else name)
            if not key:
                return frozenset()
            a = f"class:{key}"
        out.add(a)
    return frozenset(out)


class Flow:
    def __init__(self, f):
        self.f, self.nodes, self.kids = f, f.nodes, f.kids
        self.properties: dict[tuple[int, str], Atoms] = {}
        self.returns: dict[tuple[int, str], Atoms] = {}
        for x in self.nodes:
            if x[4] == "Property":
                self.properties[x[1], x[6]] = declared(f, x[0], x[7])
            elif x[2] == "method":
                self.returns[x[1], (x[6] or "").lower()] = declared(f, x[0], x[7])
            elif x[4] == "Param" and {"public", "protected", "private", "readonly"} & set((x[8] or "").split()):
                self.properties[self.f.cls[x[0]], x[6].lstrip("$")] = declared(f, x[0], x[7])

    def infer(self, i: int, env: dict[str, Atoms]) -> Atoms:
        x = self.nodes[i]
        kind = x[4]
        if kind in _LITERALS:
            return frozenset({_LITERALS[kind]})
        kids = self.kids[i]
        if kind == "Variable":
            if x[6] == "this":
                key = self.f.class_key(self.f.cls[i])
                return frozenset({f"class:{key}"}) if key and self.nodes[self.f.cls[i]][4] != "Trait" else frozenset()
            return env.get(x[6], frozenset())
        if kind == "New":
            return frozenset({f"class:{self.f.resolve(i, x[6])}"}) if x[6] and x[6].lower() not in ("self", "static", "parent") else frozenset()
        if kind == "TypeCast":
            return frozenset({_CASTS[x[6]]}) if x[6] in _CASTS else frozenset()
        if kind == "Function":
            return frozenset({"class:closure"})
        if kind in ("Binary", "Unary") and x[8] in _BOOL_OPS:
            return frozenset({"bool"})
        if kind == "Binary" and x[8] == "??" and len(kids) == 2:
            a, b = self.infer(kids[0], env), self.infer(kids[1], env)
            return (a - {"null"}) | b if a and b else frozenset()
        if kind == "Binary" and x[8] in ("+", "-", "*") and len(kids) == 2:
            a, b = self.infer(kids[0], env), self.infer(kids[1], env)
            if a == b == {"int"}:
                return frozenset({"int"})
            return frozenset({"float"}) if a and b and (a | b) <= {"int", "float"} else frozenset()
        if kind == "Ternary":
            parts = [self.infer(k, env) for k in kids if self.nodes[k][2] in ("then", "else")]
            return frozenset().union(*parts) if len(parts) == 2 and all(parts) else frozenset()
        if kind == "Match":
            parts = [self.infer(k, env) for a in kids if self.nodes[a][4] == "MatchArm" for k in self.kids[a] if self.nodes[k][2] == "value"]
            return frozenset().union(*parts) if parts and all(parts) else frozenset()
        if kind == "Assignment" and kids:
            return self.infer(kids[-1], env) if x[8] == "=" else frozenset()
        if kind == "FunctionCall" and x[6]:
            r = _RETURNS.get(x[6].lower().lstrip("\\"))
            return frozenset({r}) if r else frozenset()
        if kind in ("MethodCall", "PropertyFetch") and kids and self.nodes[kids[0]][4] == "Variable" and self.nodes[kids[0]][6] == "this":
            c = self.f.cls[i]
            return (self.returns if kind == "MethodCall" else self.properties).get((c, (x[6] or "").lower() if kind == "MethodCall" else x[6]), frozenset())
        return frozenset()

    # -- checks
    def compare(self, code: str, i: int, want: Atoms, got: Atoms, what: str) -> None:
        """A certain mismatch is an issue; one that hangs on the hierarchy is left to the join."""
        if types.fits(want, got):
            return
        text = f"{what}: {types.display(got)} does not fit {types.display(want)}"
        if not types.fits(want, got, lambda a, b: True):
            self.f.issue(code, i, text)
            return
        targets = "|".join(sorted(a[6:] for a in want if a.startswith("class:")) + (["traversable"] if "iterable" in want else []))
        for a in sorted(got):
            if a.startswith("class:") and not types.fits(want, frozenset({a})):
                self.f.add("subtype", i, text, a[6:], targets, extra=code)

    def run(self) -> None:
        for x in self.nodes:
            if x[4] == "Function" and "arrow" not in (x[8] or "").split() and any(self.nodes[k][2] == "body" for k in self.kids[x[0]]):
                self.function(x[0])

    def function(self, fn: int) -> None:
        x = self.nodes[fn]
        env: dict[str, Atoms] = {}
        for k in self.kids[fn]:
            p = self.nodes[k]
            if p[2] == "param":
                a = declared(self.f, k, p[7])
                flags = (p[8] or "").split()
                env[p[6].lstrip("$")] = frozenset({"array"}) if "variadic" in flags else a
                for d in self.kids[k]:
                    if self.nodes[d][2] == "default":
                        v = self.infer(d, {})
                        if v != {"null"} and a:
                            self.compare("A.ARG.TYPE", d, a, v, f"Default of {p[6]}")
        want = declared(self.f, fn, x[7]) if x[7] else None
        generator = any(self.nodes[j][4] == "Yield" and self.f.fn[j] == fn for j in range(fn, x[9] + 1))
        # Variables that a branch, loop or reference may change have no type behind it.
        shaky: set[str] = set()
        for j in range(fn + 1, x[9] + 1):
            y = self.nodes[j]
            if y[4] == "Assignment" and self.f.fn[j] == fn:
                p = y[1]
                while p != fn and self.nodes[p][4] not in _BRANCHES:
                    p = self.nodes[p][1]
                if p != fn:
                    shaky |= {self.nodes[k][6] for k in range(self.kids[j][0], self.nodes[self.kids[j][0]][9] + 1) if self.nodes[k][4] == "Variable"}
            elif y[4] in ("Foreach", "Catch", "Global", "StaticVarDecl", "Include") or (y[4] == "Unary" and y[8] in ("++", "--", "&")):
                shaky |= {self.nodes[k][6] for k in range(j, y[9] + 1) if self.nodes[k][4] == "Variable"} if y[4] != "Foreach" else {
                    self.nodes[k][6] for h in self.kids[j] if self.nodes[h][2] in ("key", "value") for k in range(h, self.nodes[h][9] + 1)}
        for v in shaky:
            env.pop(v, None)
        # Narrowing makes types of guarded variables unknown: those read in conditions.
        for j in range(fn + 1, x[9] + 1):
            y = self.nodes[j]
            if self.f.fn[j] != fn:
                continue
            if y[2] == "condition" and y[4] != "Assignment":
                for k in range(j, y[9] + 1):
                    if self.nodes[k][4] == "Variable" and self.nodes[k][6] != "this":
                        env[self.nodes[k][6]] = frozenset()
                        shaky.add(self.nodes[k][6])
            if y[4] == "Assignment" and y[8] == "=":
                t, v = self.kids[j][0], self.kids[j][-1]
                got = self.infer(v, env)
                target = self.nodes[t]
                if target[4] == "Variable" and target[6] and target[6] not in shaky:
                    env[target[6]] = got
                elif target[4] == "PropertyFetch" and self.kids[t] and self.nodes[self.kids[t][0]][6] == "this" and self.nodes[self.kids[t][0]][4] == "Variable":
                    prop = self.properties.get((self.f.cls[j], target[6]), frozenset())
                    if prop and got:
                        self.compare("A.PROP.TYPE", j, prop, got, f"Property {target[6]}")
            elif y[4] == "Return" and want is not None and not generator:
                values = self.kids[j]
                if not values:
                    if want and not want & {"void", "never", "mixed"}:
                        self.f.issue("A.RETURN.TYPE", j, f"Return without a value does not fit {types.display(want)}")
                elif want == {"void"}:
                    self.f.issue("A.RETURN.TYPE", j, "A value is returned where void is declared")
                else:
                    got = self.infer(values[0], env)
                    if want and got:
                        self.compare("A.RETURN.TYPE", j, want, got, "Return")
            elif y[4] == "MethodCall" and self.kids[j] and self.nodes[self.kids[j][0]][4] == "Variable" and self.nodes[self.kids[j][0]][6] == "this":
                self.arguments(j, env)

    def arguments(self, j: int, env: dict[str, Atoms]) -> None:
        """Argument types of calls on $this, by position or name, against the class's own method."""
        c = self.f.cls[j]
        method = next((k for k in self.kids[c] if self.nodes[k][2] == "method" and (self.nodes[k][6] or "").lower() == (self.nodes[j][6] or "").lower()), None) if c >= 0 else None
        if method is None:
            return
        params = [self.nodes[k] for k in self.kids[method] if self.nodes[k][2] == "param"]
        at = 0
        for k in self.kids[j]:
            a = self.nodes[k]
            if a[2] != "argument":
                continue
            if a[4] in ("UnpackedArgument", "FirstClassCallable"):
                return
            if a[4] == "NamedArgument":
                p = next((p for p in params if p[6] == f"${a[6]}"), None)
            else:
                p = params[at] if at < len(params) else (params[-1] if params and "variadic" in (params[-1][8] or "") else None)
                at += 1
            if p is not None and self.kids[k]:
                got, want = self.infer(self.kids[k][0], env), declared(self.f, p[0], p[7])
                if got and want:
                    self.compare("A.ARG.TYPE", k, want, got, f"Argument {p[6]}")


def empty_statements(masked: str) -> list[tuple[int, int, str]]:
    """(line, column, message) of stray semicolons and of control headers that end in one; `masked` as of style.mask."""
    import re

    out = []
    for m in re.finditer(r"(?:(?<=[;{}])|\A<\?php)\s*(;)|\b(if|while|for|elseif|foreach)\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))\s*(;)", masked):
        at = m.start(1) if m[1] else m.start(4)
        if m[2] == "while" and re.search(r"\}\s*$", masked[: m.start()]):
            continue  # the end of do ... while
        if m[1] and re.search(r"\bfor\s*\([^()]*$", masked[max(0, at - 120) : at]):
            continue
        line = masked.count("\n", 0, at) + 1
        out.append((line, at - masked.rfind("\n", 0, at), f"Empty body of {m[2]}" if m[2] else "Empty statement"))
    return out
