"""PHP's type lattice, as column expressions over arrays of atoms and as Python (1.2, J11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types the language knows (fixed values).
BUILTINS = frozenset("array bool callable false float int iterable mixed never null object resource string true void".split())
#: Documented types and what they stand for (fixed values).
DOC_TYPES = {
    "list": "array", "non-empty-list": "array", "non-empty-array": "array", "class-string": "string", "non-empty-string": "string", "numeric-string": "string",
    "positive-int": "int", "negative-int": "int", "array-key": "int|string", "scalar": "bool|float|int|string", "boolean": "bool", "integer": "int", "double": "float", "number": "float|int",
}


def atoms(declared: Column) -> Column:
    """Sorted distinct atoms of a declared type; `?T` is `null|T`."""
    full = F.when(F.startswith(declared, F.lit("?")), F.concat(F.lit("null|"), F.substr(declared, F.lit(2)))).otherwise(declared)
    return F.array_sort(F.array_distinct(F.filter(F.split(full, r"\|"), lambda x: x != "")))


def accepts(declared: Column, actual: Column) -> Column:
    """Every actual atom fits some declared one; an empty or mixed side accepts all."""
    free = (F.size(declared) == 0) | (F.size(actual) == 0) | F.array_contains(declared, "mixed") | F.array_contains(actual, "mixed")
    fits = lambda d, a: (
        (d == a) | ((d == "float") & (a == "int")) | ((d == "void") & (a == "null")) | ((d == "bool") & a.isin("true", "false"))
        | ((d == "iterable") & (a == "array")) | ((d == "object") & ~a.isin(*sorted(BUILTINS))))
    return free | F.forall(actual, lambda a: F.exists(declared, lambda d: fits(d, a)))


def split_top_level(text: str, separators: str = "|&") -> list[str]:
    """Parts of a type at separators outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "<({[":
            depth += 1
        elif c in ">)}]":
            depth -= 1
        elif c in separators and not depth:
            out.append(text[start:i])
            start = i + 1
    out.append(text[start:])
    return [x.strip() for x in out if x.strip()]


def parse(text: str | None) -> frozenset[str]:
    """Atoms of a written type; class names in lower case with the prefix `class:`. Generic arguments are dropped."""
    text = (text or "").strip()
    while text.startswith("(") and text.endswith(")") and len(split_top_level(text)) == 1:
        text = text[1:-1].strip()
    if not text:
        return frozenset()
    if text.startswith("?"):
        return frozenset({"null"}) | parse(text[1:])
    parts = split_top_level(text)
    if len(parts) > 1:
        return frozenset().union(*map(parse, parts))
    if text.endswith("[]"):
        return frozenset({"array"})
    base = text.split("<", 1)[0].split("{", 1)[0].strip().lstrip("\\")
    key = base.lower()
    if key in DOC_TYPES:
        return frozenset(DOC_TYPES[key].split("|"))
    if key in BUILTINS:
        return frozenset({key})
    return frozenset({f"class:{key}"})


def fits(declared: frozenset[str], actual: frozenset[str], subclass=lambda a, b: False) -> bool:
    """J11 for sets of atoms; `subclass(a, b)` tells whether class a is below class b."""
    if not declared or not actual or "mixed" in declared or "mixed" in actual:
        return True

    def one(d: str, a: str) -> bool:
        if d == a or (d, a) in (("float", "int"), ("void", "null"), ("bool", "true"), ("bool", "false"), ("iterable", "array")):
            return True
        if not a.startswith("class:"):
            return False
        return d == "object" or (d == "iterable" and subclass(a[6:], "traversable")) or (d.startswith("class:") and subclass(a[6:], d[6:]))

    return all(any(one(d, a) for d in declared) for a in actual)


def display(atoms_: frozenset[str]) -> str:
    return "|".join(sorted(a.removeprefix("class:") for a in atoms_))


def bind(text: str, bindings: dict[str, str]) -> str:
    """Template names replaced by what they are bound to."""
    import re

    return re.sub(r"(?<![\w\\])[A-Za-z_]\w*(?![\w\\])", lambda m: bindings.get(m.group(), m.group()), text)
