"""Style rules that need tokens or nodes of one file, and the fixers (F9, W8-W10, W13, 2.8).

`mask` blanks comments and strings once, keeping lines and columns; the rules
read that. Every rule is a function (File) -> iterable of (line, column,
message, fixable, subject kind, subject name) under its code; RULES and FIXERS
are the registries, and both may be added to.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cached_property

from quarrylens.php.lexer import tokens
from quarrylens.php.parser import locate, parse

Issue = tuple[int, int, str, bool, str | None, str | None]
_BLANK = frozenset(("comment", "doc", "str", "dq", "heredoc", "inline"))


def mask(text: str, toks: list | None = None) -> str:
    """`text` with what is no code blanked: comments, strings but for their quotes, heredocs, text outside tags."""
    out, last = [], 0
    for kind, a, b in tokens(text) if toks is None else toks:
        out.append(text[last:a])
        s = text[a:b]
        if kind in _BLANK:
            s = re.sub(r"[^\r\n]", " ", s) if kind not in ("str", "dq") or len(s) < 2 else s[0] + re.sub(r"[^\r\n]", "_", s[1:-1]) + s[-1]
        out.append(s)
        last = b
    return "".join([*out, text[last:]])


class File:
    """What rules read of one file."""

    def __init__(self, content: str):
        self.content = content

    @cached_property
    def toks(self):
        return tokens(self.content)

    @cached_property
    def lines(self) -> list[str]:
        return mask(self.content, self.toks).split("\n") if self.content else []

    @cached_property
    def nodes(self) -> list:
        return parse(self.content, True, self.toks)[0]

    @cached_property
    def at(self):
        return locate(self.content)


RULES: dict[str, Callable[[File], Iterable[Issue]]] = {}
FIXERS: dict[str, Callable[[str], str]] = {}


def rule(code: str):
    """Registers a rule under its code."""
    def register(f):
        RULES[code] = f
        return f
    return register


def fixer(code: str):
    def register(f):
        FIXERS[code] = f
        return f
    return register


def pascal(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in name.split("_"))


#: Methods whose names the language gives (fixed values).
MAGIC = frozenset("__construct __destruct __call __callStatic __get __set __isset __unset __sleep __wakeup __serialize __unserialize __toString __invoke __set_state __clone __debugInfo __autoload".split())


@rule("PSR1.Classes.ClassDeclaration.PascalCase")
def class_name(f: File):
    for n in f.nodes:
        if n[4] == "Class" and n[6] and n[6] != pascal(n[6]):
            yield *f.at(n[5]), f"Class name {n[6]} must be in PascalCase", False, "class", n[6]


@rule("PSR1.Classes.ClassConstantName")
def constant_name(f: File):
    for n in f.nodes:
        if n[4] == "Constant" and n[2] == "const" and f.nodes[n[1]][4] in ("Class", "Trait"):
            if not re.fullmatch(r"[A-Z][A-Z0-9_]*", n[6]) or n[6].endswith("_") or "__" in n[6]:
                yield *f.at(n[5]), f"Constant name {n[6]} must be in upper case with single underscores", False, None, None


@rule("PSR1.Methods.CamelCapsMethodName")
def method_name(f: File):
    for n in f.nodes:
        if n[2] == "method" and n[6] not in MAGIC and not re.fullmatch(r"_*[A-Za-z][^\W_]*", n[6]):
            yield *f.at(n[5]), f"Method name {n[6]} must be in camel caps", False, None, None


@rule("PSR1.Classes.ClassInstantiation")
def instantiation(f: File):
    """`new Name` without parentheses, on the same or a later line."""
    code = [t for t in f.toks if t[0] not in ("ws", "comment", "doc")]
    for i, (kind, a, _) in enumerate(code[:-2]):
        if kind == "new" and code[i + 1][0] in ("id", "qid", "static") and code[i + 2][0] != "(":
            yield *f.at(a), "An instance must be made with parentheses", True, None, None


@rule("PSR12.Classes.ClosingBraceOnOwnLine")
def closing_brace(f: File):
    """Closing braces of classes and methods stand alone on their line."""
    for m in _closers(f):
        line, col = f.at(m)
        text = f.lines[line - 1]
        if text[: col - 1].strip() or text[col:].strip(" \t\r;,)") not in ("", "?>"):
            yield line, col, "A closing brace must be on its own line", True, None, None


def _closers(f: File) -> list[int]:
    """Offsets of closing braces of class-likes and named functions."""
    code = [t for t in f.toks if t[0] not in ("ws", "comment", "doc")]
    out, stack, pending = [], [], False
    for i, (kind, a, _) in enumerate(code):
        if kind in ("class", "interface", "trait", "enum") and i and code[i - 1][0] not in ("::", "new", "->"):
            pending = True
        elif kind == "function" and i + 1 < len(code) and code[i + 1][0] not in ("(", "&"):
            pending = True
        elif kind == "{":
            stack.append(pending)
            pending = False
        elif kind == ";":
            pending = False
        elif kind == "}" and stack and stack.pop():
            out.append(a)
    return out


@rule("PSR12.Methods.VisibilityDeclared")
def visibility(f: File):
    for n in f.nodes:
        if n[4] == "Function" and n[2] == "method" and not {"public", "protected", "private"} & set((n[8] or "").split()):
            yield *f.at(n[5]), f"Method {n[6]} must declare its visibility", False, None, None


_KEYWORD = re.compile(r"(?<![\w$>:])(if|elseif|for|foreach|while|switch|catch|match)([ \t]*)\(")
_BRACE = re.compile(r"\)([ \t]*)\{")
_CALL_SPACE = re.compile(r"(?<![\w$>:\\])(?!(?:if|elseif|else|for|foreach|while|switch|catch|match|function|fn|return|echo|print|and|or|xor|new|array|list|use|static|case|instanceof|yield|throw|clone|include|require|include_once|require_once|declare|isset|empty|unset|exit|die|do|in|as)\b)([a-z_]\w*)[ \t]+\((?=[^)]*\)\s*;)")


@rule("PSR12.ControlStructures.ControlStructureSpacing")
def control_spacing(f: File):
    for no, text in enumerate(f.lines, 1):
        for m in _KEYWORD.finditer(text):
            if m[2] != " ":
                yield no, m.start(1) + 1, f"One space must follow {m[1]}", True, None, None
        for m in _BRACE.finditer(text):
            if m[1] != " ":
                yield no, m.start() + 1, "One space must precede the brace", True, None, None
        for m in _CALL_SPACE.finditer(text):
            yield no, m.start(1) + 1, f"No space between {m[1]} and its parenthesis", True, None, None


@rule("Generic.Formatting.DisallowMultipleStatements")
def multiple_statements(f: File):
    for no, text in enumerate(f.lines, 1):
        if text.count(";") < 2:
            continue
        depth = n = 0
        for col, c in enumerate(text, 1):
            if c in "([":
                depth += 1
            elif c in ")]":
                depth = max(0, depth - 1)
            elif c == ";" and not depth:
                n += 1
                if n == 2:
                    yield no, col, "Only one statement a line", False, None, None


_CALL = re.compile(r"[A-Za-z_\x80-\U0010ffff]\w*\(")


def _bad_comma(inner: str) -> int:
    """Place of the first comma with wrong spaces at the top level of an argument list, or -1."""
    depth = 0
    for i, c in enumerate(inner):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            if inner[i - 1 : i] in (" ", "\t") or (inner[i + 1 : i + 2] != " " and i + 1 < len(inner)) or inner[i + 1 : i + 3] == "  ":
                return i
    return -1


def _paren_end(text: str, i: int) -> int:
    depth = 0
    for j in range(i, len(text)):
        if text[j] in "([{":
            depth += 1
        elif text[j] in ")]}":
            depth -= 1
            if not depth:
                return j
    return -1


@rule("Generic.Functions.FunctionCallArgumentSpacing")
def argument_spacing(f: File):
    for no, text in enumerate(f.lines, 1):
        if "," not in text or "(" not in text:
            continue
        past = 0
        for m in _CALL.finditer(text):
            if m.start() < past or re.search(r"\bfunction\s+&?\s*$", text[: m.start()]):
                continue
            end = _paren_end(text, m.end() - 1)
            if end < 0:
                continue
            past = end
            k = _bad_comma(text[m.end() : end])
            if k >= 0:
                yield no, m.end() + k + 1, "One space after a comma and none before it", True, None, None


@rule("Generic.Arrays.DisallowLongArraySyntax")
def long_array(f: File):
    """Arrays written with the word; only where a root statement is one, as a program's roots are statements this is rare."""
    for n in f.nodes:
        if n[4] == "Array" and n[8] == "array" and n[1] < 0:
            yield *f.at(n[5]), "Use the short array syntax", False, None, None


# ---------------------------------------------------------------- fixers
def _recode(content: str, change: Callable[[str], str]) -> str:
    """`change` applied to code only: what `mask` blanks is put back as it was."""
    keep: list[str] = []
    out, last = [], 0
    for kind, a, b in tokens(content):
        if kind in _BLANK:
            out.append(content[last:a] + f"\x00{len(keep)}\x00")
            keep.append(content[a:b])
            last = b
    text = change("".join([*out, content[last:]]))
    return re.sub("\x00(\\d+)\x00", lambda m: keep[int(m[1])], text)


@fixer("PSR12.Files.EndFileNewline")
def fix_newline(content: str) -> str:
    return content if content.endswith("\n") else content + "\n"


@fixer("PSR12.ControlStructures.ElseIfDeclaration")
def fix_else_if(content: str) -> str:
    return _recode(content, lambda t: re.sub(r"\belse[ \t]+if\b", "elseif", t))


@fixer("PSR12.ControlStructures.ControlStructureSpacing")
def fix_control_spacing(content: str) -> str:
    def change(t: str) -> str:
        t = _KEYWORD.sub(r"\1 (", t)
        return _CALL_SPACE.sub(r"\1(", _BRACE.sub(") {", t))
    return _recode(content, change)


@fixer("PSR12.Classes.OpenBraceOnOwnLine")
def fix_class_brace(content: str) -> str:
    out = []
    for x in content.split("\n"):
        m = re.match(r"^([ \t]*)((?:class|interface|trait|enum) [^{]*?)[ \t]*\{[ \t]*(\r?)$", x)
        out += [m[1] + m[2] + m[3], m[1] + "{" + m[3]] if m else [x]
    return "\n".join(out)


@fixer("PSR12.Classes.ClosingBraceOnOwnLine")
def fix_closing_brace(content: str) -> str:
    f = File(content)
    for a in sorted(_closers(f), reverse=True):
        line, col = f.at(a)
        text = f.content.split("\n")[line - 1]
        before = text[: col - 1]
        if before.strip():
            indent = re.match(r"[ \t]*", text)[0]
            content = content[:a].rstrip(" \t") + "\n" + indent + content[a:]
    return content


@fixer("Generic.Functions.FunctionCallArgumentSpacing")
def fix_argument_spacing(content: str) -> str:
    f = File(content)
    lines = content.split("\n")
    for no, col, *_ in sorted(argument_spacing(f), reverse=True):
        while True:
            masked = File("\n".join(lines)).lines[no - 1]
            text = lines[no - 1]
            bad = next((c for n, c, *_ in argument_spacing(File("\n".join(lines))) if n == no), None)
            if bad is None:
                break
            head, tail = text[: bad - 1].rstrip(" \t"), text[bad:].lstrip(" \t")
            fresh = head + ", " + tail
            if fresh == text or masked == fresh:
                break
            lines[no - 1] = fresh
    return "\n".join(lines)


def check(content: str, codes: Iterable[str] | None = None) -> list[tuple]:
    """(line, column, message, fixable, subject kind, subject name, code) of each issue; F2 chooses the codes."""
    f = File(content)
    return [(*i, code) for code in (RULES if codes is None else codes) if code in RULES for i in RULES[code](f)]


def apply_fixers(content: str, codes: Iterable[str]) -> tuple[str, list[str]]:
    """Content after each code's fixer once, in code order, and the codes that changed something."""
    done = []
    for code in sorted(set(codes)):
        fix = FIXERS.get(code)
        fresh = fix(content) if fix else content
        if fresh != content:
            done.append(code)
            content = fresh
    return content, done
