"""Problem 7: source files that do not parse.

Every PHP, JavaScript, JSON and SQL file is cut into chunks at line ends. Each
chunk becomes a lexer-state map: from every state the lexer can start in, the
state it ends in, the tokens in between, the pairs of brackets and the brackets
left over. Maps combine associatively and are reduced pairwise; the first chunk
starts in the first state of its language. States that nest without bound
(code within strings, heredoc labels) enter a map when a neighbour ends in
them. Chunks are reduced in two steps: within segments of about SEGMENT
characters, which are spread over partitions whatever file they belong to, and
then the maps of a file's segments in order. A file of one segment needs no
second step, so only longer ones are shuffled. The reduced tokens and bracket
pairs are what the local grammar of the language parses, statement by
statement. YAML has its structure in indentation, not in brackets: it has no
maps and is read line by line.

Brackets may nest to any depth. Null content gives no row; an empty text parses in every language but PHP and
JSON, where it has no opening tag or value.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Callable, Hashable
from functools import partial
from operator import itemgetter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import data_grammars, js_grammar
from quarrylens.llm.sources import files, language, language_column
from quarrylens.operators.rowmap import flat_map
from quarrylens.php import grammar
from quarrylens.php.lexer import heredoc_end, tokens
from quarrylens.sources.tables import table

#: Characters a chunk holds at least, but for the last.
CHUNK = 1 << 11
#: Characters a segment holds at least, but for the last.
SEGMENT = 1 << 18
_CLOSE = {"(": ")", "[": "]", "{": "}", "attr": "]"}
_ENDS = {"'": re.compile(r"[^'\\]*(?:\\.[^'\\]*)*'", re.S), "`": re.compile(r"[^`\\]*(?:\\.[^`\\]*)*`", re.S), "/*": re.compile(r".*?\*/", re.S)}
_BRACKETS = frozenset((*_CLOSE, *_CLOSE.values()))
_SKIP = frozenset(("ws", "comment", "doc"))
STATES = ("html", "php", "'", '"', "`", "/*", "halted")


class Summary(NamedTuple):
    """A chunk read from one state: end state, tokens, closers that lack an opener and openers that lack a closer (as
    what closes them and the token's place), pairs of places. None stands for a clash of brackets or what is no token."""

    end: Hashable
    toks: tuple[tuple, ...]
    closers: tuple[tuple[str, int], ...]
    openers: tuple[tuple[str, int], ...]
    pairs: tuple[tuple[int, int], ...]


class Map(dict):
    """Summaries by start state, for `states` at once and for others when asked for."""

    def __init__(self, states: tuple, make: Callable[[Hashable], Summary | None], made: dict | None = None):
        super().__init__(((s, make(s)) for s in states) if made is None else made)
        self.states, self.make = states, make

    def __missing__(self, state: Hashable) -> Summary | None:
        self[state] = out = self.make(state)
        return out


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """`text` cut after line feeds; the pieces joined are the text."""
    out, i = [], 0
    while len(text) - i > size:
        j = text.find("\n", i + size) + 1
        if not j:
            break
        out.append(text[i:j])
        i = j
    return [*out, text[i:]]


def _join(a: Summary | None, b: Summary | None) -> Summary | None:
    if a is None or b is None:
        return None
    toks, by = b.toks, len(a.toks)
    if toks and by and toks[0] == a.toks[-1] == ("inline",):  # one text outside tags
        toks, by = toks[1:], by - 1
    openers, closers, pairs = list(a.openers), list(a.closers), list(a.pairs)
    for c, i in b.closers:
        if openers:
            kind, j = openers.pop()
            if kind != c:
                return None
            pairs.append((j, i + by))
        else:
            closers.append((c, i + by))
    pairs += [(i + by, j + by) for i, j in b.pairs]
    openers += [(c, i + by) for c, i in b.openers]
    return Summary(b.end, a.toks + toks, tuple(closers), tuple(openers), tuple(sorted(pairs)))


def _quoted(text: str, i: int, depth: int, quote: str) -> tuple[int, Hashable]:
    """(end of a double-quoted string, "") from within it, or (-1, the state in which the text leaves it)."""
    n = len(text)
    while i < n:
        if quote:
            m = _QUOTE[quote].match(text, i)
            if not m:
                return -1, ('"', depth, quote)
            i, quote = m.end(), ""
            continue
        i = (_CODE_RUN if depth else _TEXT_RUN).match(text, i).end()
        if i >= n:
            break
        c = text[i]
        i += 1
        if not depth:
            if c == "\\":
                i += 1
            elif c == '"':
                return i, ""
            elif text[i - 1 : i + 1] in ("{$", "${"):
                depth, i = 1, i + 1
        elif c in "'\"":
            quote = c
        else:
            depth += (c == "{") - (c == "}")
    return -1, ('"', depth, quote) if depth else '"'


_TEXT_RUN, _CODE_RUN = re.compile(r'[^"\\{$]*'), re.compile(r"[^'\"{}]*")
_QUOTE = {"'": _ENDS["'"], '"': re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)}
_HEREDOC = re.compile(r"<<<[ \t]*[\"']?([A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*)")


def php_scan(state: Hashable, text: str, read: dict[int, tuple] | None = None) -> tuple[Hashable, list[tuple[str]]]:
    """(end state or None, kinds of code tokens) of a piece of PHP; a string counts where it ends.

    `read` keeps what follows each place where a comment ends, so that states that meet there share one reading.
    """
    out: list[tuple[str]] = []
    i = 0
    if state == "halted":
        return state, out
    if state == "html":
        if text.startswith("\ufeff"):  # the lexer would take it for the mark at the start of a file
            end, rest = php_scan(state, text[1:])
            return end, rest if rest[:1] == [("inline",)] else [("inline",), *rest]
        return _php_tokens(text, tokens(text), state)
    if isinstance(state, tuple) or state == '"':
        i, rest = _quoted(text, 0, *(state[1:] if isinstance(state, tuple) else (0, "")))
        if i < 0:
            return rest, out
    elif state.startswith("<<<"):
        i = heredoc_end(text, state[3:], 0)
        if i < 0:
            return state, out
    elif state != "php":
        m = _ENDS[state].match(text)
        if not m:
            return state, out
        i = m.end()
    if state not in ("php", "/*"):
        out.append(("heredoc" if str(state).startswith("<<<") else "str" if state == "'" else "dq",))
    if read and i in read:
        toks, shift = read[i]
        toks = toks[bisect_left(toks, i + shift, key=_START) :]
    else:
        toks, shift = tokens("<?php " + text[i:])[1:], 6 - i
        if read is not None:
            for kind, _, j in toks:
                if kind == "comment" or kind == "doc":
                    read.setdefault(j - shift, (toks, shift))
    end, kinds = _php_tokens(text, toks, "php", shift)
    return end, out + kinds


def _php_tokens(text: str, toks: list[tuple[str, int, int]], state: str, shift: int = 0) -> tuple[Hashable, list[tuple[str]]]:
    """End state and kinds of tokens whose places are `shift` off those in the text."""
    out = [_ONE[t[0]] for t in toks if t[0] not in _SKIP]
    if out and out[-1] == ("bad",):
        out.pop()
        i = toks[-1][1] - shift
        if text.startswith("/*", i):
            return "/*", out
        if text[i] == '"':
            return _quoted(text, i + 1, 0, "")[1] or None, out
        m = _HEREDOC.match(text, i)
        return (f"<<<{m[1]}" if m else text[i] if text[i] in _ENDS else None), out
    if out and out[-1] == ("__halt_compiler",):
        return "halted", out
    # Outside tags where the last token is text or a closing tag.
    return (state if not toks else "html" if toks[-1][0] in ("inline", "close") else "php"), out


class _Ones(dict):
    """One tuple a kind, so that the tokens of a long file are references only."""

    def __missing__(self, kind: str) -> tuple[str]:
        self[kind] = out = (kind,)
        return out


_ONE = _Ones()
_START = itemgetter(1)


#: By language: states, the first of which is that of a file's start; states a file may end in; reader of a chunk.
_LEXERS = {
    "php": (STATES, ("html", "php", "halted"), php_scan),
    "js": (js_grammar.STATES, ("start", ("code", False), ("code", True)), js_grammar.scan),
    "json": (data_grammars.JSON_STATES, ("code",), data_grammars.json_scan),
    "sql": (data_grammars.SQL_STATES, ("code",), data_grammars.sql_scan),
}


def _summary(scan: Callable, state: Hashable, text: str) -> Summary | None:
    end, toks = scan(state, text)
    if end is None:
        return None
    closers: list[tuple[str, int]] = []
    openers: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for i, t in enumerate(toks):
        kind = t[0]
        if kind not in _BRACKETS:
            continue
        if kind in _CLOSE:
            openers.append((_CLOSE[kind], i))
        elif not openers:
            closers.append((kind, i))
        elif openers[-1][0] == kind:
            pairs.append((openers.pop()[1], i))
        else:
            return None
    return Summary(end, tuple(toks), tuple(closers), tuple(openers), tuple(sorted(pairs)))


def chunk_map(text: str, labels: tuple[str, ...] = (), lang: str = "php", first: bool = False) -> Map:
    """The lexer-state map of a chunk; `labels` are heredoc labels, each a further state. The first chunk of a file has one state."""
    states, _, scan = _LEXERS[lang]
    if lang == "php" and not first:
        scan = partial(php_scan, read={})
    return Map(states[:1] if first else (*states, *(f"<<<{x}" for x in labels)), lambda s: _summary(scan, s, text))


def combine(a: Map, b: Map) -> Map:
    """Associative: the map of two neighbouring chunks."""

    def make(state: Hashable) -> Summary | None:
        x = a[state]
        return None if x is None else _join(x, b[x.end])

    return Map(a.states, make)


def tree(maps: list[Map]) -> Map:
    """Neighbouring maps reduced pairwise to one."""
    while len(maps) > 1:
        maps = [combine(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def segment_map(lang: str, text: str, first: bool, size: int = CHUNK) -> Map:
    """The map of a segment, from those of its chunks; the first of a file has one state."""
    return tree([chunk_map(c, (), lang, first and not i) for i, c in enumerate(chunks(text, size))])


def settled(lang: str, whole: Map) -> Summary | None:
    """A file's map read from its first state; None unless it ends in a sound state with all brackets matched."""
    states, ends, _ = _LEXERS[lang]
    done = whole[states[0]]
    return done if done is not None and done.end in ends and not done.closers and not done.openers else None


def reduced(lang: str, text: str, size: int = CHUNK) -> Summary | None:
    """The whole text read by reducing its chunks pairwise."""
    return settled(lang, segment_map(lang, text, True, size))


def balanced(text: str, size: int = CHUNK, lang: str = "php") -> bool:
    """Whether text ends in a sound lexer state with all brackets matched, by reducing its chunks."""
    return reduced(lang, text, size) is not None


def statements_failure(lang: str, done: Summary | None) -> tuple[str, str] | None:
    """(stage, message) of what the maps or the local grammar of statements refuse, or None."""
    if done is None:
        return "maps", "not balanced"
    if lang == "php":
        message = grammar.kinds_error([t[0] for t in done.toks], dict(done.pairs))
    else:
        parses = {"js": js_grammar.parses_tokens, "json": data_grammars.json_parses_tokens, "sql": data_grammars.sql_parses_tokens}[lang]
        message = None if parses(list(done.toks), dict(done.pairs)) else "not grammatical"
    return ("statements", message) if message else None


def failure(lang: str | None, text: str, size: int = CHUNK) -> tuple[str, str] | None:
    """(stage, message) where `text` is not grammatical `lang`, or None; languages without a grammar pass."""
    if lang == "yml":
        return None if data_grammars.yaml_parses(text) else ("lines", "not grammatical")
    if lang not in _LEXERS:
        return None
    got = statements_failure(lang, reduced(lang, text.removeprefix("\ufeff"), size))
    if got and lang == "php" and (e := grammar.first_error(text)):  # only for its line
        return got[0], f"line {text.count(chr(10), 0, e[0]) + 1}: {e[1]}"
    return got


def first_failure(lang: str | None, text: str, size: int = CHUNK) -> str | None:
    """Why `text` is not grammatical `lang`, or None."""
    got = failure(lang, text, size)
    return got and got[1]


def _pack(whole: Map, text: str) -> bytes:
    return pickle.dumps((whole.states, dict(whole), text), protocol=5)


def _unpack(lang: str, data: bytes) -> Map:
    """A segment's map; states that only a neighbour brings up are read from its text."""
    states, made, text = pickle.loads(data)
    return Map(states, lambda s: tree([Map((), lambda s, c=c: _summary(_LEXERS[lang][2], s, c)) for c in chunks(text)])[s], made)


def parse_results(spark: SparkSession, sf_dir: str, segment: int = SEGMENT) -> DataFrame:
    """(file_id, project, lang, stage, failure): one row per file with content; failure is null where it parses.

    The stage is what refuses the file: `maps` (no sound end state, or brackets
    that do not match), `statements` (the local grammar) or `lines` (YAML).
    """
    where = "file_id long, project string, lang string, stage string, failure string, no int"

    def cut():
        def rows(file_id, project, path, content):
            lang = language(path)
            parts = chunks(content.removeprefix("\ufeff"), segment) if lang in _LEXERS else ()
            if len(parts) < 2:
                yield file_id, project, lang, *(failure(lang, content) or (None, None)), 0, None
            else:
                for no, part in enumerate(parts):
                    yield file_id, project, lang, None, None, no, part

        return rows

    def read():
        return lambda file_id, project, lang, stage, why, no, part: (
            (file_id, project, lang, stage, why, no, None if part is None else _pack(segment_map(lang, part, not no), part)),)

    def settle():
        def rows(file_id, project, lang, stage, why, maps):
            if maps:
                whole = tree([_unpack(lang, m["data"]) for m in sorted(maps, key=lambda m: m["no"])])
                stage, why = statements_failure(lang, settled(lang, whole)) or (None, None)
            yield file_id, project, lang, stage, why

        return rows

    # Few rows a batch, as one may hold a segment; short files are a few dozen bytes here.
    parts = flat_map(files(spark, sf_dir, "file_id", F.col("case_id").alias("project"), "path", "content"), cut, f"{where}, part string", out_rows=256)
    maps = flat_map(parts.dropDuplicates(["file_id", "no"]), read, f"{where}, data binary", out_rows=256)
    one = maps.groupBy("file_id").agg(*(F.first(c).alias(c) for c in ("project", "lang", "stage", "failure")),
                                      F.collect_list(F.when(F.col("data").isNotNull(), F.struct("no", "data"))).alias("maps"))
    return flat_map(one, settle, "file_id long, project string, lang string, stage string, failure string")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file that does not parse with the stage that refuses it and the first failure."""
    return parse_results(spark, sf_dir).where(F.col("failure").isNotNull())


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content is not grammatical source of the language its extension names."""
    return parse_results(spark, sf_dir).where(F.col("failure").isNotNull()).select("file_id")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per project and language beside the latest scans of file_results and the latest project_reports.

    Reported percentages that are fractions (at most 1 while files failed) count times 100; null ones are derived.
    """
    ours = parse_results(spark, sf_dir).groupBy("project", "lang").agg(
        F.count("*").alias("files"), F.count("failure").alias("failing"))
    scans = table(spark, sf_dir, "file_results", "path", "project", "error_count", "scanned_at").where(F.col("path").isNotNull())
    latest = scans.groupBy("path").agg(
        F.max_by(F.struct("project", "error_count"), F.struct(F.col("error_count").isNotNull(), "scanned_at")).alias("r"))
    theirs = (latest.withColumn("lang", language_column(F.col("path")))
              .groupBy(F.coalesce("r.project", F.split("path", "/")[0]).alias("project"), "lang")
              .agg(F.count("*").alias("scanned_files"), F.count_if(F.col("r.error_count") > 0).alias("scanned_failing")))
    reports = table(spark, sf_dir, "project_reports", "project", "generated_at", "total_files", "failing_files", "compatibility_pct").where(F.col("project").isNotNull())
    derived = (1 - F.col("failing_files") / F.col("total_files")) * 100
    pct = F.when(F.col("compatibility_pct").isNull(), derived).when(
        (F.col("compatibility_pct") <= 1) & (derived > 1), F.col("compatibility_pct") * 100).otherwise(F.col("compatibility_pct"))
    last = reports.withColumn("pct", pct).groupBy("project").agg(F.max_by("pct", "generated_at").alias("reported_pct"))
    return (ours.join(theirs, ["project", "lang"], "left").join(last, "project", "left")
            .select("project", "lang", "files", "failing", F.round(F.lit(100.0) - 100.0 * F.col("failing") / F.col("files"), 2).alias("parse_pct"),
                    "scanned_files", "scanned_failing", F.round("reported_pct", 2).alias("reported_pct")))
