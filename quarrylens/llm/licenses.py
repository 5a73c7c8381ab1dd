"""Problem 4: licence of each source file and repository.

License notices are found through an inverted index of token shingles that
occur in one template only; a candidate is confirmed by aligning the token
sequences, with its coverage and the clauses that differ. Names of licences
count in any spelling: ids, titles and the usual short forms, with a version
only where one is given, and "or later" only where it stands. A name is
confirmed the same way: the words around it must align to a granting phrase,
with nothing but filler between and no negation before, or it must stand alone
like a title; a name in other prose is no evidence.

Ids offered as a choice are joined by OR; several others by AND, as a conflict.
Files without evidence, or that only point to their project's licence, take the
repository's answer. Terms that are not among the references give UNKNOWN, as
does a repository without evidence. Null content is no evidence; a file with
several rows counts once; repeated rows change nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.scan import comment_lines
from quarrylens.llm.sources import language
from quarrylens.operators.rowmap import flat_map
from quarrylens.session import spread
from quarrylens.sources.tables import table

UNKNOWN = "UNKNOWN"
#: Tokens of a shingle, and share of a template's tokens that must align.
SHINGLE, COVERAGE = 3, 0.8
#: Group of a text that names terms which are no known licence.
OTHER = "?"

#: Usual spellings besides ids and titles (fixed values). "mit" and "isc" are words elsewhere, so their case matters there.
SPELLINGS = {
    "MIT": r"(?:The )?\bMIT\b(?: Licen[cs]e)?|\bExpat\b(?: Licen[cs]e)?",
    "ISC": r"\bISC\b(?: Licen[cs]e)?",
    "Apache-2.0": r"(?i:\b(?:the )?Apache(?: Software)?[- ]?(?:Licen[cs]e)?,?[- ]?(?:v(?:ersion|\.)? ?)?2(?:\.0)?\b|\bASL ?2(?:\.0)?\b)",
    "BSD-2-Clause": r"(?i:\bBSD[- ]2[- ]Clause(?: Licen[cs]e)?|\b(?:2|two)[- ]clause BSD(?: Licen[cs]e)?|\b(?:Simplified|Free) ?BSD(?: Licen[cs]e)?)",
    "BSD-3-Clause": r"(?i:\bBSD[- ]3[- ]Clause(?: Licen[cs]e)?|\b(?:3|three)[- ]clause BSD(?: Licen[cs]e)?|\b(?:New|Modified|Revised) BSD(?: Licen[cs]e)?)",
    "MPL-2.0": r"(?i:\bMPL[- ]?v?\.? ?2(?:\.0)?\b|\bMozilla Public Licen[cs]e,?(?: v(?:ersion|\.)?)? ?2(?:\.0)?\b)",
    "Proprietary": r"(?i:\bproprietary\b)",
}
_GNU = re.compile(
    r"\b(?:GNU )?(?P<kind>(?:Affero |Lesser |Library )?General Public Licen[cs]e|[AL]?GPL)(?:[- ,]*(?:v(?:ersion|\.)? ?)?(?P<version>[123])(?:\.0)?)?"
    r"(?P<later>\+|[- ,]+(?:\(?at your option\)? )?or (?:\(?at your option\)? )?(?:any )?(?:later|newer)(?: version)?|-or-later)?(?P<only>[- ]only)?(?!\w|\.\d)", re.I)
_OTHER_TERMS = re.compile(r"(?:\b(?:licensed|released|distributed|published|covered)\b.{0,40}?\b(?:under|by)\b|spdx-license-identifier:|@licen[cs]e\b|\blicen[cs]e:)", re.I)
_POINTER = re.compile(r"\b(?:see|read|in|refer to|consult)\b.{0,40}\blicen[cs]e\b.{0,60}\b(?:shipped|beside|with this|distributed|details|full|project|root|file)\b|\bfile licen[cs]e\b|\bthe licen[cs]e (?:shipped|file)\b", re.I)
_CHOICE = re.compile(r"^[\s,;)\"']*(?:\b(?:or|oder|ou)\b|/|\|\|?)[\s(\"']*(?:(?:the|under the|at your option)\s+)*$", re.I)
_OFFER = re.compile(r"\b(?:choose|choice|either|whichever|at your option|dual[- ]licen[cs]ed|pick)\b", re.I)
#: Phrases that grant, read up to a name and from a name on (fixed values).
_GRANTS = tuple(tuple(p.split()) for p in (
    "licensed under", "licenced under", "relicensed under", "released under", "distributed under", "published under", "available under", "offered under", "provided under",
    "governed by", "covered by", "subject to", "licensed as", "protected by", "terms of", "choose between", "choice of", "dual licensed", "either", "spdx license identifier", "license", "licence",
    "licenses", "licences", "source is", "code is", "file is", "software is", "program is", "work is", "package is", "closed and"))
_GRANTED = tuple(tuple(p.split()) for p in ("licensed", "code", "software", "source", "all rights reserved", "license applies", "applies", "whichever suits", "at your option"))
#: Words that may stand between a phrase and the name, and between names that are listed.
_FILLER = frozenset("a an the this that these its our your of under to by in terms conditions term license licence version either both and or as well oder ou at option only".split())
_NEGATION = re.compile(r"\b(?:not|never|no|nor|cannot|isn|aren|wasn|without|longer|formerly|previously|unlike|except|instead|incompatible|once|was|were)\b", re.I)
_WORD = re.compile(r"[^\W_]+")
_CONTEXT = re.compile(r"(?:spdx-license-identifier:|@licen[cs]e\b)([^\n]*)", re.I)

_STOP = re.compile(r"[.;](?:\s|\Z)")
#: Name and version of a package, as in the first line of a built file.
_BANNER = re.compile(r"\bv?\d+\.\d[\d.]*\s*\|\s*$")


def _aligns(words: list[str], phrase: tuple[str, ...]) -> bool:
    """Whether `phrase` is read from the start of `words` with nothing but filler skipped."""
    k = 0
    for w in words:
        if w == phrase[k]:
            k += 1
            if k == len(phrase):
                return True
        elif w not in _FILLER:
            return False
    return False


Group = tuple[str, ...]  # ids of one statement; more than one are a choice


class Matcher:
    """Finds licences in text, from rows (license_id, title, notice) of license_refs."""

    def __init__(self, refs: list[tuple[str, str, str]]):
        self.ids = {r[0] for r in refs}
        self.by_lower = {r[0].lower(): r[0] for r in refs}
        self.templates = {r[0]: _WORD.findall((r[2] or "").lower()) for r in refs}
        owners = defaultdict(set)
        for i, t in self.templates.items():
            for k in range(len(t) - SHINGLE + 1):
                owners[tuple(t[k : k + SHINGLE])].add(i)
        self.index = {s: next(iter(o)) for s, o in owners.items() if len(o) == 1}
        exact = sorted({x for r in refs for x in (r[0], r[1]) if x and len(x) > 4}, key=len, reverse=True)
        self.exact = re.compile("|".join(rf"(?<![\w-]){re.escape(x)}(?![\w+-])(?!\.\d)" for x in exact), re.I) if exact else None
        self.exact_id = {x.lower(): r[0] for r in refs for x in (r[0], r[1]) if x}
        self.spellings = [(i, re.compile(p)) for i, p in SPELLINGS.items() if i in self.ids]
        self.groups = lru_cache(50_000)(self._groups)

    # -- notices
    def notices(self, text: str) -> list[tuple[str, float, str]]:
        """(license_id, coverage, altered clauses) of each notice in the text."""
        tokens = _WORD.findall(text.lower())
        votes = Counter(self.index.get(tuple(tokens[k : k + SHINGLE])) for k in range(len(tokens) - SHINGLE + 1))
        votes.pop(None, None)
        scored = []
        for i in votes:
            t = self.templates[i]
            blocks = SequenceMatcher(None, t, tokens, autojunk=False).get_matching_blocks()
            # Typing errors: a run of as many other tokens in between aligns where the words are near.
            hit = sum(b.size for b in blocks)
            for a, b in zip(blocks, blocks[1:]):
                gap_t, gap_x = t[a.a + a.size : b.a], tokens[a.b + a.size : b.b]
                if len(gap_t) == len(gap_x) <= 2:
                    hit += sum(sorted(p) == sorted(q) or SequenceMatcher(None, p, q).ratio() > 0.8 for p, q in zip(gap_t, gap_x))
            cover = hit / max(1, len(t))
            if cover >= COVERAGE:
                used = [b for b in blocks if b.size >= SHINGLE]
                lo, hi = used[0].b, used[-1].b + used[-1].size
                inner = tokens[lo:hi]
                altered = "; ".join(" ".join(t[a:b]) + " > " + " ".join(inner[c:d]) for op, a, b, c, d in SequenceMatcher(None, t, inner, autojunk=False).get_opcodes() if op != "equal")
                scored.append((cover * len(t) / max(len(t), hi - lo), cover, lo, hi, i, altered))
        scored.sort(key=lambda s: (-s[0], s[4]))
        kept: list = []
        for s in scored:
            if all(s[3] <= k[2] or s[2] >= k[3] for k in kept):
                kept.append(s)
        return [(s[4], round(s[1], 3), s[5]) for s in kept]

    # -- names
    def names(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, license_id or OTHER) of each named licence, in order."""
        found: list[tuple[int, int, str]] = []
        for m in self.exact.finditer(text) if self.exact else ():
            found.append((m.start(), m.end(), self.exact_id[m.group().lower()]))
        for m in _CONTEXT.finditer(text):
            for w in re.finditer(r"(?<![\w.+-])(?:mit|isc)(?![\w.+-])", m[1], re.I):
                i = self.by_lower.get(w.group().lower())
                if i:
                    found.append((m.start(1) + w.start(), m.start(1) + w.end(), i))
        for i, p in self.spellings:
            found += [(m.start(), m.end(), i) for m in p.finditer(text)]
        for m in _GNU.finditer(text):
            if not m["version"]:
                continue
            kind = m["kind"].lower()
            family = "AGPL" if kind.startswith(("aff", "agpl")) else "LGPL" if kind.startswith(("les", "lib", "lgpl")) else "GPL"
            i = f"{family}-{m['version']}.0-{'or-later' if m['later'] else 'only'}"
            found.append((m.start(), m.end(), i if i in self.ids else OTHER))
        found.sort(key=lambda f: (f[0] - f[1], f[0]))
        kept: list[tuple[int, int, str]] = []
        for f in found:
            if all(f[1] <= k[0] or f[0] >= k[1] for k in kept):
                kept.append(f)
        return sorted(kept)

    def confirmed(self, text: str, named: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Those of `named` whose surroundings align to a granting phrase, or that stand alone."""
        kept: list[tuple[int, int, str]] = []
        for k, (a, b, i) in enumerate(named):
            lo = max(text.rfind(". ", 0, a), text.rfind("\n", 0, a), text.rfind("; ", 0, a)) + 1
            hi = min(x for x in (text.find("\n", b), *(m.start() for m in _STOP.finditer(text, b)), len(text)) if x >= 0)
            if k and kept and kept[-1] == named[k - 1] and set(_WORD.findall(text[named[k - 1][1] : a].lower())) <= _FILLER and ". " not in text[named[k - 1][1] : a]:
                kept.append(named[k])
                continue
            before, after = text[lo:a], _WORD.findall(text[b:hi].lower())
            words = _WORD.findall(before.lower())
            alone = not set(words) - _FILLER and not set(after) - _FILLER or bool(_BANNER.search(before))
            granted = any(_aligns(words[::-1], p[::-1]) for p in _GRANTS) or any(_aligns(after, p) for p in _GRANTED)
            if alone or (granted and not _NEGATION.search(before)):
                kept.append(named[k])
        return kept

    def _groups(self, text: str) -> tuple[Group, ...]:
        """What a text offers: one group a statement; a group of OTHER for terms that are not known."""
        out: list[Group] = [(i,) for i, _, _ in self.notices(text)]
        # Lines of a paragraph are joined, but tags stay apart: what stands behind one ends with its line.
        flat = re.sub(r"(?<!\n)\n(?!\n|@|spdx)" if _CONTEXT.search(text) else r"(?<!\n)\n(?!\n)", " ", re.sub(r"[ \t]*\n[ \t]*", "\n", text), flags=re.I)
        named = self.confirmed(flat, self.names(flat))
        run: list[str] = []
        for k, (a, b, i) in enumerate(named):
            if k:
                between = flat[named[k - 1][1] : a]
                sentence = flat[max(flat.rfind(". ", 0, named[k - 1][0]), 0) : a]
                after = flat[b : b + 60].split(". ")[0]
                offered = _CHOICE.match(between) or (re.match(r"^[\s,]*\band\b[\s]*(?:the\s+)?$", between, re.I) and (_OFFER.search(sentence) or _OFFER.search(after)))
                if not offered:
                    out.append(tuple(run))
                    run = []
            run.append(i)
        if run:
            out.append(tuple(run))
        groups = sorted({tuple(sorted({i for i in g if i != OTHER})) for g in out} - {()})
        if not groups and (any(OTHER in g for g in out) or (any(not _NEGATION.search(text[max(0, m.start() - 20) : m.start()]) for m in _OTHER_TERMS.finditer(text)) and not _POINTER.search(text))):
            return ((OTHER,),)
        return tuple(groups)


def resolve(groups: list[Group] | tuple[Group, ...]) -> tuple[str, str] | None:
    """(license_id, conflict) of all that a file or repository states; None where it states nothing."""
    known = [g for g in groups if OTHER not in g]
    if not known:
        return (UNKNOWN, "no") if groups else None
    ids = sorted({i for g in known for i in g})
    if len(ids) == 1:
        return ids[0], "no"
    if any(len(g) == len(ids) for g in known):
        return " OR ".join(ids), "no"
    return " AND ".join(ids), "yes"


_COMMENT = r"(?P<c>/\*.*?(?:\*/|\Z)|(?://|\#(?!\[))[^\r\n]*)"
_HEADS = {
    "php": re.compile(rf"[\s;]+|<\?php(?=\s|\Z)|<\?=|\?>|{_COMMENT}|(?:namespace|use)\b[^;{{}}()=]*(?:\{{[^{{}};()=]*\}})?[^;{{}}()=]*[;{{]|declare\s*\([^)]*\)\s*[;{{]?", re.S | re.I),
    "js": re.compile(r"\s+|(?P<c>/\*.*?(?:\*/|\Z)|//[^\r\n]*)|\#![^\r\n]*", re.S),
    "yml": re.compile(r"\s+|---(?=\s)|(?P<c>\#[^\r\n]*)"),
    "sql": re.compile(rf"\s+|(?P<c>/\*.*?(?:\*/|\Z)|--[^\r\n]*|\#[^\r\n]*)", re.S),
}
_HTML = re.compile(r"\s+|(?P<c><!--.*?-->)", re.S)


def header(lang: str | None, content: str) -> str:
    """Text of the comments before the first declaration or statement; neighbouring line comments read as one."""
    pattern = _HEADS.get(lang)
    if pattern is None:
        return ""
    i = 1 if content.startswith("﻿") else 0
    out: list[str] = []
    if lang == "php":
        while not content.startswith("<?", i):
            m = _HTML.match(content, i)
            if not m or m.end() == i:
                return "\n".join(out)
            if m["c"]:
                out.append(m["c"][4:-3])
            i = m.end()
    while i < len(content):
        m = pattern.match(content, i)
        if not m or m.end() == i:
            break
        if m["c"]:
            raw = m["c"]
            out += comment_lines("block" if raw.startswith("/*") else "line", raw)
        i = m.end()
    return "\n".join(out)


def repo_text(path: str, content: str) -> tuple[str, list[list[str]]]:
    """(text to read, licence lists) of a file at the top of a repository."""
    name = path.rsplit("/", 1)[-1].lower()
    if name.endswith(".json"):
        try:
            value = json.loads(content).get("license")
        except (ValueError, AttributeError):
            m = re.search(r'"license"\s*:\s*("[^"]*"|\[[^\]]*\])', content)
            try:
                value = json.loads(m[1]) if m else None
            except ValueError:
                value = None
        if isinstance(value, dict):
            value = value.get("type")
        lists = [value] if isinstance(value, str) else value if isinstance(value, list) else []
        return "", [[str(x) for x in lists]] if lists else []
    return content, []


def _refs(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    """The reference licences: a fixed list of a dozen, read to the driver."""
    return [tuple(r) for r in table(spark, sf_dir, "license_refs", "license_id", "title", "notice").where(F.col("license_id").isNotNull()).collect()]


def repo_groups(matcher: Matcher, path: str, content: str | None) -> tuple[Group, ...]:
    if not content or not path:
        return ()
    text, lists = repo_text(path, content)
    out = set(matcher.groups(text)) if text else set()
    for entry in lists:
        ids = sorted({i for x in entry for g in matcher.groups(f"SPDX-License-Identifier: {x}") for i in g})
        if ids:
            known = tuple(i for i in ids if i != OTHER)
            out.add(known or (OTHER,))
    return tuple(sorted(out))


def repositories(spark: SparkSession, sf_dir: str, refs: list) -> DataFrame:
    """(project, license_id, conflict) of every project."""

    def make():
        matcher = Matcher(refs)
        return lambda project, path, content: ((project, " | ".join(g)) for g in repo_groups(matcher, path, content))

    rows = table(spark, sf_dir, "repo_files", "project", "path", "content").where(F.col("project").isNotNull())
    stated = flat_map(rows, make, "project string, stated string").groupBy("project").agg(F.sort_array(F.collect_set("stated")).alias("stated"))

    def settle():
        return lambda project, stated: ((project, *(resolve([tuple(s.split(" | ")) for s in stated]) or (UNKNOWN, "no"))),)

    settled = flat_map(stated, settle, "project string, license_id string, conflict string")
    projects = table(spark, sf_dir, "projects", "project").where(F.col("project").isNotNull()).distinct()
    return projects.join(settled, "project", "left").select("project", F.coalesce("license_id", F.lit(UNKNOWN)).alias("license_id"), F.coalesce("conflict", F.lit("no")).alias("conflict"))


def stated_licenses(spark: SparkSession, sf_dir: str, refs: list) -> DataFrame:
    """(path, project, own_id, own_conflict) of every file; own_id null where its header states nothing."""

    def make():
        matcher = Matcher(refs)

        def rows(path, project, content):
            got = resolve(matcher.groups(header(language(path), content))) if content else None
            yield path, project, *(got or (None, None))

        return rows

    src = table(spark, sf_dir, "php_files", "path", F.col("case_id").alias("project"), "content").where(F.col("path").isNotNull())
    return flat_map(spread(src), make, "path string, project string, own_id string, own_conflict string").groupBy("path").agg(
        F.max("project").alias("project"), F.max(F.struct("own_id", "own_conflict")).alias("own")).select("path", "project", "own.*")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir)
    repos = repositories(spark, sf_dir, refs)
    f = stated_licenses(spark, sf_dir, refs).join(repos, "project", "left")
    repo_id, repo_conflict = F.coalesce("license_id", F.lit(UNKNOWN)), F.coalesce("conflict", F.lit("no"))
    parts = lambda c: F.split(c, " (?:OR|AND) ")
    apart = (repo_id != UNKNOWN) & (F.col("own_id") != UNKNOWN) & ~F.arrays_overlap(parts(F.col("own_id")), parts(repo_id))
    file_id = F.coalesce("own_id", repo_id)
    conflict = F.when(F.col("own_id").isNull(), repo_conflict).when((F.col("own_conflict") == "yes") | apart, "yes").otherwise("no")
    return (repos.select(F.lit("repo").alias("scope"), F.col("project").alias("subject"), "license_id", "conflict")
            .unionByName(f.select(F.lit("file").alias("scope"), F.col("path").alias("subject"), file_id.alias("license_id"), conflict.alias("conflict"))))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, license_id, coverage, altered) of each notice in a file's header."""
    refs = _refs(spark, sf_dir)

    def make():
        matcher = Matcher(refs)
        notices = lru_cache(50_000)(matcher.notices)
        return lambda path, content: ((path, *n) for n in notices(header(language(path), content)))

    src = table(spark, sf_dir, "php_files", "path", "content").where(F.col("content").isNotNull())
    return flat_map(spread(src), make, "path string, license_id string, coverage double, altered string").distinct()
