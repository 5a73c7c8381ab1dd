"""Problem 6: credentials embedded in source code.

Candidates are string literals (with the parts of URLs, headers and SQL inside
them), values of configuration lines and of lines in heredocs, and words of
comments. A logistic regression scores each by the likelihood of its characters
under two Markov models (of credentials and of the corpus's ordinary names), by
its make-up, by the identifiers around it and by the parts of its path; all
features are hashed. It is trained on all files of the table: candidates are
taken once and kept, slices of files are fitted where they lie, and the weights
of a slice count by its candidates that have the feature. Patterns label a part
of the candidates, the clear cases only; what they leave open gets its label
from the model itself, once that is sure. Scores are calibrated on files whose
slices are left out of the weights for it; the weights used then count all
slices. Candidates of calibrated probability THRESHOLD or above are credentials
and are redacted in place.

Null content gives no row; a file with several equal rows counts once; an empty
text has no credential.
"""

from __future__ import annotations

import marshal
import math
import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.scan import is_comment, pieces
from quarrylens.llm.sources import files, language, once
from quarrylens.operators.rowmap import flat_map, fold, per_worker
from quarrylens.php.lexer import line_of, line_starts
from quarrylens.session import checkpointed

#: Candidates of a slice, about; every slice is fitted.
SLICE = 300_000
#: Weight of a candidate that is clearly no credential and has no secret name around; there are a hundred times as many as others.
EASY = 0.15
#: Share of the files (one in so many) held out while scores are calibrated.
HOLD_OUT = 5
#: Steps of a score that calibration tells apart.
STEPS = 64
#: Buckets that names of features are hashed to.
BUCKETS = 1 << 13
#: Calibrated probability from which a candidate is a credential: one missed costs more than a harmless word masked.
THRESHOLD = 0.15
MASK = "REDACTED"

#: Words that name credentials, in the languages of the corpus (fixed values).
SECRET_WORDS = frozenset(
    """password passwd passwort passphrase pass pwd pw secret token auth authorization apikey key credential credentials creds login salt bearer
    basic identified clave contrasena contraseña passe motdepasse senha wachtwoord haslo hasło пароль ключ токен 密码 密钥 口令 パスワード トークン 鍵 parola chiave
    schlüssel schluessel kennwort zugang jeton clé cle segredo chave geheim sleutel sekret klucz private signing access client sign""".split()
)
#: Words that name values which are no credentials though they look random or are named alike (fixed values).
PUBLIC_WORDS = frozenset(
    """checksum checksums hash sha md5 digest integrity revision commit reference ref etag uuid guid id icon image logo data version license licence
    header field name env placeholder sample masked mask rules rule column label public cert fingerprint request trace format pattern regex class path file url""".split()
)
_PLACEHOLDER = re.compile(
    r"your|here\b|change[-_ ]?me|example|placeholder|dummy|sample|insert|todo|fixme|xxx|\*{3,}|\.{3,}|^<.*>$|^\[.*\]$|\$\{|\{\{|%env|^%\w+%$|getenv|process\.env|^(?:null|none|true|false|~|test|secret|password|token)$"
    r"|\|(?:string|required|min|max|nullable)|^(.)\1+$|(?-i:%[-\d]*[sd]\b)", re.I)
_SHAPES = re.compile(r"^(?:eyJ[\w-]{8,}\.[\w-]+\.[\w-]*|[a-z]{2,4}[-_](?:sk|pk|live|prod|test)[-_][\w-]{10,}|[a-z]{2,8}_(?:prod|live)_\w{10,}|AKIA[A-Z0-9]{12,}|gh[pousr]_\w{20,}|xox[abp]-[\w-]{10,}|AIza[\w-]{30,})$")
_HEX = re.compile(r"^[0-9a-fA-F]{16,}$")
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_PATHISH = re.compile(r"^(?:\.{0,2}/[a-z0-9_./{}%-]*$|\.{0,2}/[\w./-]+\.\w{1,5}$|[A-Za-z]:\\|\w+(?:\\\\?\w+)+$|[\w.-]+/[\w./-]+\.\w{1,5}$|\w+://[^@?]*$|data:|#[0-9a-fA-F]{3,8}$|sha\d{3}-|(?:[A-Za-z]+-)+v?\d(?:\.\d+)*(?:-[A-Za-z-]+)?\+?$|\d-[a-z]+$)")
_NAME = re.compile(r"^[A-Za-z]+(?:[-_. ][A-Za-z]+)*$")
_CAMEL = re.compile(r"[A-Z]?[a-zß-ÿ]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/:@'\"]*:([^\s@/'\"]+)@", re.I)
_QUERY = re.compile(r"[?&;](?:api[-_]?key|key|token|access[-_]?token|secret|password|passwd|pwd|pass|auth|sig(?:nature)?|client[-_]?secret)=([^&\s'\"#;]+)", re.I)
_HEADER = re.compile(r"\b(?:Authorization|X-[\w-]*(?:Token|Key|Secret|Auth)[\w-]*|Cookie)\s*:\s*(?:Basic|Bearer|Token|Digest)?\s*([^\s'\"]{6,})|\b(?:Basic|Bearer)\s+([A-Za-z0-9+/=._-]{8,})", re.I)
_IDENTIFIED = re.compile(r"\b(?:IDENTIFIED\s+BY|PASSWORD)\s*(?:=\s*)?\\?['\"]([^'\"\\]+)", re.I)
_LINE = re.compile(r"^[ \t]*[\"']?([\w.-]{2,})[\"']?[ \t]*[:=][ \t]*([^\s'\"#;,]{6,})[ \t]*;?\r?$", re.M)
#: A word of a comment; scripts without spaces part words.
_COMMENT_WORD = re.compile(r"[^\s\u3000-\u30ff\u3400-\u9fff\uff00-\uffef]{4,}")
_COMMENT_PIECE = re.compile(r"[^\s'\"`,;()<>]{4,}")
_ASSIGNED = re.compile(r"^[$\w.\[\]'\"-]*[A-Za-z_]['\"\]]*(?:=>?|:)(['\"]?)([^\s'\"/].{3,}?)\1[;,)]*$")
#: Wrongly decoded letters count as letters.
_WORD = re.compile(r"^(?:[^\W\d_]|[\x80-\xbf\u2010-\u203a\u20ac\u2122])+(?:[-'’._/&+][^\W\d_]+)*[!?]?$")
#: Tags, variables, types, calls and other code that comments quote.
_CODE = re.compile(
    r"^(?:\{?@[\w-]+\}?|[&.]*\$[\w>-]+|[?\\]*[A-Za-z_]\w*(?:\\\w+)*(?:\[\])*(?:[|&]\\?\w+(?:\\\w+)*(?:\[\])*)*|\\?\w+\(.*|</?\w+.*|\w+<.*|\W+|[A-Za-z_]+(?:[./:_-][A-Za-z_]+)+|\W?\d[\d.,:/-]*\W?|[A-Za-z]{1,5}[-_.#]?v?\d+(?:\.\d+)*)$|::|->|=>|/\w+\.\w+$")
_DIGIT, _SEPARATOR = re.compile(r"\d"), re.compile(r"['\"`,;()<>]")
_BEFORE = re.compile(r"[^\W\d][\w-]*|\d+", re.U)
_CONCAT = re.compile(r"\s*[.+]\s*(?=(['\"]))")
#: Calls whose first argument is the name of the second (fixed values).
_SETTERS = re.compile(r"(?:define|putenv|setenv|set|ini_set|setParameter|setOption|put|add|config)$", re.I)
_EMAIL = re.compile(r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$")
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\Z")

Candidate = tuple[int, int, str, str, str]  # start, end, value, words around it, kind
Named = tuple[str, str, str]  # value, words around it, kind


def _words(text: str) -> str:
    return " ".join(w.lower() for w in _CAMEL.findall(text))


def _context(content: str, at: int) -> str:
    """Identifiers before a literal: the key or name it belongs to, or the call it is an argument of."""
    line = content[content.rfind("\n", 0, at) + 1 : at]
    piece = re.split(r"[;,{}]", line)[-1] if not re.search(r"[\w\])'\"]\s*(?:=>?|:)\s*$", line) else re.split(r"[;,{}]", line.rstrip()[:-1])[-1] + " "
    words = _BEFORE.findall(piece)
    if re.search(r"(?:=>?|:|=)\s*$", line) and words:
        return _words(" ".join(words[-3:]))
    opener = content.rfind("(", 0, at)
    m = _CALL.search(content, content.rfind("\n", 0, opener) + 1, opener) if opener > content.rfind(")", 0, at) else None
    if not m:
        return _words(" ".join(words[-2:]))
    # The first argument names the value only where the call sets something under a name.
    named = _SETTERS.match(m[1]) and at > opener + 1
    return _words(m[1] + (" " + " ".join(_BEFORE.findall(content[opener + 1 : at])[:3]) if named else ""))


def _irregular(value: str) -> bool:
    """Whether small letters, capitals and symbols change as often as in no word or name; letters beyond ASCII count as small."""
    if len(value) < 8 or value.islower() or value.isupper():
        return False
    kinds = ["a" if c.islower() or not c.isascii() else "A" if c.isupper() else "0" if c.isdigit() else "." for c in value]
    return "a" in kinds and "A" in kinds and sum(x != y for x, y in zip(kinds, kinds[1:])) >= 0.4 * len(value)


@lru_cache(1 << 16)
def _name_words(word: str) -> tuple[str, ...]:
    """Words that a word of a comment gives as names: none where it has digits or looks random."""
    return () if _DIGIT.search(word) or _irregular(word) else tuple(_words(word).split())


def _trimmed(at: int, value: str) -> tuple[int, str]:
    lead = len(value) - len(value.lstrip("'\"`([{<*/:,."))
    return at + lead, value[lead:].rstrip("'\"`)]}>*/:,.;")


@lru_cache(1 << 16)
def _comment_values(word: str) -> tuple[tuple[int, str, bool], ...]:
    """(offset, value, whether a secret's name is assigned it) of what a word of a comment may hold."""
    v = _ASSIGNED.match(word)
    if v and "://" not in word:
        spans = [(*_trimmed(v.start(2), v[2]), any(map(_is_secret, _words(word[: v.start(2)]).split())))]
    else:
        spans = [(*_trimmed(0, word), False)]
        if _SEPARATOR.search(word.strip("'\"`,;()<>")):
            spans += [(*_trimmed(p.start(), p.group()), False) for p in _COMMENT_PIECE.finditer(word)]
    return tuple(x for x in spans if len(x[1]) >= 4)


def _comment_candidates(raw: str, at: int) -> list[Candidate]:
    """Every word of a comment, and what URLs, headers, SQL and assignments in it hold.

    Of the words around, features need only whether they name secrets or public values, so that is all that is kept.
    """
    out: list[Candidate] = []
    tokens = [t for w in raw.split() for t in _name_words(w)]
    words = "token" if any(map(_is_secret, tokens)) else ""
    for k, w in enumerate(reversed(tokens[-3:])):
        if w in PUBLIC_WORDS:
            words += " path" + " -" * k
            break
    done: list[tuple[int, int]] = []
    for m, what in _held(raw):
        g = 1 if m[1] else 2
        a, b = m.span(g)
        # Prose has words behind "basic" and the like; they stay words.
        if _WORD.match(m[g].strip(".,:;!?")) and not _irregular(m[g]) and what in ("header", "sql") or any(a < y and b > x for x, y in done):
            continue
        done.append((a, b))
        out.append((at + a, at + b, m[g], "password" if what in ("url", "sql") else "authorization token", what))
    for m in _COMMENT_WORD.finditer(raw):
        for offset, value, named in _comment_values(m.group()):
            a = m.start() + offset
            if not done or not any(a < y and a + len(value) > x for x, y in done):
                out.append((at + a, at + a + len(value), value, words or ("token" if named else ""), "comment"))
    return out


def _held(text: str) -> list[tuple[re.Match, str]]:
    """Matches within URLs, queries, headers and SQL, each looked for only where its marks are."""
    out: list[tuple[re.Match, str]] = []
    if "://" in text:
        out += [(m, "url") for m in _USERINFO.finditer(text)]
    if "=" in text:
        out += [(m, "query") for m in _QUERY.finditer(text)]
    out += [(m, "header") for m in _HEADER.finditer(text)]
    if "'" in text or '"' in text:
        out += [(m, "sql") for m in _IDENTIFIED.finditer(text)]
    return out


def _is_secret(word: str) -> bool:
    return word in SECRET_WORDS or (len(word) > 5 and word.endswith(("password", "secret", "token", "passwd", "apikey", "passphrase")))


def candidates(lang: str | None, content: str) -> list[Candidate]:
    """Spans that may be credentials, in order; only a word of a comment may hold further ones."""
    out: list[Candidate] = []
    parts = pieces(lang, content)
    skip = -1
    end_last = 0
    gaps: list[tuple[int, int]] = []
    for n, (kind, a, b) in enumerate(parts):
        if a > end_last:
            gaps.append((end_last, a))
        end_last = b
        raw = content[a:b]
        pem = _PEM.search(raw)
        if pem:
            stop = _PEM_END.search(raw, pem.end())
            out.append((a + pem.start(), a + (stop.end() if stop else len(raw)), raw[pem.start() : pem.end() + 40], "private key", "pem"))
            continue
        if is_comment(kind):
            out += _comment_candidates(raw, a)
            continue
        if a < skip:
            continue
        body = raw[1:-1]
        if len(body) < 4:
            continue
        hits = _held(body)
        if hits:
            done: list[tuple[int, int]] = []
            for m, what in hits:
                g = 1 if m[1] else 2
                if m[g] and all(m.end(g) <= x or m.start(g) >= y for x, y in done):
                    done.append((m.start(g), m.end(g)))
                    out.append((a + 1 + m.start(g), a + 1 + m.end(g), m[g], "password" if what in ("url", "sql") else "authorization token", what))
            continue
        if "\n" in body:
            continue
        value, stop = body, b
        if lang in ("php", "js"):
            # A literal joined to further literals is one value.
            k = n
            while k + 1 < len(parts) and not is_comment(parts[k + 1][0]) and (m := _CONCAT.match(content, stop)) and m.end() == parts[k + 1][1]:
                k += 1
                value += content[parts[k][1] + 1 : parts[k][2] - 1]
                stop = parts[k][2]
            skip = stop
        if len(value) >= 6 and not re.search(r"\s", value):
            out.append((a + 1, stop - 1, value, _context(content, a), "literal"))
    gaps.append((end_last, len(content)))
    if lang in ("yml", "php"):
        for lo, hi in gaps:
            text = content[lo:hi]
            if lang == "php" and "<<<" not in text:
                continue
            for m in _LINE.finditer(text):
                if lang == "yml" or "$" not in m[1]:
                    out.append((lo + m.start(2), lo + m.end(2), m[2], _words(m[1]), "line"))
            for u in _USERINFO.finditer(text):
                out.append((lo + u.start(1), lo + u.end(1), u[1], "password", "url"))
    return sorted(out)


class Markov:
    """Character bigrams with their case; the log likelihood of a whole text."""

    CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-./\\ "

    def __init__(self, texts: dict[str, int] | np.ndarray):
        """`texts` counted, or the bigrams of counted texts."""
        self.index = {c: i for i, c in enumerate(self.CHARS)}
        self.other = len(self.index)
        t = 0.1 + (texts if isinstance(texts, np.ndarray) else bigrams(texts))
        t += 5 * t.sum(0) / t.sum()
        self.log = np.log(t / t.sum(1, keepdims=True)).tolist()

    def __call__(self, s: str) -> float:
        p, total, index, other, log = self.other, 0.0, self.index, self.other, self.log
        for c in s:
            q = index.get(c, other)
            total += log[p][q]
            p = q
        return total


def bigrams(texts: dict[str, int]) -> np.ndarray:
    """How often each character follows each, over counted texts."""
    index = {c: i for i, c in enumerate(Markov.CHARS)}
    other = len(index)
    t = np.zeros((other + 1, other + 1))
    for s, times in texts.items():
        p = other
        for c in s:
            q = index.get(c, other)
            t[p, q] += times
            p = q
    return t


@lru_cache(1 << 18)
def bucket(name: str) -> int:
    """Place of a feature, the same in every process."""
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


_SUBWORD = re.compile(r"[^\W\d_]{3,}")


def _classes(value: str) -> list[str]:
    return ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "u" if not c.isascii() else "." for c in value]


def features(value: str, words: str, kind: str, ordinary: Markov | None, secret: Markov | None) -> list[str]:
    """Names of the features that hold for a candidate; without models those of the likelihoods are left out."""
    n, classes = len(value), _classes(value)
    mask = "".join(sorted(set(classes)))
    changes = sum(x != y for x, y in zip(classes, classes[1:]))
    edge = (value[0] if classes[0] == "." else classes[0]) + (value[-1] if classes[-1] == "." else classes[-1])
    out = ["one", f"kind {kind}", f"length {min(9, int(2 * math.log2(n + 1)) - 2)}", f"classes {mask}", f"changes {changes * 6 // n}", f"digits {classes.count('0') * 5 // n}",
           f"symbols {classes.count('.') * 5 // n}", f"edge {edge}", f"kind {kind} classes {mask}"]
    if _HEX.match(value):
        out.append(f"hex {n}")
    out += [f"part {w}" for w in set(_SUBWORD.findall(value.lower()))]
    tokens = words.split()
    out += [f"near {w}" for w in set(tokens)]
    out.append(f"nearest {tokens[-1] if tokens else ''}")
    # What the lexicons say of the identifiers around; the last words are the nearest.
    named = ("secret " if any(map(_is_secret, tokens)) else "") + ("public" if any(w in PUBLIC_WORDS for w in tokens[-3:]) else "")
    out += [f"named {named}", f"named {named} kind {kind}", f"named {named} classes {mask}"]
    if ordinary and secret:
        o = ordinary(value)
        ratio = secret(value) - o
        levels = f"mean {max(-6, min(6, round(2 * ratio / n)))}", f"sum {max(-8, min(8, round(ratio / 4)))}", f"ordinary {max(0, min(12, round(-2 * o / n)))}"
        for x in levels:
            out += (x, f"named {named} {x}")
    return out


def path_features(path: str) -> list[str]:
    """Directories, extension and words of the name."""
    *folders, name = path.lower().split("/")
    stem, _, extension = name.rpartition(".")
    return [*(f"folder {x}" for x in folders[1:]), f"extension {extension}", *(f"file {w}" for w in _SUBWORD.findall(stem))]


def pattern_label(value: str, words: str, kind: str) -> int | None:
    """What patterns say of a candidate, in clear cases only: 1 a credential, 0 none, None where they leave it open."""
    if kind == "pem":
        return 1
    tokens = words.split()
    secret, shape = any(map(_is_secret, tokens)), bool(_SHAPES.match(value))
    if _PLACEHOLDER.search(value) or _UUID.match(value) or _EMAIL.match(value) or (_PATHISH.match(value) and not shape):
        return 0
    plain = bool(_NAME.match(value)) and (value.islower() or value.istitle() or value.isupper())
    if shape:
        return 1 if secret else None
    if kind in ("url", "query", "header", "sql"):
        return 1 if len(value) >= 6 and not plain else None
    if not secret or plain or any(w in PUBLIC_WORDS for w in tokens[-3:]):
        return 0
    if kind == "comment" and not _irregular(value) and (_WORD.match(value) or (_CODE.search(value) and not _HEX.match(value))):
        return 0
    return 1 if len({*_classes(value)} - {"u"}) >= 3 and len(value) >= (12 if kind == "comment" else 8) else None


def is_easy(value: str, words: str, kind: str) -> bool:
    """Whether a candidate that is no credential could hardly be taken for one."""
    return not any(map(_is_secret, words.split())) or (kind == "comment" and len(set(_classes(value))) < 3)


def is_held(path: str) -> bool:
    """Whether a file is held out while scores are calibrated."""
    return zlib.crc32(path.encode("utf-8", "surrogatepass")) % HOLD_OUT == 0


class Slice:
    """Candidates of some files: feature rows of (value, words, kind) and of paths, and the pairs of both that occur."""

    def __init__(self, parts: Iterable[tuple[str, Iterable[Named]]], row: Callable[[str, str, str], list[int]], patterns=pattern_label):
        of: dict[Named, int] = {}
        ways, at, sizes = [], array("q"), []
        for path, cs in parts:
            if cs := dict.fromkeys(cs):
                ways.append([*map(bucket, path_features(path))])
                at.extend([of.setdefault(c, len(of)) for c in cs])
                sizes.append(len(cs))
        names = [row(*c) for c in of]
        self.kinds = np.array([c[2] for c in of], dtype=object)
        labels = [patterns(*c) for c in of]
        self.label = np.array([np.nan if y is None else y for y in labels], dtype=float)
        self.easy = np.array([y == 0 and is_easy(*c) for c, y in zip(of, labels)], dtype=bool)
        self.at = np.stack([np.array(at, dtype=np.int64), np.repeat(np.arange(len(sizes)), np.array(sizes, dtype=np.int64))])
        self.sides = [(np.repeat(np.arange(len(rs)), [len(r) for r in rs]), np.fromiter((i for r in rs for i in r), dtype=np.int64), len(rs)) for rs in (names, ways)]

    def scores(self, beta: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the weights of each pair's features."""
        a, b = (np.bincount(owner, beta[index], n) for owner, index, n in self.sides)
        return a[at[0]] + b[at[1]]

    def gathered(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum over pairs of `v` for each feature."""
        return sum(np.bincount(index, np.bincount(at[k], v, n)[owner], BUCKETS) for k, (owner, index, n) in enumerate(self.sides))

    def regression(self, at: np.ndarray, y: np.ndarray, times: np.ndarray, start: np.ndarray | None = None, ridge: float = 0.2, steps: int = 12) -> np.ndarray:
        """Logistic regression by Newton steps that conjugate gradients solve."""
        beta = np.zeros(BUCKETS) if start is None else start.copy()
        if not at.size:
            return beta
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.scores(beta, at), -30, 30)))
            r = self.gathered(times * (y - p), at) - ridge * beta
            h = times * p * (1 - p) + 1e-9
            step, d, rs = np.zeros(BUCKETS), r.copy(), r @ r
            least = 1e-4 * rs
            for _ in range(25):
                if rs <= least or rs == 0:
                    break
                hd = self.gathered(h * self.scores(d, at), at) + ridge * d
                a = rs / (d @ hd)
                step += a * d
                r -= a * hd
                rs, last = r @ r, rs
                d = r + rs / last * d
            beta += step
            if np.abs(step).max() < 0.02:
                break
        return beta

    def fit(self, rare: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the features, and the summed weight of the candidates that have each.

        Credentials weigh more than the rest, those of kinds with few of them most.
        """
        weight = np.where(self.label == 1, [3.0 * rare.get(k, 1.0) for k in self.kinds], np.where(self.easy, EASY, 1.0))
        is_open = np.isnan(self.label[self.at[0]])
        at, left = self.at[:, ~is_open], self.at[:, is_open]
        y, times = self.label[at[0]], weight[at[0]]
        beta, own = self.regression(at, y, times), self.gathered(times, at)
        for _ in range(2 if left.size else 0):  # what patterns leave open, once the model is sure of it
            z = self.scores(beta, left)
            sure = np.abs(z) > 1.5
            both = np.concatenate([at, left[:, sure]], 1), np.concatenate([times, np.ones(int(sure.sum()))])
            beta, own = self.regression(both[0], np.concatenate([y, (z[sure] > 0).astype(float)]), both[1], beta), self.gathered(both[1], both[0])
        return beta, own

    def outcomes(self, beta: np.ndarray) -> Counter:
        """(label, score in steps) of the clear candidates, counted."""
        at = self.at[:, ~np.isnan(self.label[self.at[0]])]
        z = np.rint(np.clip(self.scores(beta, at), -30, 30) * STEPS).astype(int)
        return Counter(zip(self.label[at[0]].astype(int).tolist(), z.tolist()))


class Mean:
    """The mean of slices' weights; a slice counts by its candidates that have the feature."""

    def __init__(self):
        self.total, self.own = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def add(self, beta: np.ndarray, own: np.ndarray) -> None:
        self.total += beta * own
        self.own += own

    def value(self) -> np.ndarray:
        return np.divide(self.total, self.own, out=np.zeros(BUCKETS), where=self.own > 0)


def rarities(of_kind: dict[str, int]) -> dict[str, float]:
    """How much more a credential of each kind weighs, from the credentials of each kind."""
    return {k: min(5.0, (max(of_kind.values()) / n) ** 0.5) for k, n in of_kind.items()}


def calibrated(counts: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Calibration from counted outcomes."""
    rows = sorted(counts.items())
    return calibrate(np.array([z / STEPS for (_, z), _ in rows]), np.array([float(y) for (y, _), _ in rows]), np.array([float(n) for _, n in rows]))


def calibrate(z: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores of held-out candidates into probabilities (Platt, with smoothed targets)."""
    n1, n0 = float((times * y).sum()), float((times * (1 - y)).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (times * (target - p)) - 1e-3 * (beta - [1.0, 0.0]))
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-4:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


class Model(NamedTuple):
    key: str
    ordinary: Markov
    secret: Markov
    weights: dict[int, float]
    slope: float
    offset: float


Sampled = tuple[str, str, str, str]  # value, words around it, kind, path


def rows_of(ordinary: Markov | None, secret: Markov | None) -> Callable[[str, str, str], list[int]]:
    """Buckets of a candidate's features."""
    return lru_cache(1 << 16)(lambda value, words, kind: [*map(bucket, features(value, words, kind, ordinary, secret))])


def fit(found: dict[Sampled, int], ordinary: dict[str, int], markov: bool = True, patterns=pattern_label) -> Model:
    """The model as one slice, from counted candidates of files and their counted ordinary names; `fit_model` is the same over a table."""
    by_path: dict[str, list[Named]] = {}
    for c in found:
        by_path.setdefault(c[3], []).append(c[:3])
    positive = [c for c in found if patterns(*c[:3]) == 1]
    models = (Markov(ordinary), Markov(Counter(c[0] for c in positive))) if markov else (None, None)
    row = rows_of(*models)
    rare = rarities(Counter(c[2] for c in positive))
    own, held = (Slice(((p, cs) for p, cs in by_path.items() if is_held(p) == side), row, patterns) for side in (False, True))
    fits = own.fit(rare), held.fit(rare)
    slope, offset = calibrated(held.outcomes(fits[0][0]))
    mean = Mean()
    for f in fits:
        mean.add(*f)
    return Model(uuid.uuid4().hex, *models, _weights(mean.value()), slope, offset)


def _weights(beta: np.ndarray) -> dict[int, float]:
    return {int(i): float(beta[i]) for i in np.flatnonzero(beta)}


class Detector:
    def __init__(self, model: Model):
        self.model = model
        self.score = lru_cache(200_000)(self._score)
        self.path_score = lru_cache(1000)(lambda path: self._sum(path_features(path)))

    def _sum(self, names: list[str]) -> float:
        get = self.model.weights.get
        return sum(get(bucket(x), 0.0) for x in names)

    def _score(self, value: str, words: str, kind: str) -> float:
        return self._sum(features(value, words, kind, self.model.ordinary, self.model.secret))

    def probability(self, value: str, words: str, kind: str, path: str) -> float:
        z = self.model.slope * (self.score(value, words, kind) + self.path_score(path)) + self.model.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __call__(self, path: str, content: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, probability) of each credential."""
        return self.spans(path, candidates(language(path), content))

    def spans(self, path: str, cs: Iterable[Candidate]) -> list[tuple[int, int, str, float]]:
        out, last = [], -1
        for a, b, value, words, kind in cs:
            if a < last:
                continue
            s = self.probability(value, words, kind, path)
            if s >= THRESHOLD:
                out.append((a, b, kind, s))
                last = b
        return out


def redact(content: str, spans: list[tuple[int, int, str, float]]) -> str:
    """`content` with credentials masked; quotes, joins, line ends and key frames stay."""
    out, i = [], 0
    for a, b, kind, _ in spans:
        out.append(content[i:a])
        body = content[a:b]
        if kind == "pem":
            head, stop = _PEM.match(body), _PEM_END.search(body)
            inner = body[head.end() : stop.start() if stop else len(body)]
            out.append(head.group() + re.sub(r"[^\s'\".+\\]+", MASK, inner) + (stop.group() if stop else ""))
        else:
            joined = re.split(r"(['\"]\s*[.+]\s*['\"])", body)
            out.append("".join(x if k % 2 else MASK for k, x in enumerate(joined)))
        i = b
    return "".join([*out, content[i:]])


_ORDINARY = re.compile(r"[A-Za-z_]{4,}")


def sampled(path: str, content: str) -> Iterator[tuple[str, str | None, str | None, str | None, int]]:
    """What the fit needs of a file, counted: candidates, and ordinary names (words, kind and path null)."""
    for (value, words, kind), n in Counter(c[2:] for c in candidates(language(path), content)).items():
        yield value, words, kind, path, n
    for name, n in Counter(_ORDINARY.findall(content)).items():
        yield name, None, None, None, n


def _packed(x: object) -> bytes:
    return zlib.compress(marshal.dumps(x))


def _unpacked(b: bytes):
    return marshal.loads(zlib.decompress(b))


def _columns(content: str, cs: list[Candidate]) -> bytes:
    """Candidates with their lines, packed by column: lines, starts and ends as differences, then the names and kinds."""
    starts = line_starts(content) if cs else []
    lines, a, b = ([line_of(starts, c[0]) for c in cs], [c[0] for c in cs], [c[1] - c[0] for c in cs])
    numbers = np.array([np.diff(lines, prepend=0), np.diff(a, prepend=0), b], dtype="<i8").tobytes()
    return _packed((numbers, *([c[k] for c in cs] for k in (2, 3, 4))))


def _located(packed: bytes) -> tuple[list[int], list[Candidate]]:
    numbers, *named = _unpacked(packed)
    lines, a, size = np.frombuffer(numbers, dtype="<i8").reshape(3, -1)
    a = np.cumsum(a)
    return np.cumsum(lines).tolist(), [*zip(a.tolist(), (a + size).tolist(), *named)]


def _named(packed: bytes) -> Iterator[Named]:
    return zip(*_unpacked(packed)[1:])


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a file and content: its candidates, and its ordinary names, packed. Equal rows are one; texts are read for this alone."""

    def row(file_id, path, content, version):
        cs = candidates(language(path), content)
        yield file_id, path, version, len(cs), _columns(content, cs), zlib.compress(" ".join(_ORDINARY.findall(content)).encode())

    src = files(spark, sf_dir, "file_id", "path", "content", spreading=False).withColumn("version", _version())
    src = src.repartition(_parts(src), "file_id", "version").dropDuplicates(["file_id", "version"])
    return checkpointed(flat_map(src, lambda: row, "file_id long, path string, version long, n int, found binary, names binary"))


def _version():
    return F.xxhash64("path", "content")


def _parts(df: DataFrame) -> int:
    """Partitions enough for Python work."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())


def _totals(batch: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[str, int, int]]:
    """What models need of files: bigrams of ordinary names and of clear credentials, and how many clear credentials there are of each kind."""
    tables = {"ordinary": 0, "secret": 0}
    pending, kinds = {t: Counter() for t in tables}, Counter()
    label = lru_cache(1 << 16)(pattern_label)

    def add(least: int) -> None:
        for t, texts in pending.items():
            if len(texts) >= least:
                tables[t] += bigrams(texts)
                texts.clear()

    for found, names in batch:
        pending["ordinary"].update(zlib.decompress(names).decode().split())
        for c in set(_named(found)):
            if label(*c) == 1:
                pending["secret"][c[0]] += 1
                kinds[c[2]] += 1
        add(100_000)
    add(0)
    for t, m in tables.items():
        for cell in np.flatnonzero(m):
            yield t, int(cell), int(m.flat[cell])
    for kind, n in kinds.items():
        yield f"kind {kind}", 0, n


def fit_model(rows: DataFrame) -> Model:
    """The model of a table, from the packed candidates of all its files."""
    spark, rows = rows.sparkSession, rows.where(F.col("path").isNotNull())
    size = len(Markov.CHARS) + 1
    tables, of_kind = {"ordinary": np.zeros(size * size), "secret": np.zeros(size * size)}, {}
    for what, cell, n in fold(rows.select("found", "names"), _totals, "what string, cell int, n long").groupBy("what", "cell").agg(F.sum("n")).collect():
        if what in tables:
            tables[what][cell] = n
        else:
            of_kind[what.removeprefix("kind ")] = n
    key, rare = uuid.uuid4().hex, rarities(of_kind)
    models = spark.sparkContext.broadcast(tuple(Markov(t.reshape(size, size)) for t in tables.values()))

    def cut(batch) -> Slice:
        return Slice(((path, _named(found)) for path, found in batch), per_worker(key, lambda: rows_of(*models.value)))

    def fitted(batch) -> Iterator[tuple[int, bytes, bytes]]:
        part = list(batch)
        s = cut((path, found) for _, path, found in part)
        if s.at.size:
            beta, own = s.fit(rare)
            yield part[0][0], beta.tobytes(), own.tobytes()

    def mixed(batch) -> Iterator[tuple[bytes, bytes]]:
        own, every = Mean(), Mean()
        for no, beta, n in batch:
            for m in (own, every)[no >= of_own :]:
                m.add(np.frombuffer(beta), np.frombuffer(n))
        yield own.value().tobytes(), every.value().tobytes()

    held = F.pmod(F.crc32(F.encode("path", "UTF-8")), F.lit(HOLD_OUT)) == 0
    sizes = dict(rows.groupBy(held).agg(F.sum("n")).collect())
    of_own, of_held = (max(1, -(-sizes.get(side, 0) // SLICE)) for side in (False, True))
    # A partition is a slice, whatever the cluster, in the order of files; those held out are the last.
    h = F.xxhash64("file_id", "version")
    place = F.when(held, F.lit(of_own) + F.pmod(h, F.lit(of_held))).otherwise(F.pmod(h, F.lit(of_own))).cast("int")
    parted = rows.select("path", "found", place.alias("slice"), "file_id", "version").repartitionById(of_own + of_held, F.col("slice"))
    parted = parted.sortWithinPartitions("file_id", "version", "path").select("slice", "path", "found")
    fits = fold(parted, fitted, "slice int, beta binary, own binary").repartition(1).sortWithinPartitions("slice")
    # An empty table has no partition to fold.
    own, every = map(np.frombuffer, fold(fits, mixed, "own binary, every binary").first() or [Mean().value().tobytes()] * 2)
    calibrating = spark.sparkContext.broadcast(own)

    def outcomes(batch) -> Iterator[tuple[int, int, int]]:
        total: Counter = Counter()
        for part in _batched(batch):
            total += cut(part).outcomes(calibrating.value)
        return ((y, z, n) for (y, z), n in total.items())

    counted = fold(rows.where(held).select("path", "found"), outcomes, "y int, z int, n long").groupBy("y", "z").agg(F.sum("n")).collect()
    slope, offset = calibrated({(y, z): n for y, z, n in counted})
    return Model(key + " fitted", *models.value, _weights(every), slope, offset)


def _batched(rows: Iterable[tuple], least: int = 1000) -> Iterator[list[tuple]]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) >= least:
            yield part
            part = []
    if part:
        yield part


def _detected(rows: DataFrame, make_rows, schema: str) -> DataFrame:
    """`make_rows(file_id, version, spans with lines)` for each file."""
    model = rows.sparkSession.sparkContext.broadcast(fit_model(rows))  # two tables of bigrams and at most BUCKETS weights

    def make():
        detect = per_worker(model.value.key, lambda: Detector(model.value))

        def row(file_id, path, version, found):
            lines, cs = _located(found)
            spans = detect.spans(path or "", cs)
            line = {c[0]: at for c, at in zip(cs, lines)} if spans else {}
            return make_rows(file_id, version, [(line[s[0]], *s) for s in spans])

        return row

    return flat_map(rows.select("file_id", "path", "version", "found"), make, schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(_detected(extracted(spark, sf_dir), lambda file_id, version, spans: ((file_id, s[0]) for s in spans), "file_id long, line int"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, n_credentials, content) of every file, redacted but otherwise unchanged."""
    spans = _detected(extracted(spark, sf_dir), lambda file_id, version, spans: ((file_id, version, _packed([s[1:] for s in spans])),) if spans else (), "of long, in long, spans binary")
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("none"))
    src = files(spark, sf_dir, "file_id", "path", "content", spreading=False).select("file_id", "content", _version().alias("version"), *key(F.col("file_id")))
    # One exchange of texts serves to drop repeated rows, to join and to spread the work.
    src = src.repartition(_parts(src), "id", "none").dropDuplicates(["id", "none"])
    spans = spans.select(*key(F.col("of")), F.struct("in", "spans").alias("held")).groupBy("id", "none").agg(F.collect_list("held").alias("held"))

    def row(file_id, content, version, held):
        cs = next((_unpacked(h["spans"]) for h in held or () if h["in"] == version), [])
        yield file_id, len(cs), redact(content, cs)

    return flat_map(src.join(spans, ["id", "none"], "left").select("file_id", "content", "version", "held"), lambda: row, "file_id long, n_credentials int, content string")
