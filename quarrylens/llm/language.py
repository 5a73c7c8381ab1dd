"""Problem 1: natural language hidden inside code.

Comments, PHPDoc descriptions and quoted strings are cleaned of tags, notices
and code-like words; what is left is broken into words, the words into subwords
of a public tokenizer's vocabulary, and scored under unigram counts of each
language and of an explicit code class. The class of the greatest posterior is
the answer; text of the code class is no natural language.

Counts come from a bounded sample: at most SAMPLE texts of documents per
declared language (labels in any case; null and unknown labels are left out)
and SAMPLE files for code, with the notices of license_refs as further English. Everything else covers all files. Null content gives
no row; equal rows count once; text without letters has no language.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.samples import bounded_keys
from quarrylens.llm.scan import comment_lines, is_comment, pieces, string_value
from quarrylens.llm.sources import files, language
from quarrylens.operators.rowmap import flat_map
from quarrylens.php.lexer import line_of, line_starts
from quarrylens.sources.tables import table

#: Bound of the fitting sample, per language and for code.
SAMPLE = 400
TOKENIZERS = "/opt/tokenizers"
LANGS = ("de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "zh")
CODE = "code"
#: Probability kept for subwords that a class does not show.
_FLOOR = 0.02
#: Weight of a training word's form without accents, as badly typed texts have it.
_PLAIN = 0.3

_CJK = r"぀-ヿ㐀-䶿一-鿿ｦ-ﾟ"
_WORD = re.compile(rf"[{_CJK}々ー]+|[^\W\d_]+", re.U)
_TOKEN = re.compile(rf"[{_CJK}々ー]+|[^\W\d_]+|\$|->|::|=>|==|[;{{}}()\[\]=<>|&\\/_]", re.U)
_CAMEL = re.compile(r"(?<=[a-zß-ÿ0-9])(?=[A-ZÀ-Þ])")
_CODEISH = re.compile(r"[$\\_=<>{}\[\]|*#@~^]|->|::|\(\)|\w\(|\w/\w|\w\.\w|\w:\w|\d")
_INLINE = re.compile(r"\{@[^}]*\}|`[^`]*`|<[^<>]*>|https?://\S+")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SQL = re.compile(r"^\s*(?:SELECT\b.*\bFROM\b|INSERT\s+INTO\b|UPDATE\b.*\bSET\b|DELETE\s+FROM\b|(?:CREATE|ALTER|DROP)\s+(?:TABLE|USER|INDEX|VIEW|DATABASE|ROLE)\b|GRANT\b.*\bTO\b|WITH\b.*\bSELECT\b)", re.S | re.I)
_KEY = re.compile(r"-----BEGIN |^[A-Za-z0-9+/=_-]{40,}$")
_NOTICE = re.compile(r"^(?:spdx-\S+:.*|(?:copyright|©|\(c\))\b.{0,80}|\(c\) .{0,80}|all rights reserved\.?|licen[cs]e: .{0,40}|version:? .{0,20})$", re.I)
_STRIP = " \t.,;:!?()\"'«»„“”‚‘’…-–—*。、！？（）「」"


def repair(s: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again; any other text as it is."""
    if not re.search(r"[\xc2-\xf4][\x80-\xbfŒ-˜–-™]", s):
        return s
    for codec in ("cp1252", "latin-1"):
        try:
            return s.encode(codec).decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            pass
    def one(m: re.Match) -> str:
        for codec in ("cp1252", "latin-1"):
            try:
                return m.group().encode(codec).decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                pass
        return m.group()
    return re.sub(r"[\xc2-\xf4][\x80-\xbfŒ-˜–-™]{1,3}", one, s)


def prose_lines(kind: str, raw: str, lang: str | None) -> list[str]:
    """The lines of a comment or string that may be natural language."""
    if not is_comment(kind):
        return string_value(lang, raw).split("\n")
    out = []
    for x in comment_lines(kind, raw):
        if x.startswith("@"):
            if kind == "doc":
                break  # what follows a tag belongs to it
            continue
        if not _NOTICE.match(x):
            out.append(x)
    return out


def words(text: str) -> tuple[list[str], int]:
    """(natural words, characters of Chinese or Japanese) of cleaned text."""
    out, cjk = [], 0
    for chunk in _INLINE.sub(" ", text).split():
        s = chunk.strip(_STRIP)
        if not s or _CODEISH.search(s):
            continue
        for w in _WORD.findall(s):
            out.append(w)
            if "぀" <= w[0] <= "鿿" or "ｦ" <= w[0] <= "ﾟ":
                cjk += len(w)
    return out, cjk


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


class Subwords:
    """Ids of the subwords of a word in the vocabulary of a byte-level BPE."""

    def __init__(self, path: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self._encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, word: str) -> list[int]:
        return [i for part in _CAMEL.split(word) for i in self._encode(" " + part.lower())]


def fit(texts: list[tuple[str, str]], code: list[str], subwords: Subwords, priors: dict[str, float] | None = None) -> tuple[list[str], dict[int, int], np.ndarray, np.ndarray]:
    """(classes, row of each subword, log probabilities as rows x classes, log priors); the last row is for unseen subwords.

    `priors` counts the texts of each language; code gets as much as all of them together. Without it all classes are alike.
    """
    tallies: dict[str, Counter] = {c: Counter() for c in (*LANGS, CODE)}
    for lang, text in texts:
        tallies[lang].update(_WORD.findall(_INLINE.sub(" ", _FENCE.sub(" ", text))))
    for text in code:
        tallies[CODE].update(_TOKEN.findall(text))
    counts: dict[str, Counter] = {c: Counter() for c in tallies}
    for c, tally in tallies.items():
        for w, n in tally.items():
            for i in subwords(w):
                counts[c][i] += n
            p = plain(w)
            if p != w and c != CODE:
                for i in subwords(p):
                    counts[c][i] += n * _PLAIN
    classes = [c for c in counts if counts[c]]
    ids = sorted(set().union(*counts.values()))
    row = {i: k for k, i in enumerate(ids)}
    share = np.zeros((len(ids) + 1, len(classes)))
    for k, c in enumerate(classes):
        for i, n in counts[c].items():
            share[row[i], k] = n
    share /= share.sum(0)
    # What a class never shows costs every class the same, however much text it was fitted on.
    known = {c: (priors or {}).get(c, 0) + 1.0 for c in classes}
    if priors:
        known[CODE] = sum(n for c, n in known.items() if c != CODE)
    prior = np.array([known[c] for c in classes])
    return classes, row, np.log((1 - _FLOOR) * share + _FLOOR / subwords.size).astype(np.float32), np.log(prior / prior.sum()).astype(np.float32)


class Identifier:
    """Most probable class of a piece of text."""

    def __init__(self, model: tuple[list[str], dict[int, int], np.ndarray], tokenizer: str):
        self.classes, self.row, self.table, self.prior = model
        self.subwords = Subwords(tokenizer)
        self.cache: dict[str, np.ndarray] = {}
        self.code = self.classes.index(CODE) if CODE in self.classes else -1

    def vector(self, w: str) -> np.ndarray:
        v = self.cache.get(w)
        if v is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            rows = [self.row.get(i, len(self.row)) for i in self.subwords(w)]
            v = self.cache[w] = self.table[rows].sum(0)
        return v

    def __call__(self, text: str) -> str:
        tokens = _TOKEN.findall(text)
        if not tokens:
            return CODE
        vector, total = self.vector, self.prior
        for w in tokens:
            total = total + vector(w)
        return self.classes[int(np.argmax(total))]


def natural(kind: str, raw: str, lang: str | None, identify: Identifier) -> str | None:
    """Language of a comment or string that holds enough natural language, else None."""
    if len(raw) < 8:
        return None
    lines = prose_lines(kind, raw, lang)
    text = repair("\n".join(lines)).strip()
    if len(text) < 6 or _SQL.match(text) or _KEY.search(text):
        return None
    found, cjk = words(text)
    if cjk < 6 and len(found) < 4:
        return None
    best = identify(_INLINE.sub(" ", text))
    if best == CODE:
        return None
    if best in ("ja", "zh"):
        return best if cjk >= 6 else None
    return best if len(found) >= 4 else None


def fit_model(spark: SparkSession, sf_dir: str, tokenizer: str) -> tuple:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text").where(F.lower("lang").isin(*LANGS)).withColumn("lang", F.lower("lang"))
    priors = {r["lang"]: float(r["count"]) for r in docs.where(F.col("text").isNotNull()).groupBy("lang").count().collect()}  # a row a language
    keys = bounded_keys(docs.where(F.col("text").isNotNull()).select("doc_id", "lang"), "doc_id", "lang", SAMPLE)
    texts = [tuple(r) for r in docs.where(F.col("doc_id").isin(keys)).select("lang", "text").toLocalIterator()]
    texts += [("en", r[0]) for r in table(spark, sf_dir, "license_refs", "notice").where(F.col("notice").isNotNull()).toLocalIterator()]
    src = table(spark, sf_dir, "php_files", "file_id", "path", "content").where(F.col("content").isNotNull())
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    src = src.where(ext.isin("php", "inc", "js")).withColumn("any", F.lit(1))
    keys = bounded_keys(src.select("file_id", "any"), "file_id", "any", SAMPLE)
    code = []
    for r in src.where(F.col("file_id").isin(keys)).select("path", "content").toLocalIterator():
        text, out, i = r[1], [], 0
        for _, a, b in pieces(language(r[0]), text):
            out.append(text[i:a])
            i = b
        code.append(" ".join([*out, text[i:]]))
    return fit(texts, code, Subwords(tokenizer), priors)


def natural_pieces(spark: SparkSession, sf_dir: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(file_id, line, lang, n_chars, file_chars) of every comment or string that holds natural language."""
    model = spark.sparkContext.broadcast(fit_model(spark, sf_dir, tokenizer))  # bounded by the vocabulary

    def make():
        identify = Identifier(model.value, tokenizer)

        def rows(file_id, path, content):
            lang, starts = language(path), None
            for kind, a, b in pieces(lang, content):
                got = natural(kind, content[a:b], lang, identify)
                if got:
                    starts = starts or line_starts(content)
                    yield file_id, line_of(starts, a), a, got, b - a, len(content)

        return rows

    out = flat_map(files(spark, sf_dir, "file_id", "path", "content"), make,
                   "file_id long, line int, offset int, lang string, n_chars int, file_chars int")
    return out.distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return natural_pieces(spark, sf_dir).select("file_id", "line", "lang")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each language in a file's characters."""
    return natural_pieces(spark, sf_dir).groupBy("file_id", "lang").agg(
        F.count("*").alias("n_pieces"), F.sum("n_chars").alias("n_chars"),
        F.round(F.sum("n_chars") / F.max("file_chars"), 4).alias("share"))
