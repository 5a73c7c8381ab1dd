"""Problem 8: encoding of the whole corpus with a public byte-level BPE.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over
the vocabulary finds every token at every place in one pass. The encoding takes
the longest match and backtracks to shorter ones where two neighbours are not
compatible, that is where merging would not have left that border; the answer
for a pair is memoised. Each place is given up at most once, so a piece of text
is encoded in linear time, with exactly the merges of the tokenizer.

Null and empty texts give an empty list. Strings that look like special tokens
are ordinary text.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.rowmap import flat_map, per_worker
from quarrylens.session import spread
from quarrylens.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker keeps at most; beyond it the memory starts anew.
MEMORY = 400_000


class Encoder:
    """Encodes text by backtracking over the matches of an automaton."""

    def __init__(self, path: str = VOCABULARY, pattern: str | None = None):
        import ahocorasick
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.text = {r: s for s, r in self.rank.items()}
        self.auto = ahocorasick.Automaton()
        for s, r in self.rank.items():
            self.auto.add_word(s, (len(s), r))
        self.auto.make_automaton()
        self.pieces = regex.compile(pattern).findall
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, s: str) -> list[int]:
        """Merges by rank, the defining way; only for the few bytes of two tokens."""
        parts, rank = list(s), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [rank[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between two tokens."""
        got = self.compatible.get((a, b))
        if got is None:
            if len(self.compatible) >= MEMORY:
                self.compatible.clear()
            got = self.compatible[a, b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return got

    def piece(self, s: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(s)
        if whole is not None:
            return (whole,)
        n = len(s)
        # Matches by start, shortest first as the automaton meets them.
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, m in self.auto.iter(s):
            at[end - m[0] + 1].append(m)
        open_ = [True] * (n + 1)
        out: list[int] = []
        tried: list[int] = []  # place in at[...] of each token taken
        pos, k = 0, len(at[0]) - 1
        fits = self.fits
        while pos < n:
            choices = at[pos]
            while k >= 0:
                length, r = choices[k]
                if open_[pos + length] and (not out or fits(out[-1], r)):
                    out.append(r)
                    tried.append(k)
                    pos += length
                    k = len(at[pos]) - 1 if pos < n else -1
                    break
                k -= 1
            else:
                open_[pos] = False
                k = tried.pop()
                pos -= len(self.text[out.pop()])
        return tuple(out)

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for p in self.pieces(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = known[p] = self.piece(p.encode("utf-8").decode("latin-1"))
            out.extend(ids)
        return out

    def count(self, text: str | None) -> int:
        return len(self(text))


def token_ids(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of rows with doc_id and text."""

    def make():
        encode = per_worker(("encoder", path), lambda: Encoder(path))
        return lambda doc_id, text: ((doc_id, encode(text)),)

    return flat_map(spread(docs.select("doc_id", "text")), make, "doc_id long, ids array<int>", out_rows=256)


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of rows with doc_id, source and text."""

    def make():
        encode = per_worker(("encoder", path), lambda: Encoder(path))
        return lambda doc_id, source, text: ((doc_id, source, encode.count(text)),)

    return flat_map(spread(docs.select("doc_id", "source", "text")), make, "doc_id long, source string, n_tokens long")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents", "doc_id", "text"))
