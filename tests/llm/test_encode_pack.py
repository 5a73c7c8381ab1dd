"""Problems 8 and 9: exact round trips and invariants."""

from __future__ import annotations

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm.encode import VOCABULARY, Encoder, ids
from quarrylens.llm.packing import CAPACITY, best_fit, containers, deficits, mixture, pack, pieces, windows

DOCS = "doc_id long, text string, source string, ids string, queue int"


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aeinrst hgu'\n\t 01é漢<|>", max_size=200))
def test_same_ids_as_the_tokenizer(encoder, reference, text):
    assert encoder(text) == reference.encode_ordinary(text)


def test_all_documents(encoder, reference, spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").toLocalIterator():
        assert encoder(r.text) == (reference.encode_ordinary(r.text) if r.text else [])


def test_long_runs_are_linear(encoder, reference):
    for s in ("a" * 20_000, "ab" * 5_000, "<|endoftext|>", "\x00" * 300, "é" * 3000):
        assert encoder(s) == reference.encode_ordinary(s)


def test_ids_of_null_empty_and_repeated_texts(spark, make_tables):
    rows = [(1, None, "a", "x", 0), (2, "", "a", "x", 0), (3, "same text", None, "x", 0), (4, "same text", "b", "x", 0)]
    got = {r.doc_id: r.ids for r in ids(spark, make_tables(documents=(DOCS, rows))).collect()}
    assert got[1] == got[2] == [] and got[3] == got[4] != []
    assert ids(spark, make_tables(documents=(DOCS, []))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_best_fit_never_overfills(sizes):
    where = best_fit(sizes, 50)
    for c in set(where):
        assert sum(s for s, w in zip(sizes, where) if w == c) <= 50
    full = -(-sum(sizes) // 50)
    assert len(set(where)) <= max(1, 2 * full) or not sizes


def test_packing_keeps_every_token_once_and_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([0, 3, 40, 90, 100, 250])) for i in range(800)]
    got = pack(pieces(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), 100), 100, per_window=40).collect()
    by_container, by_doc = {}, {}
    for r in got:
        by_container.setdefault(r.container, []).append(r)
        by_doc.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert all(sum(r.n_tokens for r in c) <= 100 and sorted(r.place for r in c) == list(range(len(c))) for c in by_container.values())
    sizes = {i: n for i, _, n in rows}
    for i, parts in by_doc.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == sizes[i] and (len(parts) == 1 or sizes[i] > 100)
    assert set(by_doc) == set(sizes)
    assert len(by_container) <= 1.05 * -(-sum(sizes.values()) // 100) + 1


def test_every_window_holds_the_corpus_mixture(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([0, 3, 40, 90, 100, 250])) for i in range(800)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    source, total = {i: s for i, s, _ in rows}, sum(n for _, _, n in rows)
    share = {q: sum(n for i, s, n in rows if s == q) / total for q in ("a", "b", None)}
    tokens = {}
    for r in windows(pieces(counts, 100), 100, per_window=40).collect():
        w = tokens.setdefault(r.win, {})
        w[source[r.doc_id]] = w.get(source[r.doc_id], 0) + r["size"]
    assert len(tokens) > 10
    for w in tokens.values():
        assert all(abs(w[q] / sum(w.values()) - share[q]) < 0.06 for q in share)


def test_deficits_are_carried_and_targets_held(spark):
    """Round by round: a queue sends what its counter covers, and carries less than its next item's size on."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([3, 40, 90, 100])) for i in range(1500)]
    items = pieces(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), 100)
    served = windows(items, 100, per_window=40, targets={"a": 0.5, "b": 0.25}).collect()
    for source, target in (("a", 0.5), ("b", 0.25), (None, 0.25)):
        mine = [r for r in served if r.source == source]
        counter, sent = 0.0, 0
        for k in range(max(r.win for r in mine) + 1):
            counter += mine[0].quantum
            out = sum(r["size"] for r in mine if r.win == k)
            counter -= out
            assert 0 <= counter + 1e-6 and (counter < 100 + 1e-6 or k == max(r.win for r in mine)), (source, k)
            sent += out
        assert sent == sum(n for _, s, n in rows if s == source)
    whole = [k for k in range(5) if all(any(r.win >= k and r.source == s for r in served) for s in ("a", "b", None))]
    for k in whole[:3]:
        n = sum(r["size"] for r in served if r.win == k)
        assert abs(sum(r["size"] for r in served if r.win == k and r.source == "a") / n - 0.5) < 0.05
    d = deficits(windows(items, 100, per_window=40)).collect()
    assert all(-1e-6 <= r.deficit < 100 + 1e-6 for r in d)


def test_final_containers_hold_the_mixture(spark, make_tables):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 400)), "en", rng.choice(["a", "a", "b", None]), 0) for i in range(900)]
    d = make_tables(documents=(DOCS, [(i, t, s, l, n) for i, t, l, s, n in rows]))
    got = mixture(spark, d).collect()
    assert sum(r.n_tokens for r in got) > 0 and all(0 <= r.fill <= 1 and 0 <= r.deviation <= 0.6 for r in got)
    assert mixture(spark, make_tables(documents=(DOCS, []))).count() == 0


def test_containers_of_edge_cases(spark, make_tables):
    long = " ".join("word" for _ in range(2 * CAPACITY + 5))
    d = make_tables(documents=(DOCS, [(1, None, None, "x", 0), (2, "", "a", "x", 0), (3, long, "a", "x", 0), (4, "hi", "b", "x", 0)]))
    got = sorted((r.doc_id, r.first_token, r.n_tokens) for r in containers(spark, d).collect())
    assert got[:3] == [(1, 0, 0), (2, 0, 0), (3, 0, CAPACITY)] and [g[0] for g in got].count(3) == 3
    assert containers(spark, make_tables(documents=(DOCS, []))).count() == 0
