from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from girder.llm import maxent_lm, queries

LARGER = "/root/testdata/sf0.01"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def base(rows):
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(w := words(t)), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in maxent_lm.score_documents(df).collect()), key=repr)
    assert got == sorted(((*x[:4], round(x[4], 6)) for x in base(rows)), key=repr)


def test_awkward_rows(awkward):
    check(awkward)


def test_rare_tokens_are_joined(spark, awkward, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD", 3)
    check(awkward)


def test_empty_table(nothing):
    assert maxent_lm.score_documents(nothing).count() == 0


def test_no_training_text(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = maxent_lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert r.held_out and r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score == pytest.approx(-3 * math.log10(maxent_lm.CLASSES))


def test_model_beats_the_unigram_on_held_out_texts(spark):
    rows = queries.op7_language_model(spark, LARGER).collect()
    held = [r for r in rows if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / tokens > 0.15
    assert np.mean([r.score > r.base_score for r in held]) > 0.8


def test_score_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = []
    for n in (1, 4, 16):
        rows = maxent_lm.score_documents(docs.repartition(n)).collect()
        sums.append({r.doc_id: r.score for r in rows})
    for other in sums[1:]:
        assert other.keys() == sums[0].keys() and all(other[i] == pytest.approx(sums[0][i], rel=1e-6) for i in other)


def some_tokens(n=4000, kinds=5):
    rng = np.random.default_rng(1)
    codes = rng.integers(1, kinds + 1, n).astype(np.int32)
    return maxent_lm.features(codes, np.arange(0, n, 40)), codes


def test_class_probabilities_add_up_to_one():
    keys, _ = some_tokens(20)
    w = maxent_lm.Weights(12, np.zeros(maxent_lm.CLASSES))
    w.w[:] = np.random.default_rng(0).normal(size=w.w.shape)
    total = sum(np.exp(w.log_probs(keys, np.full(20, c))) for c in range(maxent_lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradient_equals_sums_token_by_token():
    keys, codes = some_tokens(200)
    kind = (codes * 11 % maxent_lm.CLASSES).astype(np.int64)
    w = maxent_lm.Weights(12, np.bincount(kind, minlength=maxent_lm.CLASSES))
    w.w[:] = np.random.default_rng(0).normal(size=w.w.shape)
    g = maxent_lm.Gradient(w)
    g.add(keys, kind)
    observed, expected = np.zeros_like(g.observed), np.zeros_like(g.expected)
    rows = w.rows(keys, kind // maxent_lm.PER_GROUP)
    for i, k in enumerate(kind):
        for column, outcome in ((i, k // maxent_lm.PER_GROUP), (i + len(kind), k % maxent_lm.PER_GROUP)):
            logits = w.w[rows[:, column]].sum(axis=0)
            p = np.exp(logits - logits.max())
            for r in rows[: maxent_lm.FEATURES, column]:
                observed[outcome, r] += 1
                expected[:, r] += p / p.sum()
    assert (g.observed == observed).all()
    assert np.allclose(g.expected * maxent_lm.UNIT, expected, atol=observed.sum(axis=0).max() * maxent_lm.UNIT)


def test_updates_follow_the_gradient(spark):
    texts = ["a b c d e f " * 30, "x y z " * 50] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = maxent_lm.score_documents(docs).collect()
    assert all(r.score > r.base_score * 0.75 for r in rows)


def test_tokens_of_a_class_and_the_unknown_ones_add_up_to_one(spark):
    """Over all training tokens and one unknown for each class, the model's probabilities of a next token sum to one."""
    texts = ["the cat sat", "the dog sat down", "a cat", "der hund sass", "der mann"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    encoded_rows = docs.selectExpr("cast(doc_id as string) doc_id", "false held_out", "cast(doc_id % 16 as int) `update`", "text")
    vocabulary = maxent_lm.count_tokens(docs.select("text")).cache()
    head = maxent_lm.frequent_tokens(vocabulary, maxent_lm.HEAD)
    counts = dict(head)
    encoded = maxent_lm.encode(encoded_rows, head).cache()
    model = maxent_lm.fit(vocabulary, encoded, head, sum(counts.values()))
    known = maxent_lm.Codes({w: i for i, (w, _) in enumerate(head, 1)})
    total = 0.0
    for word, n in counts.items():
        codes = known.of([b"the", word])
        total += 10 ** (model.log10_of(codes, np.array([0]))[1] + math.log10(n + 1))
    keys = maxent_lm.features(known.of([b"the", b"cat"]), np.array([0]))[:, 1:]
    for kind in range(maxent_lm.CLASSES):
        total += math.exp(model.weights.log_probs(keys, np.array([kind]))[0]) / 10 ** model.class_log[kind]
    assert total == pytest.approx(1, abs=1e-4)
