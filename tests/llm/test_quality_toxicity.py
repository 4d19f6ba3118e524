from __future__ import annotations

import math
import re
import statistics
import zlib
from collections import Counter

import numpy as np
import pytest

from girder.llm import quality, queries, toxicity

from .conftest import SF

LARGER = "/root/testdata/sf0.01"


def auc(score, label):
    return toxicity.separation(np.asarray(score), np.asarray(label))


def held_out(spark, query, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = [r for r in query(spark, LARGER).collect()]
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    return rows, np.array([r.score for r in test]), np.array([labels[r.doc_id] for r in test])


def test_quality_on_held_out_rows(spark):
    rows, score, label = held_out(spark, queries.op1_quality, "quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc(score, label) > 0.97


def test_toxicity_on_held_out_rows(spark):
    rows, score, label = held_out(spark, queries.op6_toxicity, "toxic")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert auc(score, label) > 0.7  # 305 labelled rows, 40 of them toxic; see the README for more rows


def test_toxicity_learns_from_enough_rows():
    rng = np.random.default_rng(1)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]

    def text(bad):
        words = ["".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(rng.integers(20, 120))]
        if bad:
            for w in rng.choice(["wretched", "vile", "scoundrel", "despicable"], 3):
                words.insert(int(rng.integers(len(words))), str(w))
        return " ".join(words)

    label = np.array([i % 5 == 0 for i in range(1500)])
    texts = [text(x) for x in label]
    bodies = [toxicity.flat(t) for t in texts[:1000]]
    odd, even, whole = toxicity.train_scales(bodies, label[:1000])
    d = toxicity.Detector(whole, np.array([(odd, even)[i % 2].distances(t) for i, t in enumerate(texts[:1000])]), label[:1000].astype(float))
    score = d.score(texts[1000:])
    assert auc(score, label[1000:]) > 0.97
    assert ((score >= toxicity.THRESHOLD) == label[1000:]).mean() > 0.93


def test_thresholds_are_pooled_shares():
    x = np.array([0, 0, 0, 1, 2, 3, 4, 4], float)
    y = np.array([0, 0, 1, 0, 1, 1, 1, 1], float)
    t = toxicity.Thresholds(x, y)
    got = t.score(np.array([0, 1, 2, 3, 4, 100], float))
    assert (np.diff(got) >= 0).all() and got[0] < 0.4 < 0.8 < got[-1] <= 1


def test_separation_counts_pairs():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, 60).astype(float), rng.integers(0, 2, 60)
    pairs = [(a > b) + (a == b) / 2 for a in x[y == 1] for b in x[y == 0]]
    assert toxicity.separation(x, y) == pytest.approx(np.mean(pairs))


@pytest.mark.parametrize("text", ["", " ", "\n", "a", "\n\n  a  b\n", "é" * 5000, "x" * 200_000, "a b " * 50_000, "\x00\x01"])
def test_statistics_of_odd_texts(text):
    x = quality.statistics(text)
    assert x.shape == (len(quality.NAMES),) and np.isfinite(x).all()


def slow_statistics(text):
    """The statistics by plain Python, from their definitions."""
    raw = text.encode()
    n, blanks = len(raw), b" \t\n\v\f\r"
    words = re.findall(rb"[^ \t-\r]+", raw)
    lines = raw.split(b"\n")
    filled = [x for x in lines if x]
    pairs = list(zip(words, words[1:], strict=False))
    share = lambda xs: sum(xs) / len(xs) if xs else 0.0
    marks = b"#$%&*@^~_=+<>!|"
    out = {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)),
        "upper": sum(65 <= c <= 90 for c in raw) / n, "lower": sum(97 <= c <= 122 for c in raw) / n, "digit": sum(48 <= c <= 57 for c in raw) / n,
        "space": sum(c in b" \t" for c in raw) / n, "newline": sum(c in b"\r\n" for c in raw) / n, "non_ascii": sum(c > 127 for c in raw) / n,
        "ascii_punct": sum(33 <= c <= 126 and not chr(c).isalnum() for c in raw) / n, "pipe": raw.count(b"|") / n, "comma": raw.count(b",") / n, "bang": sum(c in b"!?" for c in raw) / n,
        "period": raw.count(b".") / n, "colon": sum(c in b":;" for c in raw) / n, "quote": sum(c in b"\"'`" for c in raw) / n, "slash": sum(c in b"/\\" for c in raw) / n,
        "hash_like": sum(c in b"#$%&*@^~_=+<>" for c in raw) / n, "other_control": sum(c < 32 and c not in blanks or c in b"\v\f" and c not in blanks or c == 127 for c in raw) / n,
        "word_mean": share([len(w) for w in words]), "word_sd": statistics.pstdev(map(len, words)) if words else 0.0, "word_max": min(200, max(map(len, words), default=0)),
        "short_words": share([len(w) <= 2 for w in words]), "long_words": share([len(w) > 20 for w in words]),
        "line_mean": min(5000, share([len(x) for x in lines])), "line_sd": min(5000, statistics.pstdev(map(len, lines))), "empty_lines": 1 - len(filled) / len(lines),
        "repeat_lines": 1 - len(set(filled)) / len(filled) if filled else 0.0, "repeat_words": 1 - len(set(words)) / len(words) if words else 0.0,
        "top_word": max(Counter(words).values()) / len(words) if words else 0.0, "same_as_next": share([a == b for a, b in pairs]), "pair_repeat": 1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        "upper_words": share([65 <= w[0] <= 90 and w[-1] < 97 for w in words]), "punct_end": share([w[-1] in b".?;:," for w in words]), "marked_words": share([w[0] in marks or w[-1] in marks for w in words]),
        "byte_entropy": -sum(k / n * math.log2(k / n) for k in Counter(raw).values()), "compression": len(zlib.compress(raw, 1)) / n,
    }
    return [out[k] for k in quality.NAMES]


def test_statistics_by_plain_python(documents):
    for _, text in documents:
        if text:
            assert quality.statistics(text) == pytest.approx(slow_statistics(text), abs=1e-9)


def test_statistics_of_words():
    x = dict(zip(quality.NAMES, quality.statistics("aa bb aa aa  cc\naa bb"), strict=True))
    assert x["repeat_words"] == pytest.approx(1 - 3 / 7) and x["top_word"] == pytest.approx(4 / 7) and x["same_as_next"] == pytest.approx(1 / 6) and x["word_mean"] == 2


def test_trees_agree_with_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    t = quality.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=10)
    want = []
    for row in x[:50]:
        total = t.base
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            at = 0
            for _ in range(t.depth):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += leaf[at - (2**t.depth - 1)]
        want.append(total)
    assert np.allclose(t.margin(x[:50]), want)
    assert auc(t.score(x), (x[:, 0] * x[:, 1] > 0).astype(int)) > 0.9


@pytest.mark.parametrize("module, column, args", [(quality, "quality", (5, 0)), (toxicity, "toxic", (4, 2))])
def test_awkward_rows(spark, awkward, nothing, module, column, args):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (7, 0), (7, 0), (8, None), (None, 1), (99, 1), (9, 0), (10, 1)], f"doc_id long, {column} int")
    model = module.fit(awkward, labels, column, *args)
    rows = module.score_documents(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.score_documents(nothing, model).count() == 0
    for model in (module.fit(awkward, labels.limit(0), column, *args), module.fit(nothing, labels, column, *args), module.fit(awkward, labels.where(f"{column} = 1"), column, *args)):
        assert len({r.score for r in module.score_documents(awkward, model).collect()}) == 1


def test_filter_keeps_columns(awkward):
    x = np.zeros((0, len(quality.NAMES)))
    kept = quality.keep_good(awkward, quality.fit_trees(x, np.zeros(0)))
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_labels_of_the_fold_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality")
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert (a.leaf == b.leaf).all() and a.base == b.base
