from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from girder.llm import shingle_dedup, simhash


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return sorted(min(i for (i, _), x in zip(rows, label, strict=True) if x == one) for one in set(label))


def random_rows(seed, groups, most):
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(12))
    texts = ["", "  ", "One two", "one  two", "one two three"]
    for g in range(groups):
        base = [f"w{g}_{i}" for i in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            texts.append(" ".join(words) + (f" {line}" if rng.random() < 0.3 else ""))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_all_pairs(spark, monkeypatch):
    for seed, groups, most, block in ((1, 40, 6, 256), (2, 4, 60, 8)):
        monkeypatch.setattr(shingle_dedup, "BLOCK", block)
        monkeypatch.setattr(shingle_dedup, "BLOCK_BYTES", 1 << 25 if block > 8 else 2000)
        monkeypatch.setattr(shingle_dedup, "FREQUENT", 500_000 if block > 8 else 20)
        rows = random_rows(seed, groups, most)
        out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        assert sorted(r.doc_id for r in out.collect()) == brute(rows)


def test_stage_drops_copies_far_apart_in_simhash(spark):
    """60 words with one changed in the middle keep 51 of 61 shingles: 0.836."""
    words = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "changed", *words[31:]])), (3, " ".join([*words[:20], "a", *words[21:40], "b", *words[41:]]))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_rows_of_blocks_are_compared_by_sets():
    rng = random.Random(4)
    sets = [{rng.randrange(30) for _ in range(rng.randint(1, 12))} for _ in range(60)]
    got = {(i, int(j)) for i, js in shingle_dedup.similar_rows([np.array(sorted(s)) for s in sets], (1, 2)) for j in js}
    assert got == {(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) * 2 >= len(sets[i] | sets[j])}


def test_awkward_rows_and_empty_table(awkward, nothing):
    assert shingle_dedup.near_dedup(awkward).columns == awkward.columns
    kept = sorted((r.doc_id for r in shingle_dedup.near_dedup(awkward).collect()), key=repr)
    assert kept == [1, 10, 11, 3, 6, 7, 8, 9]
    assert shingle_dedup.near_dedup(nothing).count() == 0


def test_what_the_driver_holds_is_bounded(spark, monkeypatch):
    """A crowded filter says more often that a shingle occurs again, never that it doesn't."""
    assert (1 << shingle_dedup.MOST_BITS) // 8 + 12 * shingle_dedup.FREQUENT <= 16 << 20
    monkeypatch.setattr(shingle_dedup, "MOST_BITS", 16)
    rng = random.Random(7)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(700)) for _ in range(120)]
    rows = list(enumerate(texts + [f"{t} end" for t in texts] + [" ".join(f"u{i}_{k}" for k in range(50)) for i in range(40)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = shingle_dedup.find_order(docs.selectExpr("doc_id row", "text"), 5)
    assert order.words.nbytes == 1 << 13 and order.looks == 1
    assert all(order.again((shingle_dedup.shingles(t) >> np.uint64(24)).astype(np.int64)).all() for t in texts)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [*range(120), *range(240, 280)]


def test_stage_goes_through_the_trees(spark, monkeypatch):
    """With the way for the rest shut, fingerprints still join near copies, and the check parts unlike texts."""
    monkeypatch.setattr(shingle_dedup, "prefixes", lambda texts, *_: spark.createDataFrame([], "row long, h long"))
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "changed"]))]
    rows += [(1000, "one two three four five"), (1001, "one two three four five " * 200)]
    rows += [(1002, "a b c d e"), (1003, "A b  c d E"), (1004, ""), (1005, " ")]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    kept = {r.doc_id for r in out.collect()}
    assert kept >= {*range(0, 120, 2), 1000, 1001, 1002, 1004} and not kept & {1003, 1005}
    assert len(kept & set(range(1, 120, 2))) < 6


def test_bands_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    made = sorted({((b := rng.choice(base)) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))), rng.randrange(5)) for _ in range(600)})
    signed = [(x - (1 << 64) if x >> 63 else x, band) for x, band in made]
    distinct = spark.createDataFrame(signed, "fp long, band int")
    roots = {r.node: r.root for r in simhash.components(simhash.link_edges(distinct, 3, block_rows=16, spread=2)).collect()}
    label = {x: x for x, _ in signed}
    for i, (a, p) in enumerate(signed):
        for b, q in signed[:i]:
            if abs(p - q) <= 1 and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    groups = lambda of: {frozenset(k for k in label if of(k) == one) for one in {of(k) for k in label}}
    assert groups(lambda k: roots.get(k, k)) == groups(label.get)
