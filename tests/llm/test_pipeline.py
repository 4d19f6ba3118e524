from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from girder.llm import decontam, quality
from girder.session import materialize

from .test_decontam import brute as holds_item
from .test_exact_dedup import brute as exact_brute
from .test_shingle_dedup import shingle_set

LARGER = "/root/testdata/sf0.01"


def first_of_groups(rows):
    """The smallest id of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {None}:
            holders[x].append(i)
    label = list(range(len(rows)))
    done = set()
    for who in holders.values():
        for j, b in enumerate(who):
            for a in who[:j]:
                if label[a] != label[b] and (a, b) not in done:
                    done.add((a, b))
                    if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                        old, new = label[b], label[a]
                        label = [new if x == old else x for x in label]
    return [min(i for (i, _), x in zip(rows, label, strict=True) if x == one) for one in set(label)]


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    items = [x for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect() if (x := decontam.compared(r.text or ""))]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    seen = {r.doc_id: r.text or "" for r in docs.collect()}
    columns = docs.columns
    trees = quality.fit(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out, _ = materialize(stage(spark, docs, LARGER), "test-stage")
        made = out.collect()
        rows = sorted(seen.items())
        if name == "quality":
            want = [i for (i, _), s in zip(rows, trees.score(quality.statistics_of([t for _, t in rows]).astype("f4").astype("f8")), strict=True) if s >= quality.THRESHOLD]
        elif name == "exact_dedup":
            want = [i for i, _, _, k in exact_brute(rows) if k]
        elif name == "near_dedup":
            want = first_of_groups(rows)
        elif name == "decontamination":
            want = [i for i, t in rows if not holds_item(items, decontam.compared(t))]
        else:
            want = list(seen)
            for r in made:
                ids = library.encode(seen[r.doc_id], add_special_tokens=False).ids
                assert r.n_tokens == len(ids) and list(memoryview(bytes(r.ids)).cast("I")) == ids
        assert sorted(r.doc_id for r in made) == sorted(want), name
        if name != "bpe":
            assert out.columns == columns and len(want) < len(seen)
            docs, seen = out, {i: seen[i] for i in want}


def test_stages_take_empty_tables(spark, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, LARGER).count() == 0, name


def test_stages_take_awkward_rows(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, LARGER)
        if name != "bpe":
            assert out.columns == docs.columns
            docs, _ = materialize(out, "awkward")
    assert out.count() == docs.count()


def test_repeated_rows_leave_one(spark):
    one, other = "a river and a stone", "quite another text that is not the same"
    docs = spark.createDataFrame([(1, one), (1, one), (1, other), (2, other), (None, one)], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs, _ = materialize(stage(spark, docs, LARGER), "repeated")
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, one), (1, other)]


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
