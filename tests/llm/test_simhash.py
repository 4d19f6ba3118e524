from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from girder.llm import queries, simhash

from .conftest import SF


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def slow_components(prints):
    """``prints``: (id, fingerprint) of each row; all against all."""
    fps = np.array([f for _, f in prints], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = list(range(len(prints)))
    for i in range(len(prints)):
        stack, seen = [i], {i}
        while stack:
            for y in np.flatnonzero(near[stack.pop()]):
                if y not in seen:
                    seen.add(int(y))
                    stack.append(int(y))
        ids = [prints[j][0] for j in seen if prints[j][0] is not None]
        label[i] = min(ids) if ids else None
    return label


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, slow_components(prints), strict=True)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicate_groups(df).collect()), key=repr)
    assert got == want


def test_awkward_rows(awkward):
    check(awkward)


def test_small_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert queries.op10_simhash(spark, SF).columns == ["doc_id", "fingerprint", "component_id"]


def test_empty_table(nothing):
    assert simhash.near_duplicate_groups(nothing).count() == 0
    assert simhash.near_dedup(nothing).columns == nothing.columns


def test_filter_keeps_one_row_of_each_group(awkward):
    kept = [r.doc_id for r in simhash.near_dedup(awkward).collect()]
    groups = simhash.near_duplicate_groups(awkward).collect()
    assert sorted(kept, key=repr) == sorted({r.component_id for r in groups}, key=repr)


def test_filter_acts_on_rows(spark):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, one, 1), (2, one, 2), (2, other, 3), (2, other, 4), (None, one, 5), (None, "c d e", 6)], "doc_id long, text string, row int")
    for more in ({}, {"width": 5, "similarity": (4, 5)}):
        kept = simhash.near_dedup(df, **more)
        assert kept.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, one), (2, other), (None, "c d e")], key=repr)


def test_large_shards_are_compared_in_parts(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 150)
    fps = np.unique(np.concatenate([base ^ (1 << rng.integers(0, 62, 150)) for _ in range(4)] + [base]))
    distinct = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    roots = []
    for most in (1 << 17, 40):
        found = {r.node: r.root for r in simhash.components(simhash.link_edges(distinct, 2, block_rows=most)).collect()}
        roots.append([found.get(int(x), int(x)) for x in fps])
    assert roots[0] == roots[1] and len(set(roots[0])) <= 150
    dealt = distinct.selectExpr("0 shard", "fp", "fp % 3 <> 0 resident")
    sizes = simhash.parted(dealt, 40).groupBy("shard", "i", "j").count().collect()
    assert len(sizes) > 100 and max(r["count"] for r in sizes) <= 160


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 6))
def test_every_pair_meets_in_a_shard_and_is_linked(seed, n, levels):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, max(1, n // 8), np.uint64)
    flips = [sum({1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4)))}) for _ in range(n)]
    fps = np.unique(centres[rng.integers(0, len(centres), n)] ^ np.array(flips, np.uint64))
    tree = simhash.VantageTree(fps[: max(1, len(fps) // 2)], 1 << levels)
    home, links = np.zeros(len(fps), int), set()
    for _, rows, own in tree.route(fps, 2):
        home[rows[own]] += 1
        up = simhash.link_shard(fps[rows], own, 2)
        links |= {(int(rows[i]), int(rows[u])) for i, u in enumerate(up) if u != i}
    assert (home == 1).all()
    forest = simhash.Forest(len(fps))
    if links:
        forest.join(*np.array(sorted(links)).T)
    label = slow_components(list(enumerate(fps.tolist())))
    assert all((forest.find(i) == forest.find(j)) == (label[i] == label[j]) for i in range(len(fps)) for j in range(i))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(61)} == {0} and {got.get(1000 + i, 1000) for i in range(300)} == {1000} and got[5001] == 5000


@pytest.mark.parametrize("text", ["", "a", "a b", "A b C", "a b c d " * 10000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_few_edges_are_closed_without_shuffles(spark):
    """Steps over few edges don't cost a task for each shuffle partition, and end with the same roots."""
    rng = np.random.default_rng(9)
    edges = [(i, i + 1) for i in range(40)] + [(1000, int(x)) for x in rng.integers(1001, 1300, 400)] + [(int(x), int(y)) for x, y in rng.integers(2000, 2200, (150, 2))]
    df = spark.createDataFrame(edges, "a long, b long")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    status, found, tasks = spark.sparkContext.statusTracker(), [], []
    try:
        for few in (0, len(edges)):
            spark.sparkContext.setJobGroup(f"few-{few}", "")
            found.append(sorted(map(tuple, simhash.components(df, few=few).collect())))
            stages = {s for j in status.getJobIdsForGroup(f"few-{few}") for s in status.getJobInfo(j).stageIds}
            tasks.append(sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1]
    assert tasks[1] < 250 < 1000 < tasks[0]
