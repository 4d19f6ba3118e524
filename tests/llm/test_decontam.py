from __future__ import annotations

import random

import duckdb
import pytest

from girder.llm import decontam, queries

from .conftest import SF


def distance(item, text):
    """Fewest edits between the whole item and any piece of the text that begins and ends at word boundaries."""
    far = len(item) + len(text)
    row = [0 if j == 0 or text[j - 1] == " " else far for j in range(len(text) + 1)]
    for i, c in enumerate(item, 1):
        new = [row[0] + 1]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(n for j, n in enumerate(row) if j == len(text) or text[j] == " ")


def brute(items, text):
    """Whether any item is in the text: an item of k edits leaves one of its k + 1 pieces as it is."""
    for item in items:
        k = int(decontam.EDITS * len(item))
        cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
        if any(item[a:b] in text for a, b in zip(cuts, cuts[1:], strict=False)) and distance(item, text) <= k:
            return True
    return False


def test_edited_items_are_found_exactly_within_the_budget():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "of", "the", "delta", "thing", "stone", "river", "a"]
    items = decontam.make_items([(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(12)])
    index = decontam.ItemIndex(items)
    for _ in range(250):
        item = rng.choice(items)
        s = list(item.text)
        for _ in range(rng.randint(0, item.edits + 2)):
            k = rng.randrange(len(s))
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        text = decontam.compared(" ".join(rng.choice(words) for _ in range(8)) + " " + "".join(s) + " " + " ".join(rng.choice(words) for _ in range(8)))
        found = {items[m[0]].item_id: m for m in index.matches(text)}
        for other in items:
            best = distance(other.text, text)
            assert (other.item_id in found) == (best <= other.edits)
            if other.item_id in found:
                assert found[other.item_id][3] == best
                assert distance(other.text, text[found[other.item_id][1] : found[other.item_id][2]]) == best


def test_lemma_bound_holds_for_every_item():
    for n in range(1, 400):
        (item,) = decontam.make_items([(0, "x" * n)])
        assert item.least >= 1 and item.q >= 1 and len(item.text) + 1 - item.q - item.edits * item.q >= 1 or item.q == 1


def test_items_do_not_match_inside_words(spark):
    docs = spark.createDataFrame([(1, "The stones lay still"), (2, "a cathedral"), (3, "One, two."), (4, "see: a cat!"), (5, None), (5, "only one")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one"), (2, "a cat"), (3, None), (4, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated_spans(docs, bench).collect()}
    assert found == {(3, 1), (4, 2), (5, 1)}
    assert sorted((r.doc_id, r.text) for r in decontam.decontaminate(docs, bench).fillna("").collect()) == [(1, "The stones lay still"), (2, "a cathedral"), (5, "")]


def test_filter_acts_on_rows_and_blocks(spark):
    docs = spark.createDataFrame([(1, "x y", 1), (2, "x y", 2), (2, "alpha beta gamma", 3), (None, "ALPHA beta, gamma", 4), (None, None, 5), (3, "delta", 6)], "doc_id long, text string, shared int")
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "item_id long, text string")
    for chars in (4, 4_000_000):
        kept = decontam.decontaminate(docs, bench, block_chars=chars)
        assert kept.columns == docs.columns and sorted(r.shared for r in kept.collect()) == [1, 2, 5]
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated_spans(docs, bench, block_chars=chars).collect()} == {(2, 1), (None, 1), (3, 2)}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_places_are_those_of_the_whole_text():
    text = "ÀÉ İx !!  Some, THING--here (and) there."
    got, places = decontam.normalize(text)
    assert got == decontam.compared(text) and len(places) == len(got)
    start = got.index("thing here")
    assert text[places[start] : places[start + 9] + 1] == "THING--here"


def test_small_table_against_brute_force(spark):
    con = duckdb.connect()
    docs = [d for d in con.sql(f"select doc_id, text from '{SF}/documents.parquet' where length(text) < 1500 order by doc_id limit 60").fetchall()]
    bench = con.sql(f"select item_id, text from '{SF}/benchmark.parquet' limit 8").fetchall()
    planted = docs[:4]
    docs = docs + [(9000 + i, t + " " + bench[i][1].upper().replace("a", "A!") + " end") for i, (_, t) in enumerate(planted)]
    items = decontam.make_items(bench)
    want = {(d, i.item_id) for d, t in docs for i in items if distance(i.text, decontam.compared(t)) <= i.edits}
    made = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.contaminated_spans(made, spark.createDataFrame(bench, "item_id long, text string"), block_chars=300)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) >= 4


def test_query_finds_whole_items(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()}
    con = duckdb.connect()
    rows = con.sql(f"select doc_id, d.text, item_id, b.text from '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b").fetchall()
    assert {(d, i) for d, t, i, b in rows if decontam.compared(b) in decontam.compared(t)} <= got


def test_awkward_rows_and_empty_tables(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "one"), (1, "alpha beta gamma delta")], "item_id long, text string")
    found = sorted((repr(r.doc_id), repr(r.item_id), r.start, r.end) for r in decontam.contaminated_spans(awkward, bench).collect())
    assert ("1", "1", 0, 22) in found and ("None", "1", 0, 22) in found and ("6", "None", 0, 3) in found and ("2", "1", 0, 23) in found
    assert decontam.contaminated_spans(nothing, bench).count() == 0
    assert decontam.contaminated_spans(awkward, bench.limit(0)).count() == 0
    kept = decontam.decontaminate(awkward, bench)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {None, 3, 4, 5, 8, 9, 10, 11}


@pytest.mark.parametrize("item, region, want", [("abc", "xxabcxx", (0, 2, 5)), ("abcd", "abd", (1, 0, 3)), ("abcd", "zzzz", None)])
def test_banded_alignment(item, region, want):
    got = decontam.banded(item, region, 0, len(region), 1)
    assert got == want
