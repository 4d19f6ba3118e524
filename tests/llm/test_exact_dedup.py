from __future__ import annotations

import re

import duckdb

from girder.llm import exact_dedup, queries

from .conftest import SF


def brute(rows):
    """Every text against every other."""
    norm = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in rows]
    out = []
    for i, t, k in norm:
        group = [(x, u) for x, u, y in norm if y == k]
        best = min(group, key=lambda g: (-len(g[1]), g[0] is None, g[0] or 0))
        kept = (i is None and len(t) == len(best[1])) if best[0] is None else i == best[0]
        out.append((i, best[0], len(group), kept))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert shown(exact_dedup.exact_groups(awkward)) == brute(rows)


def test_collisions_of_digests_keep_texts_apart(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert shown(exact_dedup.exact_groups(awkward, digest_bits=4)) == brute(rows)


def test_null_ids_alone(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "ab")], "doc_id long, text string")
    assert shown(exact_dedup.exact_groups(df)) == brute([(None, "a b"), (None, "ab")])


def test_empty_table(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.exact_dedup(nothing).columns == nothing.columns


def test_filter_keeps_one_of_each_group_and_all_columns(awkward):
    kept = exact_dedup.exact_dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [2, 5, 6, 7, 8, 9, 10, 11]


def test_filter_keeps_one_row_of_each_text_whatever_its_id(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, "c"), (None, "d e"), (None, "de"), (None, "d e"), (3, "a"), (None, "b")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, _row_number int")
    for bits in (256, 4):
        kept = exact_dedup.exact_dedup(df, digest_bits=bits)
        assert kept.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a"), (1, "b"), (2, "c"), (None, "d e")], key=repr)


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else concat('t', id) end as text").repartition(16)
    rows = exact_dedup.exact_groups(df).where("group_size > 1").collect()
    assert len(rows) == 1000 and {r.keep_id for r in rows} == {0} and sum(r.kept for r in rows) == 1


def test_against_sql(spark):
    got = {tuple(r) for r in queries.op4_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = set(con.sql(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({queries.oracle_sql()['op4_exact_dedup']})").fetchall())
    assert got == want


def test_no_python_in_the_plan(spark):
    plan = queries.op4_exact_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
