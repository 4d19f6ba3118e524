"""Exact deduplication by skew-safe combining, in DataFrame functions alone.

Three combines, each of which groups by digest *and* whole normalised text, so that no two
different texts are ever merged on the word of a hash:

1. inside every input partition (the map side of the first aggregation),
2. over ``(digest, salt)``, where the salt is the input partition modulo ``salts``: a group
   that holds a third of all rows arrives as one row for each partition, spread over
   ``salts`` reducers,
3. over the digest, to which every group now brings ``salts`` rows at most.

The decisions go back to the rows by a narrow join of 32-byte digests; adaptive execution
splits it where a digest is hot. Should two texts share a digest, the job sees it in step 3
and joins by digest and text instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import drop_rows, numbered, text_or_empty
from girder.session import discard, materialize

#: Characters that equality ignores.
BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 32

# Rank of a row within its group, as one fixed-width number that the hash aggregate can
# update in place: more code points first, then the smaller id, null ids last.
_OFFSET = "cast(9223372036854775808 as decimal(20,0))"
_SPAN = "cast(36893488147419103232 as decimal(20,0))"
_NULL_ID = "cast(18446744073709551616 as decimal(20,0))"
_RANK = f"cast(cast(_cp as decimal(10,0)) * {_SPAN} - coalesce(cast(_id as decimal(20,0)) + {_OFFSET}, {_NULL_ID}) as decimal(38,0))"


def _digests(docs: DataFrame, id_col: str, text_col: str, digest_bits: int, row_col: str | None) -> DataFrame:
    text, row = text_or_empty(text_col), F.col(row_col) if row_col else F.lit(0).cast("long")
    return (
        docs.select(F.col(id_col).cast("long").alias("_id"), row.alias("_row"), text.alias("_text"))
        .select("_id", "_row", F.length("_text").alias("_cp"), F.regexp_replace("_text", BLANKS, "").alias("_norm"))
        .withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256))
        .withColumn("_key", F.substring("_sha", 1, max(1, digest_bits // 4)))
    )


def _combine(rows: DataFrame, salts: int) -> DataFrame:
    """One row for each text: its best rank and how many rows hold it."""
    local = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .withColumn("_rank", F.expr(_RANK))
        .groupBy("_key", "_salt", "_norm")
        .agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"))
    )
    return local.groupBy("_key", "_norm").agg(F.max("_rank").alias("_rank"), F.sum("_n").alias("_n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest_bits: int = 256) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without the blanks of :data:`BLANKS`. The row with the
    most code points stays, then the one with the smallest id. Null texts count as empty,
    and all empty texts are one group. A null id ranks last; in a group of null ids alone
    ``keep_id`` is null and its longest rows are kept. Rows that repeat the id that stays
    are kept together. An empty table gives an empty result; other columns are ignored.
    ``digest_bits`` under 256 only serves to test the handling of collisions.
    """
    joined, _ = _judged(docs, id_col, text_col, salts, digest_bits)
    return joined.select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long"),
        "kept",
        F.col("_sha").alias("text_sha256"),
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, salts: int, digest_bits: int = 256, row_col: str | None = None) -> tuple[DataFrame, list[str]]:
    """Every row with the decision on its text, and the columns that tell texts apart."""
    rows = _digests(docs, id_col, text_col, digest_bits, row_col)
    decided = _decide(_combine(rows, salts))
    decisions, path = materialize(decided.drop("_norm"), "exact-dedup")
    if decisions.groupBy("_key").count().where("count > 1").isEmpty():
        by = ["_key"]
        joined = rows.drop("_norm").join(decisions, by)
    else:  # different texts share a digest
        discard(docs.sparkSession, path)
        by = ["_key", "_norm"]
        joined = rows.join(decided, by)
    kept = F.when(F.col("keep_id").isNull(), F.col("_id").isNull() & (F.col("_cp") == F.col("_best_cp"))).otherwise(F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)))
    return joined.withColumn("kept", kept), by


def _decide(best: DataFrame) -> DataFrame:
    """Reads keep_id and the code points back from the best rank of each text."""
    # The id's part of a rank lies within [0, _SPAN), so that ceil() finds the code points.
    return (
        best.withColumn("_best_cp", F.expr(f"cast(ceil(_rank / {_SPAN}) as long)"))
        .withColumn("_rest", F.expr(f"cast(_best_cp as decimal(10,0)) * {_SPAN} - _rank"))
        .select(
            "_key",
            "_norm",
            "_best_cp",
            F.col("_n").alias("group_size"),
            F.expr(f"case when _rest <> {_NULL_ID} then cast(_rest - {_OFFSET} as long) end").alias("keep_id"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest_bits: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one for each text.

    It is the one that :func:`exact_groups` names; of rows that repeat its id one stays.
    Nulls, empty texts and empty tables are as there. Columns of any name pass through.
    """
    table, row = numbered(docs)
    judged, by = _judged(table, id_col, text_col, salts, digest_bits, row)
    judged, _ = materialize(judged.where("group_size > 1").select("_row", "_cp", "kept", *by), "exact-copies")
    best = judged.where("kept").groupBy(*by).agg(F.min(F.struct(-F.col("_cp"), "_row")).alias("_best"))
    stay = best.select(F.col("_best._row").alias("_stays"))
    return drop_rows(table, row, judged.join(stay, F.col("_row") == F.col("_stays"), "left_anti").select("_row"))
