"""The contract queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import bpe, decontam, exact_dedup, license_scan, maxent_lm, quality, secrets, simhash, toxicity, warc
from girder.llm.common import crc_bucket
from girder.session import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = quality.score_documents(docs, quality.fit(docs, labels, "quality", modulus=5, held_remainder=0))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))

    def joined(finds):
        return F.array_join(F.transform(finds, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    base = F.filter("finds", lambda f: f["decoded_by"] == "")

    def count(kind: str):
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("finds")).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_archive(read_table(spark, sf_dir, "pages")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels, "toxic", modulus=4, held_remainder=2))
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(read_table(spark, sf_dir, "documents"), modulus=7, held_remainder=2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_secrets": op2_secrets,
        "op3_warc": op3_warc,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_toxicity": op6_toxicity,
        "op7_language_model": op7_language_model,
        "op8_bpe": op8_bpe,
        "op9_license_scan": op9_license_scan,
        "op10_simhash": op10_simhash,
    }


_BASE32_SQL = " || ".join(
    f"substr('{warc.BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::int >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

_OP3_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) b from pages),
     d as (select page_id, octet_length(b) n, sha1(b) h, min(page_id) over (partition by b) first_id from p)
select page_id, n::bigint payload_bytes, {_BASE32_SQL} payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id <> first_id then first_id end refers_to
from d
"""

_OP4_SQL = r"""
with m as (select doc_id, length(coalesce(text, '')) cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') k from documents),
     w as (select *, first_value(doc_id) over (partition by k order by cp desc, doc_id) keep_id, count(*) over (partition by k) group_size from m)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(k) text_sha256 from w
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _OP3_SQL, "op4_exact_dedup": _OP4_SQL}
