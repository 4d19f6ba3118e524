"""A content-addressed WARC archive.

Two tables hold the archive: ``payloads`` has every distinct payload once, under its
SHA-256, and ``headers`` has the exact header block of every record. A record is put
together again by joining the two, and each stored payload is verified against its
address and the digest of its header whenever it is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.session import discard, materialize

CRLF = "\r\n"
#: RFC 4648 alphabet (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Profile of revisits by identical payload (fixed value of WARC 1.1).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD_URN = "urn:girder:page:"
#: An address is popular that more than one in so many rows have.
HOT = 1000


@dataclass(frozen=True)
class Archive:
    """Paths and tables of an archive."""

    headers: DataFrame
    payloads: DataFrame
    headers_path: str
    payloads_path: str


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1."""
    out = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks in it are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> Archive:
    """Write one record for each row of ``pages``.

    Of equal payloads of ``min_bytes`` or more, the rows with the smallest id are responses
    and the others revisit it; smaller payloads are all responses. A null payload is empty.
    A null id ranks last; where a payload has null ids alone, all its records are responses.
    An id that comes twice with the same payload gives two responses, of one stored payload.
    A null URL leaves out the target line. An empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))

    # The payload is stored once: equal ones meet on the map side first, so a payload that
    # a third of all pages share reaches its reducer once from each map task.
    stored = rows.groupBy("address").agg(F.max("payload").alias("payload"), F.min("payload").alias("_least"))
    stored = stored.withColumn("payload", F.when(F.col("payload") == F.col("_least"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the SHA-256 "), F.col("address")))))
    payloads, payloads_path = materialize(stored.select("address", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"), "payload"), "warc-payloads")

    narrow, narrow_path = materialize(rows.select("page_id", "url", "address", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1")), "warc-rows")
    heads = _with_first(narrow)
    revisit = (F.col("n") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    block = F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{RECORD_URN}"), F.col("page_id").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{RECORD_URN}"), F.col("first_id").cast("string"), F.lit(">")))),
        _line("Content-Type", F.when(revisit, F.lit("message/http")).otherwise(F.lit("text/html; charset=utf-8"))),
        _line("Content-Length", block),
        F.lit(CRLF),
    )
    headers, headers_path = materialize(heads.select("page_id", revisit.alias("is_revisit"), "address", "n", F.encode(header, "UTF-8").alias("header")), "warc-headers")
    discard(pages.sparkSession, narrow_path)
    return Archive(headers, payloads, headers_path, payloads_path)


def _with_first(rows: DataFrame) -> DataFrame:
    """Each row with ``first_id``, the smallest ``page_id`` of its address.

    Addresses of more than a thousandth of all rows, of which there are a thousand at most,
    are broadcast, so that no task of the join gathers the rows of a popular payload.
    """
    firsts = rows.groupBy("address").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_rows"))
    firsts, _ = materialize(firsts, "warc-firsts")
    often = F.col("_rows") * HOT > rows.count()
    hot = F.broadcast(firsts.where(often).select("address", "first_id"))
    # rows of other addresses take part in the second join, where none is frequent
    rare = firsts.where(~often).select(F.col("address").alias("_address"), F.col("first_id").alias("_first"))
    known = rows.join(hot, "address")
    rest = rows.join(hot.select("address"), "address", "left_anti").join(rare, F.col("address") == F.col("_address"))
    return known.select(*rows.columns, "first_id").unionByName(rest.select(*rows.columns, F.col("_first").alias("first_id")))


def open_archive(spark: SparkSession, headers_path: str, payloads_path: str) -> Archive:
    return Archive(spark.read.parquet(headers_path), spark.read.parquet(payloads_path), headers_path, payloads_path)


def records(archive: Archive) -> DataFrame:
    """The original records, byte for byte: ``page_id, address, n, record``.

    ``n`` is the length of the payload, which a revisit's record doesn't hold. Only
    responses need a payload; those of one payload share an id, so the join has no hot key
    beyond repeated rows.
    """
    end = F.lit((CRLF * 2).encode()).cast("binary")
    heads = archive.headers
    plain = heads.where("is_revisit").select("page_id", "address", "n", F.concat("header", end).alias("record"))
    full = heads.where("not is_revisit").join(archive.payloads.select("address", "payload"), "address")
    return plain.unionByName(full.select("page_id", "address", "n", F.concat("header", "payload", end).alias("record")))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one WARC record; an error where it is cut or malformed."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split(CRLF)
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block of {fields.get('WARC-Record-ID')} isn't {n} bytes long")
    return fields, rest[:n]


def _id(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{RECORD_URN}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


_PARSED = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for address, n, record in zip(batch["address"], batch["n"], batch["record"], strict=True):
            fields, block = parse_record(record)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response":
                if len(block) != n or hashlib.sha256(block).hexdigest() != address or base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                    raise ValueError(f"the payload of {fields.get('WARC-Record-ID')} doesn't match its digests")
            out.append((_id(fields.get("WARC-Record-ID")), fields["WARC-Type"], _id(fields.get("WARC-Refers-To")), digest, n))
        cols = [f.split()[0] for f in _PARSED.split(", ")]
        made = pd.DataFrame(out, columns=cols)
        for c in ("page_id", "refers_to", "payload_bytes"):
            made[c] = made[c].astype("Int64")
        yield made


def read_records(archive: Archive) -> DataFrame:
    """Read an archive back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Every payload is verified against its address, its length and the digest of its
    response; a revisit has the length of the payload it refers to, and its digest must be
    that of the stored payload of its address. An empty archive gives an empty result.
    """
    pairs = archive.headers.where("is_revisit").select("address", F.regexp_extract(F.col("header").cast("string"), r"WARC-Payload-Digest: sha1:(\w+)", 1).alias("digest")).distinct()
    told = pairs.join(archive.payloads.select("address", base32_of_hex(F.col("sha1")).alias("stored")), "address", "left")
    if not told.where(~F.col("digest").eqNullSafe(F.col("stored"))).isEmpty():
        raise ValueError("the digest of a revisit isn't that of the payload of its address")
    return records(archive).select("address", "n", "record").mapInPandas(_parse_batches, _PARSED).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
