"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.session import materialize


def text_or_empty(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids fall in bucket -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


def give_back() -> None:
    """Return memory that Python has freed to the system, which else a driver holds as long as it lives."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written and read again with a number for each row, and the name of that column.

    Filters act on rows: ids may repeat, and so may whole rows. Only a table that is written
    has numbers which stay the same however often it is read.
    """
    name = "_row_number"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    table, _ = materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", codec="zstd")
    return table, name


def drop_rows(table: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """A numbered table without the rows whose numbers are in the one column of ``gone``.

    The numbers are written first: where they are few, Spark sees it and the rows of the
    table stay where they are; else both sides are dealt by number, which is never skewed.
    """
    gone, _ = materialize(gone.toDF("_gone_row"), "gone")
    return table.join(gone, table[name] == gone["_gone_row"], "left_anti").drop(name)
