"""Commit logs: git's text and its rows."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.functions.names import rename_target

FORMAT = "%H|%aI|%aN"


def is_repository(root: str) -> bool:
    try:
        said = subprocess.run(["git", "rev-parse", "--is-inside-work-tree"], cwd=root, capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return False
    return said.returncode == 0


def read_log(spark: SparkSession, root: str, days: int = 90) -> DataFrame | None:
    """``line_no, line`` of the log of the last ``days``; None where there is no repository or no commit.

    A log that git can't give is an error, not an empty history.
    """
    if not is_repository(root) or subprocess.run(["git", "rev-parse", "--verify", "-q", "HEAD"], cwd=root, capture_output=True).returncode:
        return None
    said = subprocess.run(["git", "log", f"--since={days} days ago", f"--format={FORMAT}", "--numstat", "--diff-filter=ACDMR", "--no-merges"], cwd=root, capture_output=True, text=True, errors="replace")
    if said.returncode:
        raise RuntimeError(f"git log failed in {root}: {said.stderr.strip()}")
    return spark.createDataFrame(list(enumerate(said.stdout.splitlines())), "line_no long, line string")


def parse_log(lines: DataFrame, log: str | None = None) -> DataFrame:
    """``hash, author, author_date, added, removed, path`` from ``line_no, line``.

    A header has exactly two bars; the file lines up to the next header are its commit's.
    ``log`` names a column that tells several logs apart; each log is one sequence.
    """
    keys = [log] if log else []
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marked = lines.withColumn("_text", text).withColumn("_head", F.when(bars == 2, text))
    carried = marked.withColumn("_head", F.last("_head", ignorenulls=True).over(order))
    part, head = F.split("_text", "\t"), F.split("_head", r"\|")
    files = carried.where(F.size(part) == 3)
    return files.select(
        *keys,
        F.get(head, F.lit(0)).alias("hash"),
        F.get(head, F.lit(2)).alias("author"),
        F.try_to_timestamp(F.get(head, F.lit(1))).alias("author_date"),
        F.coalesce(F.get(part, F.lit(0)).try_cast("int"), F.lit(0)).alias("added"),
        F.coalesce(F.get(part, F.lit(1)).try_cast("int"), F.lit(0)).alias("removed"),
        F.replace(rename_target(F.get(part, F.lit(2))), F.lit("\\"), F.lit("/")).alias("path"),
    )
