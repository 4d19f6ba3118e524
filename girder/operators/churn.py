"""Commit history: churn of files and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def churn(commit_files: DataFrame, now: Column) -> DataFrame:
    """``path, commits, lines, authors, first_seen, last_changed, days``.

    ``commit_files`` has ``path, author, author_date, added, removed``, a row for each file
    of each commit; ``now`` is the day from which days are counted, for files without a
    date as well.
    """
    last = F.coalesce(F.max("author_date"), now)
    days = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))) / 86400)
    return commit_files.groupBy("path").agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum(F.col("added") + F.col("removed")).alias("lines"),
        F.count_distinct("author").alias("authors"),
        F.date_format(F.coalesce(F.min("author_date"), now), "yyyy-MM-dd").alias("first_seen"),
        F.date_format(last, "yyyy-MM-dd").alias("last_changed"),
        F.greatest(days, F.lit(0)).cast("long").alias("days"),
    )


def category(commits: Column, days: Column) -> Column:
    return (
        F.when(commits == 0, "frozen")
        .when((commits >= 10) | ((days <= 7) & (commits >= 5)), "hot")
        .when((commits >= 3) & (days <= 30), "warm")
        .otherwise("cold")
    )


def within(commit_files: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return commit_files.where(F.col("author_date") >= now - F.expr(f"interval {days} days"))


def summary(commit_files: DataFrame) -> DataFrame:
    return commit_files.agg(F.count_distinct("hash").alias("commits"), F.count_distinct("path").alias("files"), F.count_distinct("author").alias("authors"))


def hotspots(churned: DataFrame, complexity: DataFrame, limit: int = 20) -> DataFrame:
    """Complexity times commits, fading with age; ``complexity`` has ``path, id, cc``."""
    score = F.round(F.col("cc") * F.col("commits") * F.exp(-F.col("days") / 30.0), 1)
    return churned.join(complexity, "path").withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)
