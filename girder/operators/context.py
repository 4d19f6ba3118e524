"""What there is to know about one module or several before changing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.config import Thresholds
from girder.operators.insights import risk

#: Insights in a compact context, related modules (fixed values).
TOP_INSIGHTS, RELATED = 3, 8


def measures(metrics: DataFrame, reached: DataFrame, cycles_of: DataFrame | None = None) -> DataFrame:
    """Metrics with ``direct, transitive, cycle_count, largest_cycle`` for insights and risk.

    ``reached`` has all pairs ``seed, node``; ``cycles_of`` has ``id, cycle_count, largest_cycle``.
    A module on a cycle counts among its own transitive dependents.
    """
    far = reached.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("transitive"))
    rows = metrics.join(far, "id", "left").withColumn("direct", F.col("ca"))
    if cycles_of is None:
        rows = rows.withColumn("cycle_count", F.lit(0)).withColumn("largest_cycle", F.lit(0))
    else:
        rows = rows.join(cycles_of, "id", "left")
    return rows.fillna({"transitive": 0, "cycle_count": 0, "largest_cycle": 0})


def cycles_of(cycles: DataFrame) -> DataFrame:
    member = cycles.select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("id"), "length")
    return member.groupBy("id").agg(F.count(F.lit(1)).alias("cycle_count"), F.max("length").alias("largest_cycle"))


def related(edges: DataFrame, cycles: DataFrame | None = None, limit: int = RELATED) -> DataFrame:
    """``id, related, place``: partners on a cycle, then dependencies that share two dependents or more."""
    e = edges.select("source", "target").distinct()
    shared = (
        e.select(F.col("source").alias("id"), F.col("target").alias("related"))
        .join(e.select(F.col("source").alias("by"), F.col("target").alias("id")), "id")
        .join(e.select(F.col("source").alias("by"), F.col("target").alias("related")), ["by", "related"])
        .groupBy("id", "related").agg(F.count(F.lit(1)).alias("n")).where("n >= 2 and id <> related")
        .select("id", "related", F.lit(1).alias("kind"))
    )
    rows = shared
    if cycles is not None:
        member = cycles.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("m"))
        partner = member.select(F.explode("m").alias("id"), "m").select("id", F.explode("m").alias("related")).where("id <> related").distinct()
        rows = shared.unionByName(partner.select("id", "related", F.lit(0).alias("kind")))
    once = rows.groupBy("id", "related").agg(F.min("kind").alias("kind"))
    place = Window.partitionBy("id").orderBy("kind", "related")
    return once.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).select("id", "related", "place")


def _listed(edges: DataFrame, by: str, other: str, name: str) -> DataFrame:
    return edges.select(F.col(by).alias("id"), F.col(other).alias("x")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("x")).alias(name))


def compact(measured: DataFrame, edges: DataFrame, found: DataFrame, cost: DataFrame, near: DataFrame, churned: DataFrame | None = None, t: Thresholds | None = None, report: DataFrame | None = None) -> DataFrame:
    """One row for each module with what a reader needs first.

    ``found`` has the insights, ``cost`` the edit cost, ``near`` the related modules. With
    ``churned`` (by ``id``) there is ``churn``, with the cycle report ``cycles`` of path and kind.
    """
    top = found.where(F.col("place") <= TOP_INSIGHTS).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]).alias("insights"))
    beside = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "related"))), lambda x: x["related"]).alias("related"))
    rows = (
        measured.join(_listed(edges, "source", "target", "deps"), "id", "left").join(_listed(edges, "target", "source", "dependents"), "id", "left")
        .join(top, "id", "left").join(beside, "id", "left").join(cost.select("id", F.col("files").alias("edit_files"), F.col("tokens").alias("edit_tokens"), F.col("risk").alias("edit_risk")), "id", "left")
    )
    if churned is not None:
        rows = rows.join(churned.select("id", F.col("category").alias("churn")), "id", "left")
    rows = rows.withColumn("risk", risk(t)).withColumn("transitive_impact", F.col("transitive"))
    keep = ["id", "name", "loc", "role", "arch_role", "health", "cc", "cog", "ca", "ce", F.round("instability", 3).alias("instability"), "deps", "dependents", "transitive_impact", "edit_files", "edit_tokens", "edit_risk", "insights", "risk", "related"]
    if report is not None:
        rows = rows.join(_cycles_by_member(report, "path", "kind"), "id", "left")
    return rows.select(*keep, *(["churn"] if churned is not None else []), *(["cycles"] if report is not None else []))


def _cycles_by_member(report: DataFrame, *told: str | Column) -> DataFrame:
    """``id, cycles``: the cycles of each module, in the report's order."""
    member = report.select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("id"), F.struct("place", *told).alias("c"))
    return member.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.dropFields("place")).alias("cycles"))


def as_json(rows: DataFrame, key: str = "id") -> DataFrame:
    """``id, json``: each row as JSON without its nulls and empty texts."""
    fields = [F.when(F.col(n) != "", F.col(n)).alias(n) if kind == "string" else F.col(n) for n, kind in rows.dtypes if n != key]
    return rows.select(key, F.to_json(F.struct(*fields)).alias("json"))


def full(measured: DataFrame, edges: DataFrame, found: DataFrame, cost: DataFrame, near: DataFrame, symbols: DataFrame, t: Thresholds | None = None, report: DataFrame | None = None, churned: DataFrame | None = None) -> DataFrame:
    """The compact row with import counts, symbols, every insight, impact and all metrics; lists are in order.

    Edges with ``lines`` and flags give these too. ``report`` is the cycle report and ``churned`` the
    churn by ``id``; without them there are no ``cycles`` and no ``git``.
    """
    def listed(by: str, other: str, name: str) -> DataFrame:
        extra = [c for c in ("lines", "is_type_only", "is_deferred") if c in edges.columns]
        items = F.array_sort(F.collect_list(F.struct(F.col(other).alias("module"), F.col("import_count").alias("count"), *extra)))
        return edges.groupBy(F.col(by).alias("id")).agg(items.alias(name), F.count_distinct(other).alias(f"{name}_count"))

    have = [c for c in ("value", "severity", "detail") if c in found.columns]
    every = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "code", *have))), lambda x: F.struct(*[x[c].alias(c) for c in ("code", *have)])).alias("all_insights"))
    described = [c for c in ("line", "method_count", "complexity") if c in symbols.columns]
    names = symbols.groupBy(F.col("module").alias("id")).agg(F.count(F.lit(1)).alias("symbol_count"), F.array_sort(F.collect_list(F.struct("name", "kind", *described))).alias("symbols"))
    more = [c for c in ("rel_path", "language", "package", "raw_health", "abstractness", "distance", "centrality", "class_count", "function_count", "method_count", "parse_error") if c in measured.columns]
    rows = compact(measured, edges, found, cost, near, t=t).drop("insights", "deps", "dependents")
    rows = rows.join(measured.select("id", *more, F.struct(F.col("direct"), F.col("transitive")).alias("impact")), "id").withColumn("threshold_profile", F.lit((t or Thresholds()).profile))
    for part in (listed("source", "target", "dependencies"), listed("target", "source", "dependents"), every, names):
        rows = rows.join(part, "id", "left")
    rows = rows.fillna(0, ["dependencies_count", "dependents_count", "symbol_count"])
    if report is not None:
        rows = rows.join(_cycles_by_member(report, "path", "severity", "kind", F.struct("source", "target").alias("break_at")), "id", "left")
    if churned is not None:
        rows = rows.join(churned.select("id", F.struct("commits", "lines", "days", "category", "authors", "last_changed").alias("git")), "id", "left")
    return rows


def shared_dependencies(edges: DataFrame, ids: list) -> DataFrame:
    """``id, users``: what at least two of the modules import."""
    return edges.where(F.col("source").isin(ids)).groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("users")).where("users >= 2")


def batch(edges: DataFrame, reached: DataFrame, ids: list) -> DataFrame:
    """``id, direct_dependency, direct_dependent, transitive_dependent`` of everything that several modules touch, themselves left out."""
    def marked(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("x").alias("id"), F.lit(name).alias("how"))

    parts = (
        marked(edges.where(F.col("source").isin(ids)).select(F.col("target").alias("x")), "dependency")
        .unionByName(marked(edges.where(F.col("target").isin(ids)).select(F.col("source").alias("x")), "dependent"))
        .unionByName(marked(reached.where(F.col("node").isin(ids)).select(F.col("seed").alias("x")), "transitive"))
        .where(~F.col("id").isin(ids))
    )
    return parts.groupBy("id").agg(*[F.bool_or(F.col("how") == h).alias(f"is_{h}") for h in ("dependency", "dependent", "transitive")])
