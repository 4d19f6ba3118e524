"""Cycle reports: elementary cycles within strong components, their severity, break and kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators.graph import strong_components

#: Longest cycle that is listed, and how many of a component (fixed values).
LONGEST, CAP = 10, 51


def elementary_cycles(edges: DataFrame, components: DataFrame | None = None, longest: int = LONGEST, cap: int = CAP) -> DataFrame:
    """``scc, path, length``: cycles of 2 to ``longest`` nodes; ``path`` ends where it starts.

    A cycle is listed once, from its smallest node. Of a component the ``cap`` first by
    length, then path, are listed: lengths are gone through one after the other, so that a
    dense component costs no more than those.
    """
    components = strong_components(edges) if components is None else components
    kind = dict(edges.dtypes)["source"]
    c = components
    inner = edges.select("source", "target").where("source <> target").distinct()
    inner = inner.join(c.select(F.col("id").alias("source"), "scc"), "source").join(c.select(F.col("id").alias("target"), F.col("scc").alias("_scc")), "target").where("scc = _scc").drop("_scc")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for s, t in zip(rows["source"].tolist(), rows["target"].tolist(), strict=True):
            after.setdefault(s, []).append(t)
        for targets in after.values():
            targets.sort()
        out: list[list] = []
        for length in range(2, longest + 1):
            for start in sorted(after):
                _extend(after, [start], length, out, cap)
                if len(out) >= cap:
                    break
            if len(out) >= cap:
                break
        if not out:
            return pd.DataFrame()
        return pd.DataFrame({"scc": [rows["scc"].iloc[0]] * len(out), "path": out, "length": [len(p) - 1 for p in out]})

    return inner.groupBy("scc").applyInPandas(walk, f"scc {kind}, path array<{kind}>, length int")


def _extend(after: dict, path: list, length: int, out: list[list], cap: int) -> None:
    """Append to ``out`` the cycles of exactly ``length`` nodes that begin with ``path``, in order."""
    stack = [iter(after.get(path[-1], ()))]
    inside = set(path)
    while stack:
        for nxt in stack[-1]:
            if len(path) == length:
                if nxt == path[0]:
                    out.append([*path, nxt])
                    if len(out) >= cap:
                        return
            elif nxt > path[0] and nxt not in inside:
                path.append(nxt)
                inside.add(nxt)
                stack.append(iter(after.get(nxt, ())))
                break
        else:
            stack.pop()
            if stack:
                inside.discard(path.pop())


def _steps(cycles: DataFrame) -> DataFrame:
    """One row for each edge of each cycle, with its place."""
    pairs = F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("s"), F.slice("path", F.lit(2), F.size("path") - 1).alias("t"))
    return cycles.select("path", F.posexplode(pairs).alias("pos", "e")).select("path", "pos", F.col("e.s").alias("source"), F.col("e.t").alias("target"))


def severity(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, length, outside, severity``: how many importers outside the cycle its members have."""
    member = _steps(cycles).select("path", F.col("source").alias("member"))
    into = edges.select(F.col("source").alias("importer"), F.col("target").alias("member")).distinct()
    outside = member.join(into, "member").where(~F.array_contains("path", F.col("importer"))).groupBy("path").agg(F.count(F.lit(1)).alias("outside"))
    n, size = F.col("outside"), F.col("length")
    label = F.when((n > 10) | (size > 5), "critical").when((n > 5) | (size > 3), "high").when(n > 2, "medium").otherwise("low")
    return cycles.select("path", "length").join(outside, "path", "left").fillna({"outside": 0}).withColumn("severity", label)


def breaks(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, source, target``: the edge with the fewest imports, halved where the target has further importers."""
    ca = edges.groupBy("target").agg(F.count_distinct("source").alias("ca"))
    count = edges.groupBy("source", "target").agg(F.sum("import_count").alias("n"))
    scored = _steps(cycles).join(count, ["source", "target"]).join(ca, "target").withColumn("score", F.col("n") * F.when(F.col("ca") > 1, 0.5).otherwise(1.0))
    return scored.groupBy("path").agg(F.min_by(F.struct("source", "target"), F.struct("score", "pos")).alias("e")).select("path", "e.source", "e.target")


def kinds(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, kind``: type_only or deferred if every edge is, else runtime."""
    flags = _steps(cycles).join(edges.select("source", "target", "is_type_only", "is_deferred"), ["source", "target"]).groupBy("path").agg(F.bool_and("is_type_only").alias("t"), F.bool_and("is_deferred").alias("d"))
    return flags.select("path", F.when(F.col("t"), "type_only").when(F.col("d"), "deferred").otherwise("runtime").alias("kind"))


def report(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """All of the above, with the place of each cycle in the report."""
    joined = severity(cycles, edges).join(breaks(cycles, edges), "path").join(kinds(cycles, edges), "path")
    rank = F.when(F.col("kind") == "runtime", 0).when(F.col("kind") == "deferred", 1).otherwise(2)
    grave = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    keyed = joined.withColumn("_kind", rank).withColumn("_severity", grave)
    place = Window.orderBy("_kind", "_severity", "length", "path")  # at most CAP cycles of a component
    return keyed.withColumn("place", F.row_number().over(place)).drop("_kind", "_severity")


def participation(cycles: DataFrame) -> DataFrame:
    """``id, cycles``: in how many reported cycles a node is."""
    return _steps(cycles).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("cycles"))


def cycle_edges(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge, and whether a reported cycle takes it."""
    taken = _steps(cycles).select("source", "target").distinct().withColumn("is_cycle_member", F.lit(True))
    return edges.select("source", "target").join(taken, ["source", "target"], "left").fillna({"is_cycle_member": False})
