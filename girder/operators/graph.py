"""Graph operators over ``nodes(id, ...)`` and ``edges(source, target, ...)``; ids of any one type.

Searches have two forms with the same rows. Edges up to :data:`BROADCAST_EDGES`, counted
before, are broadcast and searched from every seed in parallel; more edges are expanded by
joins, round by round, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.session import discard, materialize

BROADCAST_EDGES = 500_000
#: Sources whose shortest paths are counted at a time in graphs beyond that.
SEEDS_AT_ONCE = 4_096


def build_edges(imports: DataFrame, nodes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One edge for each pair of different known nodes that imports join.

    ``imports`` has ``source, target, line, is_type_checking, is_deferred`` and the columns
    of ``order``, by which the lines are listed. Flags hold if they hold for every import.
    """
    known = nodes.select(F.col("id").alias("target"))
    place = [*(order or []), "line"]
    rows = imports.where("source <> target").join(known, "target", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*place))), lambda x: x["line"])
    return rows.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("import_count"),
        listed.alias("lines"),
        F.bool_and("is_type_checking").alias("is_type_only"),
        F.bool_and("is_deferred").alias("is_deferred"),
    )


def dependencies(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("source") == node).select(F.col("target").alias("id")).distinct()


def dependents(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("target") == node).select(F.col("source").alias("id")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


class Adjacency:
    """A graph as sorted labels and row pointers."""

    def __init__(self, pairs: list[tuple]) -> None:
        self.labels = sorted({x for p in pairs for x in p})
        self.at = {x: i for i, x in enumerate(self.labels)}
        s = np.array([self.at[a] for a, _ in pairs], np.int64)
        t = np.array([self.at[b] for _, b in pairs], np.int64)
        order = np.lexsort((t, s))
        self.targets = t[order]
        self.first = np.searchsorted(s[order], np.arange(len(self.labels) + 1))

    def out(self, rows: np.ndarray) -> np.ndarray:
        """Targets of all edges that leave ``rows``."""
        n = self.first[rows + 1] - self.first[rows]
        start = np.repeat(self.first[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return self.targets[start + np.arange(n.sum())] if len(rows) else np.zeros(0, np.int64)

    def distances(self, seed: int, most: int | None = None) -> np.ndarray:
        """Steps to every node, -1 where there is no way; the seed's own entry is its shortest way back."""
        far = np.full(len(self.labels), -1, np.int64)
        front, step = np.array([seed]), 0
        while len(front) and (most is None or step < most):
            step += 1
            front = np.unique(self.out(front))
            front = front[far[front] < 0]
            far[front] = step
        return far


def small(edges: DataFrame, most: int = BROADCAST_EDGES) -> Adjacency | None:
    """The graph itself if it has at most ``most`` edges, else None."""
    rows = edges.select("source", "target").distinct().limit(most + 1).collect()
    return Adjacency([tuple(r) for r in rows]) if len(rows) <= most else None


def reach(edges: DataFrame, seeds: DataFrame | None = None, most: int | None = None, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """``seed, node, steps``: every node that a seed has a way to, and the fewest steps.

    A seed reaches itself if and only if it is on a cycle. ``seeds`` has a column ``seed``;
    without it every source is one. ``most`` bounds the steps.
    """
    if seeds is None:
        seeds = edges.select(F.col("source").alias("seed"))
    seeds = seeds.select("seed").distinct()
    graph = small(edges, broadcast_edges)
    if graph is None:
        return _reach_by_joins(edges, seeds, most)
    kind = dict(edges.dtypes)["source"]
    shared = edges.sparkSession.sparkContext.broadcast(graph)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        labels = np.array(g.labels, object)
        for batch in batches:
            for seed in batch["seed"].tolist():
                if seed in g.at:
                    far = g.distances(g.at[seed], most)
                    hit = np.flatnonzero(far >= 0)
                    if len(hit):
                        yield pd.DataFrame({"seed": [seed] * len(hit), "node": labels[hit], "steps": far[hit]})

    return _spread(seeds, graph).mapInPandas(search, f"seed {kind}, node {kind}, steps long")


def _spread(seeds: DataFrame, graph: Adjacency) -> DataFrame:
    """Seeds dealt out so that every core has work."""
    return seeds.repartition(max(1, min(256, len(graph.labels) // 16)), "seed")


def _reach_by_joins(edges: DataFrame, seeds: DataFrame, most: int | None) -> DataFrame:
    spark = edges.sparkSession
    steps = edges.select(F.col("source").alias("via"), F.col("target").alias("node")).distinct()
    first = seeds.join(steps, seeds["seed"] == steps["via"]).select("seed", "node").distinct()
    front, last = materialize(first.withColumn("steps", F.lit(1).cast("long")), "front")
    known, path = materialize(front, "known")
    n = 1
    while not front.isEmpty() and (most is None or n < most):
        n += 1
        made = front.select("seed", F.col("node").alias("via")).join(steps, "via").select("seed", "node").distinct()
        front, new = materialize(made.join(known, ["seed", "node"], "left_anti").withColumn("steps", F.lit(n).cast("long")), "front")
        discard(spark, last)
        last = new
        known, new = materialize(known.unionByName(front), "known")
        discard(spark, path)
        path = new
    discard(spark, last)
    return known


def shortest_paths(edges: DataFrame, pairs: DataFrame, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """``source, target, path``: of the shortest paths the first in order; no row where there is none.

    A node's path to itself is the node alone.
    """
    graph = small(edges, broadcast_edges)
    if graph is None:
        return _paths_by_joins(edges, pairs)
    kind = dict(edges.dtypes)["source"]
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(graph)
    turned = spark.sparkContext.broadcast(Adjacency([(graph.labels[t], graph.labels[s]) for s in range(len(graph.labels)) for t in graph.targets[graph.first[s] : graph.first[s + 1]]]))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, back = shared.value, turned.value
        for batch in batches:
            out = []
            for target, rows in batch.groupby("target", sort=False):
                far = back.distances(back.at[target]) if target in back.at else None
                for source in rows["source"].tolist():
                    if source == target:
                        out.append((source, target, [source]))
                    elif far is not None and source in g.at and far[g.at[source]] > 0:
                        at, path = g.at[source], [source]
                        goal = g.at[target]
                        while at != goal:
                            after = g.targets[g.first[at] : g.first[at + 1]]
                            at = int(min(x for x in after if x == goal and far[at] == 1 or far[x] == far[at] - 1 and x != goal))
                            path.append(g.labels[at])
                        out.append((source, target, path))
            if out:
                yield pd.DataFrame(out, columns=["source", "target", "path"])

    return pairs.select("source", "target").distinct().mapInPandas(find, f"source {kind}, target {kind}, path array<{kind}>")


def _paths_by_joins(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distances to every target asked for, then one step a round towards it, to the smallest node that is nearer."""
    spark = edges.sparkSession
    asked = pairs.select("source", "target").distinct()
    steps = edges.select(F.col("source").alias("at"), F.col("target").alias("next")).distinct()
    far = _reach_by_joins(reverse(edges), asked.select(F.col("target").alias("seed")).distinct(), None)
    far = far.where("seed <> node").select(F.col("seed").alias("target"), F.col("node").alias("at"), "steps")
    own = F.array("source").alias("path")
    start = asked.where("source <> target").join(far.withColumnRenamed("at", "source"), ["source", "target"])
    left, last = materialize(start.select("source", "target", F.col("source").alias("at"), "steps", own), "paths")
    done = [asked.where("source = target").select("source", "target", own)]
    while not left.isEmpty():
        done.append(left.where("steps = 1").select("source", "target", F.concat("path", F.array("target")).alias("path")))
        nearer = far.select("target", F.col("at").alias("next"), F.col("steps").alias("_steps"))
        onward = left.where("steps > 1").join(steps, "at").join(nearer, ["target", "next"]).where("_steps = steps - 1")
        moved = onward.groupBy("source", "target", "steps", "path").agg(F.min("next").alias("at"))
        left, _ = materialize(moved.select("source", "target", "at", (F.col("steps") - 1).alias("steps"), F.concat("path", F.array("at")).alias("path")), "paths")
    return reduce(DataFrame.unionByName, done)


def neighborhood(edges: DataFrame, node: object, hops: int = 1) -> DataFrame:
    """All nodes within ``hops`` steps, whichever way the edges point, the node included."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["source"]
    own = spark.createDataFrame([(node,)], f"seed {kind}")
    if hops <= 0:
        return own.select(F.col("seed").alias("id"))
    both = edges.select("source", "target").unionByName(reverse(edges))
    return reach(both, own, hops).select(F.col("node").alias("id")).union(own).distinct()


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, level`` by repeated removal of nodes that no remaining node imports.

    Nodes on a cycle, or that a cycle leads to, have no row.
    """
    spark = nodes.sparkSession
    kind = dict(nodes.dtypes)["id"]
    graph = small(edges)
    if graph is not None:
        missing = np.bincount(graph.targets, minlength=len(graph.labels)) if len(graph.labels) else np.zeros(0, np.int64)
        level, rows = 0, []
        front = np.flatnonzero(missing == 0)
        while len(front):
            rows += [(graph.labels[i], level) for i in front]
            hit, n = np.unique(graph.out(front), return_counts=True)
            missing[hit] -= n
            front, level = hit[missing[hit] == 0], level + 1
        levels = spark.createDataFrame(rows, f"id {kind}, level long")
        inside = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id")))
        return levels.unionByName(nodes.select("id").join(inside, "id", "left_anti").withColumn("level", F.lit(0).cast("long")))
    left, path = materialize(nodes.select("id"), "left")
    out: list[DataFrame] = []
    level = 0
    while True:
        inner = edges.join(left, edges["source"] == left["id"], "left_semi").select(F.col("target").alias("id"))
        front, _ = materialize(left.join(inner, "id", "left_anti"), "level")
        if front.isEmpty():
            break
        out.append(front.withColumn("level", F.lit(level).cast("long")))
        left, new = materialize(left.join(front, "id", "left_anti"), "left")
        discard(spark, path)
        path, level = new, level + 1
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"id {kind}, level long")


def betweenness(nodes: DataFrame, edges: DataFrame, broadcast_edges: int = BROADCAST_EDGES, seeds_at_once: int = SEEDS_AT_ONCE) -> DataFrame:
    """``id, centrality``: directed, unweighted, without end points, scaled by 1/((n-1)(n-2)).

    Sources are dealt out; each task runs its own from the broadcast graph and adds up by
    node. Larger graphs go through joins, for about ``seeds_at_once`` sources at a time.
    """
    graph = small(edges, broadcast_edges)
    if graph is None:
        return _scaled(nodes, _shares_by_joins(nodes, edges, seeds_at_once))
    kind = dict(nodes.dtypes)["id"]
    shared = nodes.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        n = len(g.labels)
        total = np.zeros(n)
        for batch in batches:
            for seed in batch["seed"].tolist():
                if seed in g.at:
                    total += _dependencies(g, g.at[seed])
        hit = np.flatnonzero(total)
        if len(hit):
            yield pd.DataFrame({"id": [g.labels[i] for i in hit], "share": total[hit]})

    seeds = _spread(nodes.select(F.col("id").alias("seed")), graph)
    return _scaled(nodes, seeds.mapInPandas(run, f"id {kind}, share double"))


def _scaled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    shares = parts.groupBy("id").agg(F.sum("share").alias("share"))
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.select("id").join(shares, "id", "left").select("id", (F.coalesce("share", F.lit(0.0)) * scale).alias("centrality"))


def _shares_by_joins(nodes: DataFrame, edges: DataFrame, seeds_at_once: int) -> DataFrame:
    """``id, share``: per batch of seeds, counts of shortest paths level by level outwards, shares level by level back."""
    spark = edges.sparkSession
    steps = edges.where("source <> target").select(F.col("source").alias("via"), F.col("target").alias("node")).distinct()
    seeds = steps.select(F.col("via").alias("seed")).distinct().join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi")
    seeds, _ = materialize(seeds, "seeds")
    batches = max(1, -(-seeds.count() // seeds_at_once))
    parts: list[DataFrame] = []
    for k in range(batches):
        own = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(batches)) == k)
        front, path = materialize(own.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("ways")), "level")
        levels, known = [(front, path)], front
        while True:
            made = front.withColumnRenamed("node", "via").join(steps, "via").groupBy("seed", "node").agg(F.sum("ways").alias("ways"))
            front, path = materialize(made.join(known, ["seed", "node"], "left_anti"), "level")
            if front.isEmpty():
                discard(spark, path)
                break
            levels.append((front, path))
            known = known.unionByName(front)
        share, last = levels[-1][0].select("seed", "node", F.lit(0.0).alias("share")), None
        for depth in range(len(levels) - 2, 0, -1):
            nearer = levels[depth][0].select("seed", F.col("node").alias("via"), F.col("ways").alias("_ways"))
            beyond = levels[depth + 1][0].join(share, ["seed", "node"]).join(steps, "node").join(nearer, ["seed", "via"])
            made = beyond.groupBy("seed", F.col("via").alias("node")).agg(F.sum(F.col("_ways") / F.col("ways") * (1 + F.col("share"))).alias("share"))
            some = nearer.select("seed", F.col("via").alias("node")).join(made, ["seed", "node"], "left").fillna({"share": 0.0})
            share, path = materialize(some, "share")
            part, _ = materialize(share.where("share > 0").groupBy(F.col("node").alias("id")).agg(F.sum("share").alias("share")), "part")
            parts.append(part)
            if last:
                discard(spark, last)
            last = path
        for path in [p for _, p in levels] + ([last] if last else []):
            discard(spark, path)
    kind = dict(nodes.dtypes)["id"]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], f"id {kind}, share double"))


def _dependencies(g: Adjacency, seed: int) -> np.ndarray:
    """How much of the shortest paths from ``seed`` runs through each node."""
    n = len(g.labels)
    far, ways = np.full(n, -1, np.int64), np.zeros(n)
    far[seed], ways[seed] = 0, 1
    levels, front = [], np.array([seed])
    while len(front):
        size = g.first[front + 1] - g.first[front]
        to, of = g.out(front), np.repeat(front, size)
        new = far[to] < 0
        fresh = np.unique(to[new])
        far[fresh] = far[front[0]] + 1
        step = far[to] == far[front[0]] + 1
        np.add.at(ways, to[step], ways[of[step]])
        levels.append((of[step], to[step]))
        front = fresh
    share = np.zeros(n)
    for of, to in reversed(levels):
        np.add.at(share, of, ways[of] / ways[to] * (1 + share[to]))
    share[seed] = 0
    return share


def collapse(nodes: DataFrame, edges: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with names cut to ``max_depth + 1`` parts.

    ``nodes`` has ``name, ord`` and whatever else the first node of a name supplies; edges
    join names. Edges that come to join a name with itself go; import counts add up, and of
    ``lines``, ``is_type_only`` and ``is_deferred`` those that there are are put together.
    """

    def cut(name: str) -> Column:
        return F.array_join(F.slice(F.split(name, r"\."), 1, max_depth + 1), ".")

    first = Window.partitionBy("name").orderBy("ord")
    kept = nodes.withColumn("name", cut("name")).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    made = {"import_count": F.sum("import_count"), "lines": F.array_sort(F.flatten(F.collect_list("lines"))), "is_type_only": F.bool_and("is_type_only"), "is_deferred": F.bool_and("is_deferred")}
    have = [c for c in made if c in edges.columns]
    joined = edges.select(cut("source").alias("source"), cut("target").alias("target"), *have).where("source <> target")
    return kept, joined.groupBy("source", "target").agg(*[made[c].alias(c) for c in have])


def package_of(name: str | Column) -> Column:
    """A name up to its last dot; empty if there is none."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise("")


def depth_of(name: str) -> Column:
    return F.size(F.split(name, r"\.")) - 1


def package_edges(edges: DataFrame) -> DataFrame:
    """Pairs of different packages that edges between names join."""
    return edges.select(package_of("source").alias("source"), package_of("target").alias("target")).where("source <> target").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, ca, ce, import_count`` for every node."""
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("ca"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("ce"), F.sum("import_count").alias("import_count"))
    zero = {"ca": 0, "ce": 0, "import_count": 0}
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").fillna(zero)


def density(n: Column, e: Column) -> Column:
    return F.when(n > 1, e / (n * (n - 1)).cast("double")).otherwise(F.lit(0.0))


def top_hubs(nodes: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """The nodes with the most importers: the limit comes before the test for any."""
    return degrees(nodes, edges).orderBy(F.desc("ca"), "id").limit(limit).where("ca > 0").select("id", "ca", "ce")


def strong_components(edges: DataFrame, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """``id, scc`` for each node that lies on a cycle with another: the smallest of its members."""
    pairs = edges.select("source", "target").where("source <> target").distinct()
    graph = small(pairs, broadcast_edges)
    if graph is None:
        return _components_by_joins(pairs)
    kind = dict(edges.dtypes)["source"]
    rows = [(graph.labels[i], graph.labels[c]) for i, c in enumerate(_components(graph)) if c >= 0]
    return edges.sparkSession.createDataFrame(rows, f"id {kind}, scc {kind}")


def _components(g: Adjacency) -> np.ndarray:
    """The first node of each node's component, -1 for those alone: finishing order, then searches against the edges."""
    n = len(g.labels)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    first, targets = g.first.tolist(), g.targets.tolist()
    at, seen, finished = first[:-1].copy(), [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            x = stack[-1]
            while at[x] < first[x + 1] and seen[targets[at[x]]]:
                at[x] += 1
            if at[x] < first[x + 1]:
                seen[targets[at[x]]] = True
                stack.append(targets[at[x]])
            else:
                finished.append(stack.pop())
    origin = np.repeat(np.arange(n), np.diff(g.first))
    order = np.argsort(g.targets, kind="stable")
    back, start = origin[order].tolist(), np.searchsorted(g.targets[order], np.arange(n + 1)).tolist()
    free = [True] * n
    for root in reversed(finished):
        if free[root]:
            free[root], members, todo = False, [root], [root]
            while todo:
                x = todo.pop()
                for y in back[start[x] : start[x + 1]]:
                    if free[y]:
                        free[y] = False
                        members.append(y)
                        todo.append(y)
            if len(members) > 1:
                out[members] = min(members)
    return out


def _components_by_joins(pairs: DataFrame) -> DataFrame:
    """Nodes take the smallest id that leads to them; those of a colour that lead back to that id are its component.

    What is left, and joins nodes of one colour, goes through the same again.
    """
    spark = pairs.sparkSession
    kind = dict(pairs.dtypes)["source"]
    left, path = materialize(pairs, "edges")
    found: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("source").alias("id")).intersect(left.select(F.col("target").alias("id")))
        inner = left.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
        inner, inner_path = materialize(inner, "edges")
        ids = inner.select(F.col("source").alias("id")).union(inner.select(F.col("target").alias("id"))).distinct()
        colour, colour_path = materialize(ids.withColumn("colour", F.col("id")), "colour")
        while True:
            into = inner.join(colour.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("_new"))
            made, new = materialize(colour.join(into, "id", "left").select("id", F.least("colour", "_new").alias("colour"), (F.col("_new") < F.col("colour")).alias("_moved")), "colour")
            still = made.where("_moved").isEmpty()
            discard(spark, colour_path)
            colour, colour_path = made.drop("_moved"), new
            if still:
                break
        same = inner.join(colour.withColumnRenamed("id", "source"), "source").join(colour.select(F.col("id").alias("target"), F.col("colour").alias("_colour")), "target").where("colour = _colour").drop("_colour")
        same, same_path = materialize(same, "edges")
        front, _ = materialize(colour.where("id = colour"), "front")
        members = front
        while not front.isEmpty():
            made = same.join(front.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), "colour").distinct()
            front, _ = materialize(made.join(members, "id", "left_anti"), "front")
            members = members.unionByName(front)
        members, _ = materialize(members, "members")
        found.append(members)
        rest = same.join(members.select(F.col("id").alias("source")), "source", "left_anti").join(members.select(F.col("id").alias("target")), "target", "left_anti")
        left, new = materialize(rest.select("source", "target"), "edges")
        for p in (path, inner_path, same_path, colour_path):
            discard(spark, p)
        path = new
    everyone = reduce(DataFrame.unionByName, found, spark.createDataFrame([], f"id {kind}, colour {kind}"))
    groups = everyone.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
    return everyone.join(groups, "colour", "left_semi").select("id", F.col("colour").alias("scc"))
