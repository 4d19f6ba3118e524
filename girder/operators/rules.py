"""Architecture rules over edges between names; every check gives rows of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.config import Rules
from girder.functions.names import any_module_matches, first_match, module_matches
from girder.operators.graph import reach, shortest_paths, strong_components

COLUMNS = "rule_ord int, rule_type string, source string, target string, rule string, severity string"


def _violations(rows: DataFrame, place: int, kind: str, rule: Column | str) -> DataFrame:
    return rows.select(F.lit(place).alias("rule_ord"), F.lit(kind).alias("rule_type"), "source", "target", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.lit("error").alias("severity"))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def forbidden(edges: DataFrame, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """For each rule and edge at most one violation, by the first target pattern that matches."""
    parts = []
    for pattern, targets in rules:
        hit = first_match(F.col("target"), targets)
        named = F.element_at(F.array(*map(F.lit, targets)), hit + 1)
        rows = _pairs(edges).where(module_matches(F.col("source"), pattern) & (hit >= 0))
        parts.append(_violations(rows, 0, "forbidden", F.concat(F.lit(f"{pattern} -> "), named)))
    return _all(edges, parts)


def protected(edges: DataFrame, rules: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]) -> DataFrame:
    """Importers of protected modules that no allowed pattern matches; once for each pattern."""
    parts = []
    for patterns, allowed in rules:
        for p in patterns:
            rows = _pairs(edges).where(module_matches(F.col("target"), p) & ~any_module_matches(F.col("source"), allowed))
            parts.append(_violations(rows, 1, "protected", p))
    return _all(edges, parts)


def layer_index(name: Column, layers: tuple[str, ...]) -> Column:
    return first_match(name, layers)


def layers(edges: DataFrame, order: tuple[str, ...], allow: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Edges from a lower layer to a higher one, but for allowed pairs; ``order`` runs upwards."""
    s, t = layer_index(F.col("source"), order), layer_index(F.col("target"), order)
    excused = reduce(lambda a, b: a | b, [module_matches(F.col("source"), x) & module_matches(F.col("target"), y) for x, y in allow], F.lit(False))
    rows = _pairs(edges).where((s >= 0) & (t >= 0) & (s < t) & ~excused)
    return _all(edges, [_violations(rows, 2, "layers", F.concat_ws(" -> ", s.cast("string"), t.cast("string")))])


def independence(edges: DataFrame, groups: tuple[tuple[str, ...], ...], reached: DataFrame | None = None) -> DataFrame:
    """Pairs of modules that different patterns of a group match and a way joins; each pair once."""
    if not groups:
        return _all(edges, [])
    far = (reach(edges) if reached is None else reached).select(F.col("seed").alias("source"), F.col("node").alias("target"))
    tests = []
    for group in groups:
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                for x, y in ((a, b), (b, a)):
                    tests.append((module_matches(F.col("source"), x) & module_matches(F.col("target"), y), f"{x} | {y}"))
    named = reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))
    rows = far.withColumn("_rule", named).where(F.col("_rule").isNotNull())
    return _all(edges, [_violations(rows, 3, "independence", F.col("_rule"))])


def independence_paths(edges: DataFrame, violations: DataFrame) -> DataFrame:
    """The shortest path behind each independence violation between different modules."""
    return shortest_paths(edges, violations.where("rule_type = 'independence' and source <> target"))


def acyclic_siblings(edges: DataFrame, ancestors: tuple[str, ...]) -> DataFrame:
    """Edges between siblings below an ancestor that lie in a strong component of siblings."""
    parts = []
    for ancestor in ancestors:
        head = ancestor + "." if ancestor else ""

        def sibling(name: str, head: str = head) -> Column:
            rest = F.substring(F.col(name), F.lit(len(head) + 1), F.length(name))
            return F.when(F.col(name).startswith(head), F.concat(F.lit(head), F.substring_index(rest, ".", 1)))

        joined = edges.select(sibling("source").alias("source"), sibling("target").alias("target")).where("source <> target").distinct()
        scc = strong_components(joined)
        inside = joined.join(scc.select(F.col("id").alias("source"), F.col("scc").alias("_a")), "source").join(scc.select(F.col("id").alias("target"), F.col("scc").alias("_b")), "target").where("_a = _b")
        parts.append(_violations(inside, 4, "acyclic_siblings", ancestor))
    return _all(edges, parts)


def _all(edges: DataFrame, parts: list[DataFrame]) -> DataFrame:
    empty = edges.sparkSession.createDataFrame([], COLUMNS)
    return reduce(DataFrame.unionByName, parts) if parts else empty


def check(edges: DataFrame, rules: Rules, reached: DataFrame | None = None) -> DataFrame:
    """All violations; ``rule_ord`` gives the order of the kinds."""
    return _all(
        edges,
        [
            forbidden(edges, rules.forbidden),
            protected(edges, rules.protected),
            layers(edges, rules.layers, rules.allow),
            independence(edges, rules.independence, reached),
            acyclic_siblings(edges, rules.acyclic_siblings),
        ],
    )
