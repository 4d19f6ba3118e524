"""Symbols: definitions, references, use and impact.

``symbols`` has ``module, name, kind, decorators`` and ``imports`` has ``source, target,
name, is_from_import``; one row of ``imports`` is one reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry(symbols: DataFrame) -> DataFrame:
    """Classes and functions, each ``(module, name, kind)`` once: the last by line, if lines are known."""
    keys = ["module", "name", "kind"]
    rest = sorted((c for c in symbols.columns if c not in keys), key=lambda c: (c != "line", c))
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in rest or keys])
    return symbols.where(F.col("kind") != "method").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def lookup(symbols: DataFrame, name: object, from_module: object = None) -> DataFrame:
    """All symbols of a name; those of ``from_module`` alone if it has any."""
    found = registry(symbols).where(F.col("name") == name)
    if from_module is None:
        return found
    own = found.withColumn("_own", F.col("module") == from_module)
    any_own = F.max("_own").over(Window.partitionBy("name"))
    return own.withColumn("_any", any_own).where(~F.col("_any") | F.col("_own")).drop("_own", "_any")


def by_id(symbols: DataFrame, module: object, name: object, kind: object) -> DataFrame:
    """The one symbol that module, name and kind mean, if there is one."""
    return registry(symbols).where((F.col("module") == module) & (F.col("name") == name) & (F.col("kind") == kind))


def module_symbols(symbols: DataFrame, module: object) -> DataFrame:
    return registry(symbols).where(F.col("module") == module)


def resolve_references(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every from-import with the kind it resolves to, null if the target defines no such name.

    A class comes before a function of the same name.
    """
    kinds = registry(symbols).groupBy(F.col("module").alias("target"), "name").agg(F.min("kind").alias("kind"))
    return imports.where("is_from_import").join(kinds, ["target", "name"], "left")


def symbol_edges(references: DataFrame) -> DataFrame:
    return references.where(F.col("kind").isNotNull()).groupBy("source", "target", "name", "kind").agg(F.count(F.lit(1)).alias("references"))


def usage(references: DataFrame) -> DataFrame:
    """``module, name, kind, usage``: references to each symbol that has any."""
    return references.where(F.col("kind").isNotNull()).groupBy(F.col("target").alias("module"), "name", "kind").agg(F.count(F.lit(1)).alias("usage"))


def hotspots(references: DataFrame, least: int = 3) -> DataFrame:
    return usage(references).where(F.col("usage") >= least)


def is_framework_entry(decorators: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Does any pattern occur in any decorator?"""
    return F.exists(decorators, lambda d: reduce(lambda a, b: a | b, [F.contains(d, F.lit(p)) for p in patterns], F.lit(False)))


def unused(symbols: DataFrame, references: DataFrame, patterns: list[str] | tuple[str, ...]) -> DataFrame:
    """Public symbols without a reference that no framework calls."""
    used = usage(references).select("module", "name", "kind")
    public = registry(symbols).where(~F.col("name").cast("string").startswith("_") & ~is_framework_entry(F.coalesce("decorators", F.array().cast("array<string>")), patterns))
    return public.join(used, ["module", "name", "kind"], "left_anti")


def impact(references: DataFrame) -> DataFrame:
    """``module, name, kind, importer``: the modules that use each symbol."""
    return references.where(F.col("kind").isNotNull()).select(F.col("target").alias("module"), "name", "kind", F.col("source").alias("importer")).distinct()
