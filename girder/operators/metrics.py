"""Coupling, complexity and health metrics of modules and of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.config import Thresholds
from girder.operators.graph import degrees

#: Order of the health labels, worst first (fixed values).
HEALTH = ("unknown", "critical", "high", "elevated", "moderate", "healthy")

#: How much more tests and package or settings modules may hold (fixed values).
TEST_FACTOR, INIT_FACTOR = 3.0, 1.5


def ratio(over: Column, under: Column) -> Column:
    """A quotient as double; 0 over nothing."""
    return F.when(under > 0, over.cast("double") / under.cast("double")).otherwise(F.lit(0.0))


def module_role(name: Column, is_package: Column) -> Column:
    last = F.element_at(F.split(name, r"\."), -1)
    return (
        F.when(last.startswith("test_") | (last == "conftest"), "test")
        .when((last == "__init__") | is_package, "init")
        .when(last.isin("config", "settings", "constants", "defaults"), "config")
        .otherwise("source")
    )


def percentile_rank(value: str) -> Column:
    """The share of values that are no larger."""
    return F.cume_dist().over(Window.orderBy(value))


def arch_role(name: Column, ca: Column, ce: Column, centrality_rank: Column, ca_rank: Column) -> Column:
    last = F.element_at(F.split(name, r"\."), -1)
    return (
        F.when((last == "__init__") & (ce >= 3), "hub-by-design")
        .when(centrality_rank >= 0.9, F.when(ca > ce, "core").otherwise("orchestrator"))
        .when((ca_rank >= 0.9) & (ca > ce), "core")
        .otherwise("")
    )


def adaptive_thresholds(modules: DataFrame, limits: Thresholds) -> DataFrame:
    """One row: percentiles of ``cc`` and ``cog`` of source modules, with floors; null without any."""
    levels = (("critical", 0.95), ("high", 0.9), ("elevated", 0.8), ("moderate", 0.6))
    # Floors of the two lower levels (fixed values).
    floors = {
        "cc": (limits.cc_floor_critical, limits.cc_floor_high, 8, 4),
        "cog": (limits.cog_floor_critical, limits.cog_floor_high, 10, 6),
    }
    made = [
        F.when(F.count(F.lit(1)) > 0, F.greatest(F.percentile(c, F.lit(p)), F.lit(float(floor)))).alias(f"{c}_{level}")
        for c in ("cc", "cog")
        for (level, p), floor in zip(levels, floors[c], strict=True)
    ]
    return modules.where("role = 'source'").agg(*made)


def health(parse_error: Column, skip: Column, cc: Column, cog: Column, instability: Column, ca: Column, ce: Column, limit: dict[str, Column], t: Thresholds) -> Column:
    """The first label of the list that applies; ``limit`` has the eight complexity limits."""

    def over(level: str) -> Column:
        return (cc >= limit[f"cc_{level}"]) | (cog >= limit[f"cog_{level}"])

    return (
        F.when(parse_error, "unknown")
        .when(over("critical"), "critical")
        .when(~skip & (instability > t.instability_high) & (ce > t.ce_high), "critical")
        .when(over("high"), "high")
        .when(~skip & (ca == 0) & (ce > t.ce_high), "high")
        .when(over("elevated"), "elevated")
        .when(~skip & (instability > t.instability_high * 0.875) & (ce > t.ce_high * 0.625), "elevated")
        .when(over("moderate"), "moderate")
        .otherwise("healthy")
    )


def effective_health(raw: Column, arch: Column, role: Column) -> Column:
    capped = F.when((arch == "core") & raw.isin("critical", "high"), "elevated").otherwise(raw)
    return F.when((role == "test") & capped.isin("critical", "high"), "moderate").otherwise(capped)


def module_metrics(modules: DataFrame, edges: DataFrame, centrality: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """All metrics of each module.

    ``modules`` has ``id, name, is_package, loc, language, parse_error`` and, nullable,
    ``cc, cog, class_count, abstract_count``; ``centrality`` has ``id, centrality``.
    """
    t = t or Thresholds()
    zero = F.lit(0)
    base = (
        modules.join(degrees(modules, edges), "id")
        .join(centrality, "id", "left")
        .withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
        .withColumn("cc", F.coalesce("cc", F.lit(1)))
        .withColumn("cog", F.coalesce("cog", zero))
        .withColumn("parse_error", F.coalesce("parse_error", F.lit(False)))
        .withColumn("instability", ratio(F.col("ce"), F.col("ca") + F.col("ce")))
        .withColumn("abstractness", ratio(F.coalesce("abstract_count", zero), F.coalesce("class_count", zero)))
        .withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1.0))
        .withColumn("role", module_role(F.col("name"), F.col("is_package")))
    )
    ranked = base.withColumn("_cent", percentile_rank("centrality")).withColumn("_ca", percentile_rank("ca"))
    ranked = ranked.withColumn("arch_role", arch_role(F.col("name"), F.col("ca"), F.col("ce"), F.col("_cent"), F.col("_ca")))
    limits = adaptive_thresholds(base.select("role", "cc", "cog"), t)  # one row
    names = [f"{c}_{level}" for c in ("cc", "cog") for level in ("critical", "high", "elevated", "moderate")]
    wide = ranked.crossJoin(F.broadcast(limits.select(*[F.col(n).alias(f"_{n}") for n in names])))
    factor = F.when(F.col("role") == "test", TEST_FACTOR).when(F.col("role").isin("init", "config"), INIT_FACTOR).otherwise(1.0)

    def limit(n: str) -> Column:
        static = F.lit(float(getattr(t, n)))
        return F.coalesce(F.col(f"_{n}") * factor, static) if t.use_percentiles else static

    skip = (F.col("arch_role") == "hub-by-design") | (F.col("role") == "init")
    raw = health(F.col("parse_error"), skip, F.col("cc"), F.col("cog"), F.col("instability"), F.col("ca"), F.col("ce"), {n: limit(n) for n in names}, t)
    labelled = wide.withColumn("raw_health", raw).withColumn("health", effective_health(F.col("raw_health"), F.col("arch_role"), F.col("role")))
    return labelled.drop("_cent", "_ca", *[f"_{n}" for n in names])


def project_metrics(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals; instabilities are averaged as they are shown, with three decimals."""
    count = edges.agg(F.count(F.lit(1)).alias("edges"))
    labels = [F.count_if(F.col("health") == h).alias(h) for h in HEALTH]
    shown = F.round("instability", 3)
    total = metrics.agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"), F.avg(shown).alias("avg_instability"), F.max(shown).alias("max_instability"), *labels)
    pairs = F.greatest(F.col("modules") * (F.col("modules") - 1), F.lit(1))
    return total.crossJoin(count).withColumn("density", F.round(F.col("edges") / pairs, 4))


def token_ratio(language: Column, t: Thresholds) -> Column:
    return F.when(language == "python", t.ratio_python).when(language == "javascript", t.ratio_javascript).when(language == "typescript", t.ratio_typescript).otherwise(2.0)


def edit_cost(modules: DataFrame, edges: DataFrame, impact: DataFrame, churn: DataFrame | None = None, t: Thresholds | None = None) -> DataFrame:
    """``id, files, cascade, tokens, risk``: what a change of each module touches.

    ``impact`` has ``id, cascade`` (all transitive dependents); ``churn`` has ``id, category``.
    """
    t = t or Thresholds()
    own = modules.select("id", F.floor(F.col("loc") * token_ratio(F.col("language"), t)).cast("long").alias("own"))
    pairs = edges.select(F.col("target").alias("id"), F.col("source").alias("importer")).distinct()
    read = pairs.join(own.select(F.col("id").alias("importer"), F.col("own").alias("read")), "importer").groupBy("id").agg(F.count(F.lit(1)).alias("files"), F.sum("read").alias("read"))
    joined = own.join(read, "id", "left").join(impact, "id", "left").fillna({"files": 0, "read": 0, "cascade": 0})
    files = F.col("files")
    if churn is None:
        risk = F.when(files >= 10, "high").when(files >= 5, "medium").otherwise("low")
    else:
        joined = joined.join(churn.select("id", "category"), "id", "left")
        c = F.coalesce("category", F.lit(""))
        risk = F.when(c == "", "low").when((c == "hot") & (files >= 5), "high").when(c.isin("hot", "warm") | (files >= 3), "medium").otherwise("low")
    return joined.select("id", "files", "cascade", (F.col("own") + F.col("read")).alias("tokens"), risk.alias("risk"))


#: Other names of the metrics (fixed values).
_ALIAS = {"cyclomatic": "cc", "cyclomatic_complexity": "cc", "cognitive": "cog", "cognitive_complexity": "cog", "distance_main_seq": "distance", "fan_in": "ca", "fan_out": "ce"}


def sort_metrics(metrics: DataFrame, by: str = "ca", limit: int = 0) -> DataFrame:
    """By health (worst first, then complexity) or by a metric, descending; 0 lists all."""
    if by == "health":
        worst = F.array_position(F.array(*map(F.lit, HEALTH)), F.col("health"))
        ordered = metrics.orderBy(worst, F.desc("cc"), "id")
    else:
        name = _ALIAS.get(by, by)
        ordered = metrics.orderBy(F.desc(name), "id") if name in metrics.columns else metrics.orderBy("id")
    return ordered.limit(limit) if limit else ordered


def functions_by_complexity(symbols: DataFrame, limit: int = 30) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "method")).orderBy(F.desc("complexity"), "module", "name").limit(limit)
