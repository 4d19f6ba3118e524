"""Insights and risk labels of modules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.config import Thresholds

# Usual severity of each code, and what codes become for core modules (fixed values).
SEVERITY = {
    "extreme_cyclomatic": "critical", "extreme_cognitive": "critical", "critical_blast_radius": "critical", "in_cycle": "critical", "parse_failed": "critical",
    "high_instability": "warning", "high_efferent": "warning", "high_afferent": "warning", "high_cyclomatic": "warning", "high_cognitive": "warning",
    "high_blast_radius": "warning", "very_large_module": "warning", "large_module": "warning", "zone_of_pain": "warning", "zone_of_uselessness": "warning",
    "highly_stable": "info", "well_balanced": "info", "isolated": "info", "high_fan_out": "info", "wide_transitive_reach": "info", "core_module": "info",
    "core_high_cc": "info", "core_high_cog": "info", "core_wide_reach": "info",
}
CORE_REWRITE = {
    "extreme_cyclomatic": "core_high_cc", "extreme_cognitive": "core_high_cog", "critical_blast_radius": "core_wide_reach", "high_blast_radius": "core_wide_reach",
    "high_afferent": "", "high_cyclomatic": "core_high_cc", "high_cognitive": "core_high_cog",
}
RANK = {"critical": 2, "warning": 1, "info": 0}
# What is said of each code: a pattern and the columns that fill it (fixed values).
_ZONE = ("value", "abstractness", "instability")
DETAIL = {
    "high_instability": ("I=%.2f: high outgoing vs incoming dependencies", "value"),
    "highly_stable": ("I=%.2f: many dependents, changes here propagate widely", "value"),
    "high_efferent": ("Ce=%d: depends on %d modules", "n", "n"),
    "high_afferent": ("Ca=%d: %d modules depend on this", "n", "n"),
    "isolated": ("no internal dependencies or dependents",),
    "extreme_cyclomatic": ("CC=%d: very high decision branch count", "n"),
    "high_cyclomatic": ("CC=%d: elevated decision branch count", "n"),
    "extreme_cognitive": ("CogC=%d: deeply nested control flow", "n"),
    "high_cognitive": ("CogC=%d: moderately nested control flow", "n"),
    "very_large_module": ("LOC=%d: large module", "n"),
    "large_module": ("LOC=%d: above-average module size", "n"),
    "critical_blast_radius": ("%d modules directly depend on this", "n"),
    "high_blast_radius": ("%d modules directly depend on this", "n"),
    "wide_transitive_reach": ("%d modules transitively affected (vs %d direct)", "n", "limit"),
    "in_cycle": ("involved in %d cycle(s), largest has %d modules", "n", "largest_cycle"),
    "high_fan_out": ("imports %d modules: high coordination surface", "n"),
    "parse_failed": ("AST parse failed (LOC=%d): all metrics unreliable", "n"),
    "core_module": ("D=%.2f: concrete (A=%.2f) + stable (I=%.2f) — core architectural component", *_ZONE),
    "zone_of_pain": ("D=%.2f: concrete (A=%.2f) + stable (I=%.2f) — rigid, hard to extend", *_ZONE),
    "zone_of_uselessness": ("D=%.2f: abstract (A=%.2f) + unstable (I=%.2f) — possibly unused abstractions", *_ZONE),
    "well_balanced": ("D=%.2f: on the main sequence (A=%.2f, I=%.2f)", *_ZONE),
}


def rank(severity: Column) -> Column:
    return F.when(severity == "critical", 2).when(severity == "warning", 1).otherwise(0)


def _one(code: str, severity: str | Column, metric: str, value: Column, limit: float | Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        (F.lit(float(limit)) if not isinstance(limit, Column) else limit.cast("double")).alias("threshold"),
    )


def insights(modules: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """``id, place, code, severity, metric, value, threshold``, most severe first.

    ``modules`` has the metrics and ``direct, transitive, cycle_count, largest_cycle``;
    instability and distance are taken with three decimals, as they are shown.
    """
    t = t or Thresholds()
    i, d, a = F.round("instability", 3), F.round("distance", 3), F.round("abstractness", 3)
    ca, ce, cc, cog, loc = (F.col(c) for c in ("ca", "ce", "cc", "cog", "loc"))
    direct, far, classes = F.col("direct"), F.col("transitive"), F.col("class_count") > 0
    core = F.col("arch_role").isin("core", "hub-by-design")
    off, on = classes & (d >= t.distance_high), classes & (d <= t.distance_low)
    pain = off & (a <= t.abstract_low) & (i <= 0.3)
    zero = F.lit(0)
    cases = [
        (F.col("parse_error"), _one("parse_failed", "critical", "ast_parse", loc, 0)),
        ((i >= t.instability_high) & (ce > 3), _one("high_instability", F.when(i < 0.95, "warning").otherwise("critical"), "instability", i, t.instability_high)),
        ((i <= t.instability_low) & (ca > 3), _one("highly_stable", "info", "instability", i, t.instability_low)),
        (ce >= t.ce_high, _one("high_efferent", "warning", "ce", ce, t.ce_high)),
        (ca >= t.ca_high, _one("high_afferent", "warning", "ca", ca, t.ca_high)),
        ((ca == 0) & (ce == 0), _one("isolated", "info", "coupling", zero, 0)),
        (cc >= t.cc_critical, _one("extreme_cyclomatic", "critical", "cyclomatic_complexity", cc, t.cc_critical)),
        ((cc >= t.cc_high) & (cc < t.cc_critical), _one("high_cyclomatic", "warning", "cyclomatic_complexity", cc, t.cc_high)),
        (cog >= t.cog_critical, _one("extreme_cognitive", "critical", "cognitive_complexity", cog, t.cog_critical)),
        ((cog >= t.cog_high) & (cog < t.cog_critical), _one("high_cognitive", "warning", "cognitive_complexity", cog, t.cog_high)),
        (loc >= t.loc_critical, _one("very_large_module", "warning", "loc", loc, t.loc_critical)),
        ((loc >= t.loc_high) & (loc < t.loc_critical), _one("large_module", "info", "loc", loc, t.loc_high)),
        (direct >= t.dependents_critical, _one("critical_blast_radius", "critical", "direct_dependents", direct, t.dependents_critical)),
        ((direct >= t.dependents_high) & (direct < t.dependents_critical), _one("high_blast_radius", "warning", "direct_dependents", direct, t.dependents_high)),
        (far > direct + 3, _one("wide_transitive_reach", "info", "transitive_dependents", far, direct)),
        (F.col("cycle_count") > 0, _one("in_cycle", F.when(F.col("largest_cycle") >= t.cycle_size_high, "critical").otherwise("warning"), "cycle_count", F.col("cycle_count"), 1)),
        (ce >= t.dependencies_high, _one("high_fan_out", "info", "ce", ce, t.dependencies_high)),
        (pain & core, _one("core_module", "info", "distance_main_seq", d, t.distance_high)),
        (pain & ~core, _one("zone_of_pain", "warning", "distance_main_seq", d, t.distance_high)),
        (off & (a >= t.abstract_high) & (i >= 0.7), _one("zone_of_uselessness", "warning", "distance_main_seq", d, t.distance_high)),
        (on & ~off, _one("well_balanced", "info", "distance_main_seq", d, t.distance_low)),
    ]
    found = F.filter(F.array(*[F.when(test, made) for test, made in cases]), lambda x: x.isNotNull())
    rows = modules.select("id", F.posexplode(found).alias("_at", "x")).select("id", "_at", "x.*")
    return _placed(rows)


def described(found: DataFrame, modules: DataFrame) -> DataFrame:
    """The insights with ``detail``, a sentence with the numbers behind each; halves are rounded up.

    To be called before :func:`rewrite_for_core`, which keeps the sentence.
    """
    about = modules.select("id", F.col("largest_cycle").cast("long").alias("largest_cycle"), F.round("abstractness", 3).alias("abstractness"), F.round("instability", 3).alias("instability"))
    rows = found.join(about, "id").withColumn("n", F.col("value").cast("long")).withColumn("limit", F.col("threshold").cast("long"))
    said = F.lit(None).cast("string")
    for code, (pattern, *fills) in DETAIL.items():
        said = F.when(F.col("code") == code, F.format_string(pattern, *fills) if fills else F.lit(pattern)).otherwise(said)
    return rows.select(*found.columns, said.alias("detail"))


def _placed(rows: DataFrame) -> DataFrame:
    place = Window.partitionBy("id").orderBy(rank(F.col("severity")).desc(), "_at")
    return rows.withColumn("place", F.row_number().over(place)).drop("_at")


def rewrite_for_core(found: DataFrame) -> DataFrame:
    """Insights of core modules in neutral terms: new codes once for each module, some left out."""
    new = F.create_map(*[F.lit(x) for pair in CORE_REWRITE.items() for x in pair])[F.col("code")]
    marked = found.withColumn("_new", new).where(F.col("_new").isNull() | (F.col("_new") != ""))
    once = Window.partitionBy("id", F.coalesce("_new", F.concat(F.lit("="), F.col("code")))).orderBy("place")
    kept = marked.withColumn("_k", F.row_number().over(once)).where(F.col("_new").isNull() | (F.col("_k") == 1))
    changed = kept.withColumn("severity", F.when(F.col("_new").isNull(), F.col("severity")).otherwise("info")).withColumn("code", F.coalesce("_new", "code"))
    return _placed(changed.withColumn("_at", F.col("place")).drop("_new", "_k", "place"))


def at_least(found: DataFrame, severity: str, top: int = 3) -> DataFrame:
    """Of each module's first ``top`` insights those whose code usually is that severe."""
    usual = F.create_map(*[F.lit(x) for c, s in SEVERITY.items() for x in (c, RANK[s])])[F.col("code")]
    return found.where((F.col("place") <= top) & (usual >= RANK[severity]))


def risk(t: Thresholds | None = None) -> Column:
    """The first risk label that applies, or null; over the same columns as :func:`insights`."""
    t = t or Thresholds()
    i, complex_ = F.round("instability", 3), (F.col("cc") >= t.cc_high) | (F.col("cog") >= t.cog_high)
    return (
        F.when(F.col("cycle_count") > 0, "tangled")
        .when((F.col("ca") >= t.dependents_high) & complex_, "hub")
        .when(complex_ & (i >= t.instability_high), "fragile")
        .when((i >= t.instability_high) & (F.col("ce") >= t.dependents_high), "volatile")
        .when((F.col("direct") >= 3) & (F.col("transitive") >= F.col("direct") * 2), "amplifier")
    )
