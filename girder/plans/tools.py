"""Questions to an analysis and their short answers, as plain values for programs that ask.

Files are named by their paths; an answer to an unknown file has ``error`` and names that
come near. Lists are cut where a parameter says so, and tell the whole number beside them.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators import churn, graph, insights, metrics, symbols
from girder.plans import render
from girder.plans.engine import Analysis

#: Names that come near an unknown one, modules that a search lists (fixed values).
NEAR, FOUND = 8, 15
_LEVELS = ("healthy", "moderate", "elevated", "high", "critical", "unknown")


def _dicts(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


def _module(a: Analysis, file: str) -> str | None:
    found = a.resolve([file]).first()
    return found.id if found else None


def _unknown(a: Analysis, file: str) -> dict:
    near = a.find(Path(file).stem).limit(NEAR).collect() if file else []
    return {"error": f"{file!r} not found", "suggestions": [r.id for r in near]}


def _files(a: Analysis, df: DataFrame, module: str = "id") -> DataFrame:
    """Rows with ``file``, the path of their module."""
    return df.join(a.modules.select(F.col("id").alias(module), F.col("rel_path").alias("file")), module)


def analyze(a: Analysis) -> dict:
    """Size, density, health and cycles of the project."""
    p = a.project_metrics().first()
    kinds = {r["kind"]: r["count"] for r in a.cycle_report.groupBy("kind").count().collect()}
    got = {"project_name": a.project, "modules": p.modules, "dependencies": p.edges, "loc": p.loc or 0, "density": p.density, "avg_instability": p.avg_instability or 0.0, "has_cycles": p.has_cycles}
    got |= {"cycle_count": sum(kinds.values()), "health": {h: p[h] for h in _LEVELS}}
    if kinds:
        got |= {"runtime_cycles": kinds.get("runtime", 0), "safe_cycles": sum(kinds.values()) - kinds.get("runtime", 0)}
    return got


def file_context(a: Analysis, file: str, compact: bool = True, min_severity: str = "") -> dict:
    """What to know before changing a file; ``min_severity`` leaves out codes that usually are milder."""
    module = _module(a, file)
    if module is None:
        return _unknown(a, file)
    (row,) = _dicts(a.contexts(full=not compact).where(F.col("id") == module))
    got = {k: v for k, v in row.items() if v != ""}
    if min_severity and compact:
        least = insights.RANK[min_severity]
        got["insights"] = [c for c in got.get("insights", []) if insights.RANK[insights.SEVERITY.get(c, "info")] >= least]
    return got


def context(a: Analysis, files: list[str]) -> dict:
    return render.briefing(a, files)


def find(a: Analysis, pattern: str) -> dict:
    rows = a.find(pattern).select("id").join(a.modules.select("id", F.col("rel_path").alias("file"), "loc"), "id")
    return {"pattern": pattern, "count": rows.count(), "modules": _dicts(rows.orderBy("id").limit(FOUND).select("file", "loc"))}


def cycles(a: Analysis) -> dict:
    """All reported cycles by path, and in how many of them each file is."""
    got = render.as_cycles(a)
    if not got["cycles"]:
        return {"has_cycles": False}
    runtime = sum(c["kind"] == "runtime" for c in got["cycles"])
    return {"has_cycles": True, "count": len(got["cycles"]), "runtime_count": runtime, "safe_count": len(got["cycles"]) - runtime} | got


def module_metrics(a: Analysis, sort_by: str = "ca", limit: int = 20, compact: bool = True) -> dict:
    """The first modules by a metric; 0 lists all of them."""
    names = ["rel_path as file", "health", "cc", "ca", "ce"]
    if not compact:
        names += ["instability", "loc", "cog", "class_count as classes", "function_count as functions", "if(parse_error, true, null) as parse_error"]
    rows = _dicts(metrics.sort_metrics(a.metrics, sort_by, limit).selectExpr(*names))
    return {"sort_by": sort_by, "count": len(rows), "modules": rows}


def path(a: Analysis, source: str, target: str) -> dict:
    """The shortest way from one file to another along imports."""
    ends = _module(a, source), _module(a, target)
    found = a.path(*ends).first() if all(ends) else None
    if found is None or found.path is None:
        return {"source": source, "target": target, "path": None, "message": f"no dependency path from {source!r} to {target!r}"}
    files = {r.id: r.rel_path for r in a.modules.where(F.col("id").isin(list(found.path))).collect()}
    return {"source": source, "target": target, "path": [files[m] for m in found.path], "hops": len(found.path) - 1}


def overview(a: Analysis, hubs: int = FOUND) -> dict:
    """Size of the graph, packages that import others, and the modules with the most dependents."""
    p = a.project_metrics().first()
    packages = graph.package_edges(a.edges).select("source").distinct().count()
    top = a.metrics.where("ca > 0").orderBy(F.desc("ca"), "id").limit(hubs).selectExpr("rel_path as file", "ca", "ce", "health")
    return {"modules": p.modules, "edges": p.edges, "density": p.density, "packages": packages, "top_hubs": _dicts(top)}


def _symbols_of(a: Analysis, module: str) -> DataFrame:
    """The symbols of one module with ``usage_count``, most used first."""
    used = symbols.usage(a.references).withColumnRenamed("usage", "usage_count")
    own = symbols.module_symbols(a.symbols, module).join(used, ["module", "name", "kind"], "left").fillna({"usage_count": 0})
    return own.orderBy(F.desc("usage_count"), "line", "name")


def impact(a: Analysis, file: str = "", symbol: str = "", mode: str = "impact", limit: int = 15) -> dict:
    """Who breaks if a file's symbols change (``impact``), the most used symbols (``hotspots``), or those no one uses (``unused``).

    ``limit`` bounds the list, at one or more; ``total`` counts all.
    """
    cap = max(limit, 1)
    if mode in ("hotspots", "unused"):
        rows = a.symbol_hotspots() if mode == "hotspots" else a.unused()
        order, shown = ([F.desc("usage"), "module", "name"], ["usage as usage_count"]) if mode == "hotspots" else (["module", "line"], [])
        total, first = rows.count(), _files(a, rows, "module").orderBy(*order).limit(cap).selectExpr("file", "name", "kind", *shown)
        more = {"framework_filtered": bool(a.settings.decorators)} if mode == "unused" else {}
        return {"mode": mode, "total": total, "showing": min(cap, total), **more, ("hotspots" if mode == "hotspots" else "symbols"): _dicts(first)}
    if mode != "impact":
        raise ValueError(f"no mode {mode!r}: impact, hotspots or unused")
    module = _module(a, file)
    if module is None:
        return _unknown(a, file)
    place = a.modules.where(F.col("id") == module).first().rel_path
    own = _symbols_of(a, module).collect()
    if not own:
        return {"file": place, "symbols": [], "message": "no symbols defined in this module"}
    asked = [r for r in own if r.name == symbol] if symbol else own
    if not asked:
        return {"error": f"symbol {symbol!r} not found in {module}", "available": [r.name for r in own]}
    users = symbols.impact(a.references).where(F.col("module") == module)
    hit = {(r["name"], r["kind"]): sorted(r.files) for r in _files(a, users, "importer").groupBy("name", "kind").agg(F.collect_list("file").alias("files")).collect()}
    told = [{"symbol": f"{place}::{r.name}", "kind": r["kind"], "affected_modules": hit.get((r.name, r["kind"]), [])} for r in asked[:cap]]
    return {"mode": "impact", "file": place, "total": len(asked), "showing": len(told), "impacts": [t | {"affected_count": len(t["affected_modules"])} for t in told]}


def symbols_of(a: Analysis, file: str, compact: bool = True) -> dict:
    """The classes and functions of a file by line; in full with complexity, use and decorators."""
    module = _module(a, file)
    if module is None:
        return _unknown(a, file)
    names = ["name", "kind", "line"] if compact else ["name", "kind", "line", "end_line", "complexity", "usage_count", "if(size(decorators) > 0, decorators, null) as decorators"]
    rows = _dicts(_symbols_of(a, module).orderBy("line", "name").selectExpr(*names))
    return {"file": a.modules.where(F.col("id") == module).first().rel_path, "total": len(rows), "symbols": rows}


def hotspots(a: Analysis, limit: int = 20, compact: bool = True) -> dict:
    """Complex files that change often, over the days of the analysis; not available without a history."""
    rows = a.hotspots(limit)
    if rows is None:
        return {"available": False, "message": "no commit history"}
    names = ["path as file", "score as hotspot_score", "health", "category as churn"] + ([] if compact else ["cc", "commits", "days as days_since_change"])
    shown = _dicts(rows.join(a.metrics.select("id", "health"), "id").orderBy(F.desc("score"), "id").selectExpr(*names))
    return {"available": True, "analysis_days": a.days, "total_commits": churn.summary(a.history).first().commits, "count": len(shown), "hotspots": shown}
