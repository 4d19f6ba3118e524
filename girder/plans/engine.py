"""The whole analysis of a source tree, as a session of cached tables."""

from __future__ import annotations

import json
import posixpath
import re
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.config import Settings
from girder.extract.parse import parse_files, resolved_imports, symbol_rows, symbol_stats
from girder.operators import churn, context, cycles, graph, insights, metrics, resolve, rules, symbols
from girder.session import importable, materialize
from girder.sources import files, gitlog


class Analysis:
    """Tables of one project. Each is computed when it is first asked for, and written once.

    ``days`` bounds the history that is read; a tree without a repository has none.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, days: int = 90) -> None:
        self.spark, self.root, self.settings, self.days = importable(spark), str(Path(root).resolve()), settings or Settings(), days
        self.project = Path(self.root).name

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label)[0]

    @cached_property
    def files(self) -> DataFrame:
        return self._kept(files.read_tree(self.spark, self.root, self.settings), "files")

    @cached_property
    def scanned(self) -> DataFrame:
        return self._kept(files.scan_modules(self.files, self.project, self.settings), "scan")

    @cached_property
    def parsed(self) -> DataFrame:
        return self._kept(parse_files(self.files, self.scanned), "parsed")

    @cached_property
    def all_modules(self) -> DataFrame:
        stats = symbol_stats(self.parsed)
        joined = self.scanned.join(stats, "id", "left").withColumn("loc", F.coalesce("loc", "script_loc", F.lit(0))).drop("script_loc")
        return self._kept(joined.withColumn("name", F.col("id")), "modules")

    @cached_property
    def modules(self) -> DataFrame:
        return self._graph[0]

    @cached_property
    def imports(self) -> DataFrame:
        aliases, base = self._aliases()
        top = self.settings.package_root and self._inside(Path(self.root) / self.settings.package_root)
        return self._kept(resolved_imports(self.parsed, self.all_modules, self.project, aliases, base, top), "imports")

    def _inside(self, path: Path) -> str:
        """A path as it is seen from the root; empty for the root itself."""
        return posixpath.relpath(path.resolve().as_posix(), Path(self.root).as_posix()).removeprefix(".").lstrip("/")

    def _aliases(self) -> tuple[list[tuple[str, list[str]]], str]:
        """Path aliases of the settings' ``tsconfig``, else of ``tsconfig.json`` at the root; one that is asked for must be readable."""
        path = Path(self.root) / (self.settings.tsconfig or "tsconfig.json")
        try:
            options = json.loads(re.sub(r"//[^\n]*", "", path.read_text(encoding="utf-8"))).get("compilerOptions", {})
        except (OSError, ValueError):
            if self.settings.tsconfig:
                raise
            return [], ""
        base = self._inside(path.parent / options.get("baseUrl", ""))
        return [(k, v) for k, v in options.get("paths", {}).items()] + ([("*", ["*"])] if options.get("baseUrl", "").strip("./") else []), base

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        """Modules and edges; names beyond the settings' depth are one module, described by the first of them."""
        edges = self._kept(graph.build_edges(self.imports, self.all_modules, ["seq"]), "edges")
        if self.settings.max_depth is None:
            return self.all_modules, edges
        nodes, edges = graph.collapse(self.all_modules, edges, self.settings.max_depth)
        return self._kept(nodes.withColumn("id", F.col("name")), "collapsed"), self._kept(edges, "collapsed-edges")

    @cached_property
    def edges(self) -> DataFrame:
        return self._graph[1]

    @cached_property
    def reached(self) -> DataFrame:
        return self._kept(graph.reach(self.edges), "reached")

    @cached_property
    def cycles(self) -> DataFrame:
        return self._kept(cycles.elementary_cycles(self.edges), "cycles")

    @cached_property
    def cycle_report(self) -> DataFrame:
        return self._kept(cycles.report(self.cycles, self.edges), "cycle-report")

    @cached_property
    def metrics(self) -> DataFrame:
        made = metrics.module_metrics(self.modules, self.edges, graph.betweenness(self.modules, self.edges), self.settings.thresholds)
        return self._kept(made, "metrics")

    @cached_property
    def measured(self) -> DataFrame:
        return self._kept(context.measures(self.metrics, self.reached, context.cycles_of(self.cycles)), "measured")

    @cached_property
    def insights(self) -> DataFrame:
        found = insights.described(insights.insights(self.measured, self.settings.thresholds), self.measured)
        core = self.metrics.where("arch_role = 'core'").select("id")
        return self._kept(found.join(core, "id", "left_anti").unionByName(insights.rewrite_for_core(found.join(core, "id", "left_semi"))), "insights")

    @cached_property
    def symbols(self) -> DataFrame:
        return self._kept(symbol_rows(self.parsed), "symbols")

    @cached_property
    def references(self) -> DataFrame:
        return self._kept(symbols.resolve_references(self.imports, self.symbols), "references")

    @cached_property
    def history(self) -> DataFrame | None:
        lines = gitlog.read_log(self.spark, self.root, self.days)
        return None if lines is None else self._kept(gitlog.parse_log(lines), "history")

    @cached_property
    def churn(self) -> DataFrame | None:
        if self.history is None:
            return None
        made = churn.churn(self.history, F.current_timestamp())
        return self._kept(made.withColumn("category", churn.category(F.col("commits"), F.col("days"))), "churn")

    def project_metrics(self) -> DataFrame:
        return metrics.project_metrics(self.metrics, self.edges).withColumn("has_cycles", F.lit(not self.cycles.isEmpty()))

    def edit_cost(self) -> DataFrame:
        impact = self.reached.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("cascade"))
        by_module = None
        if self.churn is not None:
            by_module = self.modules.join(self.churn, self.modules["rel_path"] == self.churn["path"]).select("id", "category")
        return metrics.edit_cost(self.modules, self.edges, impact, by_module, self.settings.thresholds)

    def related(self) -> DataFrame:
        return context.related(self.edges, self.cycles)

    def contexts(self, full: bool = False) -> DataFrame:
        t = self.settings.thresholds
        churned = None if self.churn is None else self.modules.select("id", F.col("rel_path").alias("path")).join(self.churn, "path")
        if full:
            return context.full(self.measured, self.edges, self.insights, self.edit_cost(), self.related(), self.symbols, t, self.cycle_report, churned)
        rows = context.compact(self.measured, self.edges, self.insights, self.edit_cost(), self.related(), churned, t, self.cycle_report)
        return rows.join(self.metrics.select("id", F.col("rel_path").alias("file"), F.when(F.col("parse_error"), F.lit(True)).alias("parse_error")), "id")

    def resolve(self, asked: list[str]) -> DataFrame:
        given = self.spark.createDataFrame([(a,) for a in asked], "asked string")
        return resolve.modules_by_path(given, self.modules, self.root)

    def find(self, text: str) -> DataFrame:
        return resolve.find_modules(self.modules, text).orderBy("id")

    def path(self, source: str, target: str) -> DataFrame:
        return graph.shortest_paths(self.edges, self.spark.createDataFrame([(source, target)], "source string, target string"))

    def violation_paths(self) -> DataFrame:
        """The violations with the path behind each one of independence."""
        found = self.violations()
        return found.join(rules.independence_paths(self.edges, found), ["source", "target"], "left").withColumn("path", F.when(F.col("rule_type") == "independence", F.col("path")))

    def batch(self, ids: list[str]) -> DataFrame:
        return context.batch(self.edges, self.reached, ids)

    def violations(self) -> DataFrame:
        return rules.check(self.edges, self.settings.rules, self.reached)

    def hotspots(self, limit: int = 20) -> DataFrame | None:
        if self.churn is None:
            return None
        sized = self.modules.select(F.col("rel_path").alias("path"), "id", "cc")
        return churn.hotspots(self.churn, sized, limit)

    def unused(self) -> DataFrame:
        return symbols.unused(self.symbols, self.references, self.settings.decorators)

    def symbol_hotspots(self, least: int = 2) -> DataFrame:
        return symbols.hotspots(self.references, least)

    def symbol_impact(self, name: str) -> DataFrame:
        return symbols.impact(self.references).where(F.col("name") == name)

    def changes(self) -> DataFrame:
        """Files that came, went or differ since the tree was read."""
        now = files.read_tree(self.spark, self.root, self.settings)
        return files.changed(files.hashes(self.files), files.hashes(now))

    def refresh(self) -> list[str]:
        """The changed files; if there are any, all tables are computed anew when asked for."""
        changed = [r[0] for r in self.changes().select("rel_path").collect()]
        if changed:
            for name in [n for n in vars(self) if isinstance(getattr(type(self), n, None), cached_property)]:
                delattr(self, name)
        return sorted(changed)

    def views(self, prefix: str = "") -> list[str]:
        """Register the tables as temporary views, for SQL."""
        tables = {"modules": self.modules, "edges": self.edges, "imports": self.imports, "symbols": self.symbols, "metrics": self.metrics, "cycles": self.cycles, "insights": self.insights}
        for name, df in tables.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in tables]
