"""Graphs, symbols and histories derived from relational tables.

They let every graph operator run over a star schema: suppliers are modules, an edge leads
from a supplier to the next one on the same order, parts are symbols, events are commits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.session import materialize, read_table

NOW = "2024-01-31 00:00:00"


@dataclass
class Star:
    """The tables below one folder, and what is derived from them."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def n(self) -> int:
        """Number of suppliers, that is of modules."""
        return self.table("supplier").count()

    @cached_property
    def steps(self) -> DataFrame:
        """Every step from a supplier to the next one on an order: the single imports."""
        nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
        rows = self.table("lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source"), nxt.alias("target"))
        return rows.where("target is not null and source <> target")

    @property
    def _pairs(self) -> DataFrame:
        return self.steps.groupBy("source", "target").agg(F.count(F.lit(1)).alias("import_count"))

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        """Written once: the iterative operators read a graph many times."""
        return materialize(df, label)[0]

    def once(self, label: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several parts of one query read, computed when first asked for."""
        held = vars(self).setdefault("_held", {})
        if label not in held:
            held[label] = self._kept(make(), label)
        return held[label]

    def _top(self, pairs: DataFrame, keep: str) -> DataFrame:
        best = Window.partitionBy("source").orderBy(F.desc("import_count"), "target")
        return pairs.withColumn("_k", F.row_number().over(best)).where(f"_k <= {keep}").drop("_k")

    def _flagged(self, edges: DataFrame) -> DataFrame:
        return edges.withColumn("is_type_only", F.expr("(source + target) % 5 = 0")).withColumn("is_deferred", F.expr("(source + target) % 7 = 0"))

    @cached_property
    def even_edges(self) -> DataFrame:
        """Supplier graph with three edges from each source."""
        return self._kept(self._flagged(self._top(self._pairs, "3")), "even-edges")

    @cached_property
    def edges(self) -> DataFrame:
        """Supplier graph with 1 to 12 edges from each source."""
        return self._kept(self._flagged(self._top(self._pairs, "1 + source % 12")), "edges")

    @cached_property
    def nation_edges(self) -> DataFrame:
        """From a customer's nation to a supplier's, two from each source."""
        rows = (
            self.table("lineitem").select("l_orderkey", "l_suppkey")
            .join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        )
        pairs = rows.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count(F.lit(1)).alias("import_count"))
        return self._kept(self._flagged(self._top(pairs, "2")), "nation-edges")

    @cached_property
    def forward_edges(self) -> DataFrame:
        """The supplier graph without the edges to smaller ids, but for those from every tenth: few cycles."""
        return self.even_edges.where("source < target or source % 10 = 0")

    @cached_property
    def nodes(self) -> DataFrame:
        """``id, name``: region.nation.supplier; some are named as tests, settings and packages."""
        s = self.table("supplier")
        joined = s.join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("s_suppkey").cast("string")
        last = (
            F.when(F.expr("s_suppkey % 20 = 0"), F.concat(F.lit("test_"), key))
            .when(F.expr("s_suppkey % 20 = 1"), F.concat(F.lit("s"), key, F.lit(".settings")))
            .when(F.expr("s_suppkey % 20 = 2"), F.concat(F.lit("s"), key, F.lit(".__init__")))
            .otherwise(F.col("s_name"))
        )
        return joined.select(F.col("s_suppkey").alias("id"), F.concat_ws(".", "r_name", "n_name", last).alias("name"))

    @cached_property
    def modules(self) -> DataFrame:
        """Nodes with size, complexity and class counts."""
        rows = self.table("lineitem")
        size = rows.groupBy(F.col("l_suppkey").alias("id")).agg(
            (F.lit(1) + F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))).alias("cc"),
            F.count_if((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.08) & (F.col("l_quantity") >= 25)).alias("cog"),
            F.count_distinct("l_partkey").alias("loc"),
        )
        parts = rows.select("l_suppkey", "l_partkey").distinct().join(self.table("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        classes = parts.groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("p_size") <= 40).alias("class_count"), F.count_if(F.col("p_size") <= 10).alias("abstract_count"))
        language = F.element_at(F.array(F.lit("python"), F.lit("javascript"), F.lit("typescript")), (F.col("id") % 3 + 1).cast("int"))
        made = self.nodes.join(size, "id").join(classes, "id", "left").withColumn("is_package", F.expr("id % 10 = 0"))
        return self._kept(made.withColumn("parse_error", F.expr("id % 37 = 0")).withColumn("language", language), "modules")

    @cached_property
    def named_edges(self) -> DataFrame:
        """The edges between names."""
        n = self.nodes
        s, t = n.select(F.col("id").alias("source"), F.col("name").alias("_s")), n.select(F.col("id").alias("target"), F.col("name").alias("_t"))
        return self.edges.join(s, "source").join(t, "target").select(F.col("_s").alias("source"), F.col("_t").alias("target"), "import_count", "is_type_only", "is_deferred")

    @cached_property
    def symbols(self) -> DataFrame:
        n = F.lit(self.n)
        return self.table("part").where("p_size > 25").select(
            (F.col("p_partkey") % n).alias("module"),
            F.col("p_partkey").alias("name"),
            F.when(F.col("p_size") % 3 == 0, "function").otherwise("class").alias("kind"),
            F.split("p_name", " ").alias("decorators"),
            F.col("p_size").alias("complexity"),
        )

    @cached_property
    def references(self) -> DataFrame:
        """Imports of symbols; a row is one reference."""
        n = F.lit(self.n)
        rows = self.table("lineitem").where("l_returnflag = 'R' and l_quantity >= 46")
        made = rows.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % n).alias("target"), F.col("l_partkey").alias("name"), F.lit(True).alias("is_from_import"))
        return made.where("source <> target")

    @cached_property
    def commit_files(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").cast("string").alias("hash"),
            F.col("user_id").alias("path"),
            F.col("event_type").alias("author"),
            F.col("ts").cast("timestamp").alias("author_date"),
            (F.col("event_id") % 50).alias("added"),
            (F.col("event_id") % 7).alias("removed"),
        )

    @cached_property
    def files(self) -> DataFrame:
        """Documents as source files of a tree."""
        base = F.when(F.expr("doc_id % 50 = 0"), F.lit("__init__")).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
        return self.table("documents").select(F.concat_ws("/", "source", "lang", F.concat(base, F.lit(".py"))).alias("rel_path"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))
