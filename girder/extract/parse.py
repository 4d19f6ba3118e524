"""Parsing of source files in parallel, and the tables that come of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.extract import python_source, script_source
from girder.functions.names import extension, relative_base
from girder.operators.resolve import absolute_imports, specifiers

_IMPORT = "struct<raw:string,level:int,name:string,line:int,is_from_import:boolean,is_type_checking:boolean,is_deferred:boolean>"
_SYMBOL = "struct<name:string,kind:string,line:int,end_line:int,method_count:int,complexity:int,is_abstract:boolean,decorators:array<string>>"
_PARSED = f"id string, rel_path string, is_package boolean, language string, imports array<{_IMPORT}>, symbols array<{_SYMBOL}>, cyclomatic int, cognitive int, parse_error boolean, script_loc int"


def parse_files(files: DataFrame, modules: DataFrame) -> DataFrame:
    """One row for each module, with what its source holds.

    ``files`` has ``rel_path, content`` and ``modules`` is the scan of them. A source that
    can't be read or parsed has ``parse_error``; nulls count as unreadable.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, path, package, language, text in zip(*(batch[c].tolist() for c in ("id", "rel_path", "is_package", "language", "content")), strict=True):
                if text is None:
                    got = {"imports": [], "symbols": [], "cyclomatic": 1, "cognitive": 0, "parse_error": True, "loc": 0}
                elif language == "python":
                    got = python_source.parse(text)
                else:
                    got = script_source.parse(text, language == "typescript")
                out.append((i, path, package, language, got["imports"], got["symbols"], got["cyclomatic"], got["cognitive"], got["parse_error"], got["loc"]))
            made = pd.DataFrame(out, columns=["id", "rel_path", "is_package", "language", "imports", "symbols", "cyclomatic", "cognitive", "parse_error", "script_loc"])
            yield made.astype({"script_loc": "Int32"})

    rows = modules.select("id", "rel_path", "is_package", "language").join(files.select("rel_path", "content"), "rel_path")
    return rows.select("id", "rel_path", "is_package", "language", "content").mapInPandas(run, _PARSED)


def symbol_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("id").alias("module"), "language", F.explode("symbols").alias("s")).select("module", "language", "s.*")


def symbol_stats(parsed: DataFrame) -> DataFrame:
    """``id, cc, cog, class_count, abstract_count, function_count, method_count, parse_error``.

    In TypeScript interfaces and type aliases count as classes that are abstract, enums as
    classes, and abstract classes don't count as abstract; JavaScript has no abstract ones.
    """
    s = F.col("symbols")

    def count(test) -> Column:
        return F.size(F.filter(s, test))

    classes = count(lambda x: x["kind"].isin("class", "interface", "type", "enum"))
    abstract = F.when(F.col("language") == "python", count(lambda x: (x["kind"] == "class") & x["is_abstract"])).when(F.col("language") == "typescript", count(lambda x: x["kind"].isin("interface", "type"))).otherwise(0)
    methods = F.coalesce(F.aggregate(F.transform(s, lambda x: x["method_count"]), F.lit(0), lambda a, b: a + b), F.lit(0))
    return parsed.select("id", F.col("cyclomatic").alias("cc"), F.col("cognitive").alias("cog"), classes.alias("class_count"), abstract.alias("abstract_count"), count(lambda x: x["kind"] == "function").alias("function_count"), methods.alias("method_count"), "parse_error", "script_loc")


def resolved_imports(parsed: DataFrame, modules: DataFrame, project: str, aliases: list[tuple[str, list[str]]] | None = None, base_url: str = "", package_root: str = "") -> DataFrame:
    """``source, target, name, line, seq`` and the flags: every import of another module of the project."""
    seq = parsed.select(F.col("id").alias("source"), "rel_path", "is_package", "language", F.posexplode("imports").alias("seq", "i")).select("source", "rel_path", "is_package", "language", "seq", "i.*")
    python = seq.where("language = 'python'")
    base = relative_base(F.col("source"), F.col("is_package"), F.col("level"), F.col("raw"))
    named = python.withColumn("raw", F.when(F.col("level") > 0, base).otherwise(F.col("raw"))).where("raw is not null")
    known = modules.where("language = 'python'").select("id")
    found = named.join(absolute_imports(named, known, project).withColumnRenamed("resolved", "target"), "raw")
    scripts = seq.where("language <> 'python'").withColumnRenamed("raw", "specifier")
    paths = modules.where("language <> 'python'").select(F.col("rel_path").alias("id"), extension(F.col("rel_path")).alias("ext"))
    asked = scripts.select(F.col("rel_path").alias("importer"), "specifier")
    hit = specifiers(asked, paths, aliases, base_url, package_root).where("resolved is not null")
    ids = modules.select(F.col("rel_path").alias("resolved"), F.col("id").alias("target"))
    other = scripts.join(hit.withColumnRenamed("importer", "rel_path"), ["rel_path", "specifier"]).join(ids, "resolved")
    cols = ["source", "target", "name", "line", "seq", "is_from_import", "is_type_checking", "is_deferred"]
    both = found.select(*cols).unionByName(other.select(*cols))
    return both.where("target is not null and source <> target")


