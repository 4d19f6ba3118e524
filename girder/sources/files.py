"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.config import Settings
from girder.functions.names import any_glob, extension, is_init, python_loc, python_module, script_module
from girder.operators.graph import package_of
from girder.session import hadoop_path

# Extensions of each language (fixed values).
EXTENSIONS = {"python": (".py",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx", ".mts", ".cts")}


def read_tree(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """``rel_path, content, ord``: the files of a tree in scan order.

    Directories are walked top-down and the files of one come before its sub-directories.
    Paths are filtered before any content is read.
    """
    settings = settings or Settings()
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # paths come as URIs; the tree's own part is what follows its last mention of the root
    rel = F.expr("substring(path, instr(path, '{0}/') + length('{0}/'))".format(base.split(":", 1)[-1].replace("'", "''")))
    known = [e for lang in settings.languages for e in EXTENSIONS[lang]]
    found = rows.select(rel.alias("rel_path"), "content")
    # the reader passes over files without content, which still are modules
    empty = [(p,) for p in _empty_files(spark, base)]
    if empty:
        found = found.unionByName(spark.createDataFrame(empty, "rel_path string").withColumn("content", F.lit(b"").cast("binary")))
    kept = found.where(extension(F.col("rel_path")).isin(known) & in_open_directories("rel_path", settings.exclude_dirs))
    depth_first = F.transform(F.split("rel_path", "/"), lambda p, i: F.when(i == F.size(F.split("rel_path", "/")) - 1, F.concat(F.lit("0"), p)).otherwise(F.concat(F.lit("1"), p)))
    # the list of paths alone is ordered, contents stay where they are
    place = kept.select("rel_path", depth_first.alias("_key"))
    ordered = place.withColumn("ord", F.row_number().over(Window.orderBy("_key")).cast("long")).drop("_key")
    return kept.withColumn("content", F.decode("content", "UTF-8")).join(ordered, "rel_path")


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    """Paths below ``root`` of files without content, from the file system's own listing."""
    fs, p = hadoop_path(spark, root)
    if not fs.exists(p):
        return []
    top = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            out.append(f.getPath().toUri().getPath().removeprefix(top))
    return out


def in_open_directories(path: str, closed: tuple[str, ...]):
    """No directory of the path is closed or hidden; the file's own name doesn't count."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(folders, lambda p: p.isin(*closed) | p.startswith("."))


def scan_modules(files: DataFrame, project: str, settings: Settings | None = None) -> DataFrame:
    """``id, package, rel_path, is_package, loc, language, ord``: the modules of a tree.

    Excluded patterns come before included ones; of files with one id the later stays.
    ``loc`` counts Python lines here; other languages get theirs when they are parsed.
    """
    settings = settings or Settings()
    path = F.col("rel_path")
    ext = extension(path)
    language = F.coalesce(*[F.when(ext.isin(list(EXTENSIONS[lang])), lang) for lang in settings.languages])
    named = files.where(in_open_directories("rel_path", settings.exclude_dirs)).withColumn("language", language).where("language is not null")
    name = (
        F.when(F.col("language") == "javascript", script_module(path, "js"))
        .when(F.col("language") == "typescript", script_module(path, "ts"))
        .otherwise(python_module(path, project))
    )
    named = named.withColumn("id", name)
    if settings.exclude_patterns:
        named = named.where(~any_glob(F.col("id"), settings.exclude_patterns))
    if settings.include_patterns:
        named = named.where(any_glob(F.col("id"), settings.include_patterns))
    package = F.when(F.col("language") == "python", is_init(path)).otherwise(path.rlike(r"(^|/)index\.[^./]+$"))
    made = named.select("id", package_of("id").alias("package"), "rel_path", package.alias("is_package"), F.when(F.col("language") == "python", python_loc(F.coalesce("content", F.lit("")))).alias("loc"), "language", "ord")
    last = Window.partitionBy("id").orderBy(F.desc("ord"), F.desc("rel_path"))
    return made.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def hashes(files: DataFrame) -> DataFrame:
    """``rel_path, hash``: MD5 of each file's content."""
    return files.select("rel_path", F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("")).alias("hash"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``rel_path, change``: files that came, went or differ between two tables of hashes."""
    both = old.select("rel_path", F.col("hash").alias("_old")).join(new.select("rel_path", F.col("hash").alias("_new")), "rel_path", "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("rel_path", kind.alias("change")).where("change is not null")
