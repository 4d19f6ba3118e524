"""Resolution of imports, specifiers and paths: candidates in order, the first known one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.names import alias_matches, alias_rest, extension


def _first_known(candidates: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Of each key's ``candidate``s, exploded with their ``place``, the first that is an ``id``."""
    hit = candidates.join(known.select(F.col("id").alias("candidate")).distinct(), "candidate")
    return hit.groupBy(*key).agg(F.min_by("candidate", "place").alias("resolved"))


def trimmed(name: Column) -> Column:
    """A name with one, two ... parts cut off its end, the longest first."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))


def absolute_imports(raws: DataFrame, nodes: DataFrame, project: str) -> DataFrame:
    """``raw, resolved``: the module that an absolute import names, null for external ones.

    Tried in turn: the name, the name below the project, the name cut from its end part by
    part, and the same below the project.
    """
    raw = F.col("raw")
    below = F.concat(F.lit(project + "."), raw)
    # cut below the project no further than to one part of the name
    cut = F.transform(trimmed(raw), lambda x: F.concat(F.lit(project + "."), x))
    names = F.concat(F.array(raw, below), trimmed(raw), cut)
    exploded = raws.select("raw").distinct().select("raw", F.posexplode(names).alias("place", "candidate"))
    return raws.select("raw").distinct().join(_first_known(exploded, nodes, ["raw"]), "raw", "left")


def join_path(folder: Column, relative: Column) -> Column:
    """A path below a folder, with ``.`` and ``..`` taken out; null if it leaves the root."""
    parts = F.concat(F.filter(F.split(folder, "/"), lambda p: p != ""), F.filter(F.split(relative, "/"), lambda p: (p != "") & (p != ".")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(acc: Column, p: Column) -> Column:
        up = p == ".."
        kept = F.when(up, F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["kept"], p))
        return F.struct(kept.alias("kept"), (acc["ok"] & ~(up & (F.size(acc["kept"]) == 0))).alias("ok"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["kept"], "/")))


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def specifiers(imports: DataFrame, paths: DataFrame, aliases: list[tuple[str, list[str]]] | None = None, base_url: str = "", package_root: str = "") -> DataFrame:
    """``importer, specifier, resolved``: the file that a script's specifier names, or null.

    ``imports`` has ``importer`` (a path) and ``specifier``; ``paths`` has ``id, ext``. With a
    known extension the path must be that; else each extension is tried in order, then an
    ``index`` file with each. Aliases are tried in their order; other bare names are external.
    """
    exts = sorted(r[0] for r in paths.select("ext").distinct().collect())  # a handful, by definition of the scan
    spec, importer = F.col("specifier"), F.col("importer")
    relative = F.when(spec.startswith("."), join_path(folder_of(importer), spec)).when(spec.startswith("/"), join_path(F.lit(package_root), spec))
    targets = [relative]
    for alias, places in aliases or []:
        for place in places:
            filled = F.concat(F.lit(place.partition("*")[0]), alias_rest(spec, alias), F.lit(place.partition("*")[2])) if "*" in alias else F.lit(place)
            targets.append(F.when(alias_matches(spec, alias), join_path(F.lit(base_url), filled)))
    bases = F.filter(F.array(*targets), lambda x: x.isNotNull())
    known = F.array(*map(F.lit, exts))

    def tries(base: Column) -> Column:
        spelt = F.array_contains(known, extension(base))
        return F.when(spelt, F.array(base)).otherwise(F.concat(F.transform(known, lambda e: F.concat(base, e)), F.transform(known, lambda e: F.concat(base, F.lit("/index"), e))))

    asked = imports.select("importer", "specifier").distinct()
    exploded = asked.select("importer", "specifier", F.posexplode(F.flatten(F.transform(bases, tries))).alias("place", "candidate"))
    return asked.join(_first_known(exploded, paths, ["importer", "specifier"]), ["importer", "specifier"], "left")


def modules_by_path(asked: DataFrame, modules: DataFrame, root: str) -> DataFrame:
    """``asked, id``: the module that a name or path means, null if none or more than one does.

    Tried in turn: the module's id; its path; the path below the root; the path with a known
    extension more or less; a module's path as the end of what is asked; a file name that
    only one module has. ``modules`` has ``id, rel_path, ord``.
    """
    a = F.regexp_replace(F.col("asked"), r"^\./", "")
    inside = F.when(a.startswith(root.rstrip("/") + "/"), F.substring(a, F.lit(len(root.rstrip("/")) + 2), F.length(a))).otherwise(a)
    bare = F.regexp_replace(inside, r"\.[^./]+$", "")
    q = asked.select("asked").distinct().withColumn("_a", a).withColumn("_in", inside).withColumn("_bare", bare)
    m = modules.select("id", "rel_path", "ord").withColumn("_stem", F.regexp_replace("rel_path", r"\.[^./]+$", "")).withColumn("_file", F.substring_index("rel_path", "/", -1))
    m = m.withColumn("_folder", F.when(F.col("_stem").rlike(r"(^|/)index$"), folder_of(F.col("rel_path"))))

    def hit(rows: DataFrame, place: int) -> DataFrame:
        return rows.select("asked", "id", F.lit(place).alias("place"), "ord")

    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_in", "/"))), lambda k: F.array_join(F.slice(F.split("_in", "/"), k, F.size(F.split("_in", "/"))), "/")))
    named = m.withColumn("_n", F.count(F.lit(1)).over(_by("_file"))).where("_n = 1")
    found = [
        hit(q.join(m, q["_a"] == m["id"]), 0),
        hit(q.join(m, q["_a"] == m["rel_path"]), 1),
        hit(q.join(m, q["_a"] == m["_folder"]), 1),
        hit(q.join(m, q["_in"] == m["rel_path"]), 2),
        hit(q.join(m, q["_in"] == m["_stem"]), 3),
        hit(q.join(m, q["_bare"] == m["_stem"]), 3),
        hit(q.select("asked", "_in", ends.alias("_end")).join(m, F.col("_end") == m["rel_path"]), 4),
        hit(q.withColumn("_last", F.substring_index("_in", "/", -1)).join(named, F.col("_last") == named["_file"]), 5),
    ]
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    best = rows.groupBy("asked").agg(F.min_by("id", F.struct("place", "ord", "id")).alias("id"))
    return q.select("asked").join(best, "asked", "left")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def find_modules(modules: DataFrame, text: str) -> DataFrame:
    """Modules whose id holds a shell pattern (case counts) or a text (it doesn't)."""
    from girder.functions.names import glob

    c = F.col("id").cast("string")
    return modules.where(glob(c, f"*{text}*") | F.contains(F.lower(c), F.lit(text.lower()))).select("id")
