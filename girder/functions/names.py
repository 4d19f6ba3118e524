"""Column functions over paths, names and patterns."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(name: Column, pattern: str) -> Column:
    """Shell pattern over a whole name; ``*`` crosses dots, case counts."""
    return name.rlike("^" + fnmatch.translate(pattern))


def any_glob(name: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [glob(name, p) for p in patterns], F.lit(False))


def module_matches(name: Column, pattern: str) -> Column:
    """A shell pattern, the name itself, or a package that holds it."""
    return glob(name, pattern) | (name == pattern) | name.startswith(pattern + ".")


def any_module_matches(name: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [module_matches(name, p) for p in patterns], F.lit(False))


def first_match(name: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """The place of the first pattern that matches, -1 if none does."""
    out = F.lit(-1)
    for i, p in reversed(list(enumerate(patterns))):
        out = F.when(module_matches(name, p), i).otherwise(out)
    return out


def python_module(rel_path: Column, project: str) -> Column:
    """``project.dir.file``; a package's ``__init__.py`` has the package's name."""
    bare = F.regexp_replace(rel_path, r"\.py$", "")
    name = F.regexp_replace(bare, r"(^|/)__init__$", "")
    dotted = F.translate(name, "/", ".")
    return F.when(dotted == "", F.lit(project)).otherwise(F.concat(F.lit(project + "."), dotted))


def script_module(rel_path: Column, prefix: str) -> Column:
    """``js:a.b.c``; an ``index`` file has its directory's name, at the root its own."""
    bare = F.regexp_replace(rel_path, r"\.[^./]+$", "")
    folder = F.regexp_replace(bare, r"/index$", "")
    return F.concat(F.lit(prefix + ":"), F.translate(folder, "/", "."))


def is_init(rel_path: Column) -> Column:
    return rel_path.rlike(r"(^|/)__init__\.py$")


def extension(rel_path: Column) -> Column:
    return F.lower(F.regexp_extract(rel_path, r"(\.[^./]+)$", 1))


def python_loc(text: Column) -> Column:
    """Lines that hold something other than blanks and don't begin with ``#``."""
    lines = F.split(text, r"\r\n|\r|\n")
    return F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[^\s#]")))


def rename_target(path: Column) -> Column:
    """The new path of ``{a => b}/f`` or ``a => b``."""
    braces = F.regexp_extract(path, r"^([^{]*)\{[^}]*? => ([^}]*)\}(.*)$", 1)
    joined = F.concat(braces, F.regexp_extract(path, r"^([^{]*)\{[^}]*? => ([^}]*)\}(.*)$", 2), F.regexp_extract(path, r"^([^{]*)\{[^}]*? => ([^}]*)\}(.*)$", 3))
    return F.when(path.rlike(r"^[^{]*\{[^}]*? => [^}]*\}"), F.replace(joined, F.lit("//"), F.lit("/"))).when(F.instr(path, " => ") > 0, F.regexp_replace(path, r"^.*? => ", "")).otherwise(path)


def relative_base(module: Column, is_package: Column, level: Column, part: Column) -> Column:
    """What ``from <level dots><part> import`` names from ``module``; null beyond the top."""
    parts = F.split(module, r"\.")
    home = F.when(is_package, F.size(parts)).otherwise(F.size(parts) - 1)
    left = home - (level - 1)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), ".")
    return F.when(left > 0, F.when(F.coalesce(part, F.lit("")) == "", base).otherwise(F.concat_ws(".", base, part)))


def alias_matches(specifier: Column, alias: str) -> Column:
    """A path alias: one ``*`` stands for any text, otherwise the alias itself."""
    if "*" in alias:
        head, _, tail = alias.partition("*")
        return specifier.startswith(head) & specifier.endswith(tail) & (F.length(specifier) >= len(head) + len(tail))
    return specifier == alias


def alias_rest(specifier: Column, alias: str) -> Column:
    """What the alias's ``*`` stands for."""
    head, _, tail = alias.partition("*")
    return F.when(alias_matches(specifier, alias), F.substring(specifier, F.lit(len(head) + 1), F.length(specifier) - len(head) - len(tail)))
