"""Parsers, names, logs and settings."""

from __future__ import annotations

import ast

import pytest
from pyspark.sql import functions as F

from girder.config import RELAXED, STRICT, Thresholds, find_settings, normal_languages
from girder.extract import python_source, script_source
from girder.functions import names
from girder.operators import churn, metrics
from girder.sources import gitlog


@pytest.mark.parametrize("source, cc, cog", [
    ("x = 1", 1, 0),
    ("def f(a):\n    if a:\n        return 1\n", 2, 2),
    ("if a and b or c:\n    pass\nelif d:\n    pass\nelse:\n    pass\n", 5, 4),
    ("for x in y:\n    if x:\n        for z in x:\n            if z:\n                try:\n                    pass\n                except E:\n                    if q: pass\n", 7, 21),
    ("with a:\n    while b:\n        pass\n    else:\n        pass\n", 3, 4),
    ("x = a if b else c\nassert x\n", 3, 0),
])
def test_python_complexity(source, cc, cog):
    tree = ast.parse(source)
    assert (python_source.cyclomatic(tree), python_source.cognitive(tree.body)) == (cc, cog)


def test_python_imports_and_symbols():
    got = python_source.parse(
        "from typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from .m import X\nelse:\n    import hidden\nfrom . import a\nclass K(abc.ABC):\n    @app.get('/x')(1)\n    def f(self):\n        import json\n"
        "async def g(): pass\nfor i in x:\n    import never\nclass P(Protocol[T]): pass\nclass M(metaclass=ABCMeta): pass\n"
    )
    raws = [(i["raw"], i["level"], i["is_type_checking"], i["is_deferred"]) for i in got["imports"]]
    assert ("m.X", 1, True, False) in raws and ("json", 0, False, True) in raws and ("", 1, False, False) in raws
    assert not {"hidden", "never"} & {r[0] for r in raws}
    kinds = {s["name"]: (s["kind"], s["is_abstract"], s["decorators"]) for s in got["symbols"]}
    assert kinds == {"K": ("class", True, []), "K.f": ("method", False, ["app.get"]), "g": ("function", False, []), "P": ("class", False, []), "M": ("class", True, [])}
    assert python_source.parse("def (")["parse_error"] and python_source.parse("a\x00b")["parse_error"]


def test_scripts():
    got = script_source.parse(
        "import d, { a as b } from './x';\nimport * as n from \"../y\"; import './side';\nconst z = require('z'); // require('no')\nexport { q } from './q';\n/* import 'no' */\n"
        "const re = /import 'no'/g, t = `x ${ a ? `n${1}` : \"b\" } y`;\nclass A { m(x) { if (x && y) { for (const i of x) { i } } else if (z) { } } get p() { return 1 } }\nexport const f = async (x) => { await import('./dyn'); return x ?? 1; };\n"
    )
    assert [(i["raw"], i["name"]) for i in got["imports"]] == [("./x", "default"), ("./x", "a"), ("../y", "*"), ("./side", "*"), ("./dyn", "*"), ("z", "*"), ("./q", "q")]
    assert [(s["name"], s["kind"], s["method_count"]) for s in got["symbols"]] == [("A", "class", 2), ("f", "function", 0)]
    # if, for, else if, &&, ??, ternary; nested: 1 if, 1 &&, 2 for, 1 else, 2 if, 1 ternary
    assert (got["cyclomatic"], got["cognitive"], got["loc"]) == (7, 8, 6)
    typed = script_source.parse("export abstract class Q<T> { a(): void {} }\ninterface I { x?: number; }\ntype T = string;\nenum E { A }\nconst k: (a: number) => number = (a) => a;", True)
    assert [(s["name"], s["kind"], s["is_abstract"]) for s in typed["symbols"]] == [("Q", "class", True), ("I", "interface", True), ("T", "type", True), ("E", "enum", False), ("k", "function", False)]
    for odd in ("", "`", "${", "/*", "'", "}}}}", "class", "const x =", "if (", "import", "((((", "a ? b"):
        script_source.parse(odd, True)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("path, want", [("{a => b}/f", "b/f"), ("a => b", "b"), ("x/{a => }/f", "x/f"), ("x/{ => n}/f", "x/n/f"), ("plain", "plain")])
def test_rename_target(spark, path, want):
    assert one(spark, names.rename_target(F.lit(path))) == want


@pytest.mark.parametrize("module, package, level, part, want", [("p.a.b", False, 1, "c", "p.a.c"), ("p.a.b", False, 2, "", "p"), ("p.a.b", False, 3, "c", None), ("p.a", True, 1, "c", "p.a.c"), ("p", True, 2, "x", None), ("p.a.b", True, 3, "x", "p.x")])
def test_relative_base(spark, module, package, level, part, want):
    assert one(spark, names.relative_base(F.lit(module), F.lit(package), F.lit(level), F.lit(part))) == want


@pytest.mark.parametrize("rel, want", [("__init__.py", "p"), ("a/__init__.py", "p.a"), ("a/b.py", "p.a.b"), ("b.py", "p.b")])
def test_python_module(spark, rel, want):
    assert one(spark, names.python_module(F.lit(rel), "p")) == want


@pytest.mark.parametrize("rel, want", [("index.js", "js:index"), ("src/index.js", "js:src"), ("src/a.jsx", "js:src.a")])
def test_script_module(spark, rel, want):
    assert one(spark, names.script_module(F.lit(rel), "js")) == want


def test_python_loc(spark):
    assert one(spark, names.python_loc(F.lit("a\n\n  # c\r\n\t\nb\r  d"))) == 3


def test_log(spark):
    lines = ["h1|2024-01-02T03:04:05+02:00|Ann", "3\t1\ta.py", "-\t-\tb\\c.bin", "", "h2|bad date|Bob", "1\t0\t{x => y}/d.py", "h3|2024-01-01T00:00:00Z|Eve|x", "2\t2\te.py"]
    rows = {r.path: r for r in gitlog.parse_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")).collect()}
    assert set(rows) == {"a.py", "b/c.bin", "y/d.py", "e.py"}
    assert rows["b/c.bin"].added == 0 and rows["a.py"].author == "Ann" and rows["y/d.py"].author_date is None and rows["e.py"].hash == "h2"


@pytest.mark.parametrize("commits, days, want", [(0, 0, "frozen"), (10, 90, "hot"), (5, 7, "hot"), (5, 8, "warm"), (3, 30, "warm"), (3, 31, "cold"), (2, 1, "cold")])
def test_churn_category(spark, commits, days, want):
    assert one(spark, churn.category(F.lit(commits), F.lit(days))) == want


HEALTH = [
    ("unknown", dict(parse_error=True, cc=99)), ("critical", dict(cc=50)), ("critical", dict(cog=50)), ("critical", dict(instability=0.9, ce=9)), ("high", dict(cc=20)), ("high", dict(cog=25)),
    ("elevated", dict(cc=10)), ("elevated", dict(instability=0.71, ce=6, ca=1)), ("moderate", dict(cc=5)), ("moderate", dict(cog=8)), ("healthy", dict()), ("healthy", dict(skip=True, instability=1.0, ce=20)),
]


@pytest.mark.parametrize("want, row", HEALTH)
def test_health(spark, want, row):
    r = dict(parse_error=False, skip=False, cc=1, cog=0, instability=0.1, ca=0, ce=1) | row
    t = Thresholds()
    limit = {f"{c}_{x}": F.lit(getattr(t, f"{c}_{x}")) for c in ("cc", "cog") for x in ("critical", "high", "elevated", "moderate")}
    got = metrics.health(*(F.lit(r[k]) for k in ("parse_error", "skip", "cc", "cog", "instability", "ca", "ce")), limit, t)
    assert one(spark, got) == want


def test_settings(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "girder.toml").write_text('[project]\nname = "x"\n[thresholds]\nprofile = "strict"\ncc_high = 12\n[rules]\nindependence = [["p.a", "p.b"]]\n[rules.layers]\norder = ["p.low", "p.high"]\n[[rules.forbidden]]\nfrom = "p.a"\nto = ["p.b"]\n')
    (tmp_path / "a" / ".girderignore").write_text("# no\n\n*.skip\n")
    s = find_settings(tmp_path / "a")
    assert s.thresholds.profile == "strict+custom" and s.thresholds.cc_high == 12 and s.thresholds.cc_critical == STRICT.cc_critical
    assert s.rules.layers == ("p.low", "p.high") and s.rules.forbidden == (("p.a", ("p.b",)),) and s.rules.independence == (("p.a", "p.b"),) and s.exclude_patterns == ("*.skip",)
    assert RELAXED.cc_high == 30 and normal_languages(["ts", "cobol", "JS"]) == ("typescript", "javascript") and normal_languages([]) == ("python",)


def test_a_base_that_was_named_before_is_not_named_again():
    import ast

    from girder.extract.python_source import imports

    def raws(text):
        return [i["raw"] for i in imports(ast.parse(text))]

    assert raws("import a.b\nfrom a.b import c") == ["a.b", "a.b.c"]
    assert raws("from a import b\nfrom a.b import c") == ["a.b", "a", "a.b.c"]
    assert raws("from a import b\nfrom a import c") == ["a.b", "a", "a.c"]


def test_framework_decorators_of_the_scan_table():
    from girder.config import FRAMEWORK_DECORATORS, from_mapping

    assert from_mapping({"scan": {"framework_decorators": {"add": ["x"], "replace": True}}}).decorators == ("x",)
    assert from_mapping({"scan": {"framework_decorators": {"add": ["x"]}}}).decorators == (*FRAMEWORK_DECORATORS, "x")
    assert from_mapping({"symbols": {"framework_decorators": {"replace": ["y"]}}}).decorators == ("y",)
    assert from_mapping({}).decorators == FRAMEWORK_DECORATORS


def test_deep_nesting_is_counted():
    n = 3000
    got = script_source.parse("if (a) { " * n + "}" * n)
    assert got["cyclomatic"] == n + 1 and got["cognitive"] == n * (n + 1) // 2
