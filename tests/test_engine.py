"""The whole analysis over small source trees."""

from __future__ import annotations

import json
import subprocess
from dataclasses import replace

import pytest

from girder import cli
from girder.config import Rules, Settings, from_mapping
from girder.plans import render, tools
from girder.operators.symbols import by_id
from girder.plans.engine import Analysis

TREE = {
    "__init__.py": "",
    "utils.py": "def format_name(x):\n    return x\n",
    "core/__init__.py": "",
    "core/models.py": "class User:\n    def a(self): pass\n    def b(self): pass\n",
    "core/engine.py": "from . import models\n\nclass Engine:\n    def run(self):\n        for x in []:\n            if x:\n                pass\n    def stop(self): pass\n    def go(self): pass\n",
    "api/__init__.py": "",
    "api/views.py": "from ..core.engine import Engine\nfrom ..core import models\n",
    "api/broken.py": "def (",
    ".hidden/x.py": "import os\n",
    "venv/y.py": "import os\n",
    "notes.txt": "no source",
}


def write(root, tree):
    for path, text in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    return write(tmp_path_factory.mktemp("tree") / "myproject", TREE)


@pytest.fixture(scope="module")
def analysis(spark, project):
    rules = Rules(layers=("myproject.api", "myproject.core"), forbidden=(("myproject.api", ("myproject.core.models",)),), protected=((("myproject.core.models",), ("myproject.core.*",)),), independence=(("myproject.api", "myproject.core"),))
    return Analysis(spark, str(project), Settings(rules=rules))


def test_modules_and_edges(analysis):
    assert {r.id for r in analysis.modules.collect()} == {"myproject", "myproject.utils", "myproject.core", "myproject.core.models", "myproject.core.engine", "myproject.api", "myproject.api.views", "myproject.api.broken"}
    edges = {(r.source.removeprefix("myproject."), r.target.removeprefix("myproject.")) for r in analysis.edges.collect()}
    assert edges == {("core.engine", "core.models"), ("core.engine", "core"), ("api.views", "core.engine"), ("api.views", "core"), ("api.views", "core.models")}
    assert analysis.cycles.isEmpty()


def test_import_counts_are_details(analysis):
    count = {(r.source, r.target): r.import_count for r in analysis.edges.collect()}
    assert count["myproject.api.views", "myproject.core.engine"] == 2


def test_metrics_and_health(analysis):
    rows = {r.id: r for r in analysis.metrics.collect()}
    assert rows["myproject.core.models"].ca == 2 and rows["myproject.api.views"].ce == 3 and rows["myproject.api.views"].instability == 1
    assert rows["myproject.api.broken"].health == "unknown" and rows["myproject.core.engine"].cc == 3
    p = analysis.project_metrics().first()
    assert p.modules == 8 and p.edges == 5 and not p.has_cycles


def test_rules(analysis):
    got = {(r.rule_type, r.source, r.target) for r in analysis.violations().collect()}
    assert ("forbidden", "myproject.api.views", "myproject.core.models") in got
    assert ("protected", "myproject.api.views", "myproject.core.models") in got
    assert ("layers", "myproject.api.views", "myproject.core.engine") in got
    assert ("independence", "myproject.api.views", "myproject.core.models") in got


def test_symbols(analysis):
    used = {(r.module, r.name): r.usage for r in analysis.symbol_hotspots(1).collect()}
    assert used == {("myproject.core.engine", "Engine"): 2}
    assert {r.name for r in analysis.unused().collect()} == {"User", "format_name"}
    assert {r.importer for r in analysis.symbol_impact("Engine").collect()} == {"myproject.api.views"}
    got = render.symbol_graph(analysis)
    assert got["hotspots"] == [{"symbol": "myproject.core.engine.Engine", "usage_count": 2}] and "myproject.core.engine.Engine" in {e["to"] for e in got["edges"]}
    assert by_id(analysis.symbols, "myproject.core.models", "User", "class").count() == 1


def test_resolve_find_and_path(analysis, project):
    asked = ["core/engine.py", "myproject.utils", f"{project}/api/views.py", "models.py", "core/models", "none.py", "__init__.py"]
    got = {r.asked: r.id for r in analysis.resolve(asked).collect()}
    assert got == {"core/engine.py": "myproject.core.engine", "myproject.utils": "myproject.utils", f"{project}/api/views.py": "myproject.api.views", "models.py": "myproject.core.models", "core/models": "myproject.core.models", "none.py": None, "__init__.py": "myproject"}
    assert [r.id for r in analysis.find("ENG").collect()] == ["myproject.core.engine"]
    assert list(analysis.path("myproject.api.views", "myproject.core.models").first().path) == ["myproject.api.views", "myproject.core.models"]


def test_contexts_and_renderers(analysis):
    row = {r.id: r for r in analysis.contexts().collect()}["myproject.core.engine"]
    assert row.dependents == ["myproject.api.views"] and row.edit_files == 1
    full = {r.id: r for r in analysis.contexts(full=True).collect()}["myproject.core.engine"]
    assert full.symbol_count == 4
    got = json.loads(render.as_json(analysis))
    assert len(got["nodes"]) == 8 and got["cycles"] == []
    assert "myproject.core.engine" in render.summary(analysis) and '"myproject.api.views" -> "myproject.core"' in render.dot(analysis)
    assert "<svg" in render.page(analysis) and render.cycle_text(analysis) == "no cycles\n" and "direct myproject.api.views" in render.impact_text(analysis, "myproject.core.engine")
    assert "-> myproject.core.models" in render.tree(analysis)


def test_refresh_sees_new_changed_and_removed_files(spark, tmp_path):
    root = write(tmp_path / "p", {"a.py": "x = 1\n", "b.py": "y = 1\n"})
    a = Analysis(spark, str(root))
    assert a.modules.count() == 2 and a.refresh() == []
    (root / "a.py").write_text("from p import b\n")
    (root / "c.py").write_text("")
    (root / "b.py").unlink()
    assert a.refresh() == ["a.py", "b.py", "c.py"] and {r.id for r in a.modules.collect()} == {"p.a", "p.c"}


def test_cycle_tree(spark, tmp_path):
    root = write(tmp_path / "cyclic", {"__init__.py": "", "a.py": "from . import b\n", "b.py": "from . import c\n", "c.py": "from . import a\n"})
    a = Analysis(spark, str(root))
    (row,) = a.cycle_report.collect()
    assert list(row.path) == ["cyclic.a", "cyclic.b", "cyclic.c", "cyclic.a"] and row.kind == "runtime"
    assert "break at" in render.cycle_text(a) and "cyclic.b: in 1 cycle(s)" in render.cycle_text(a) and "color=red" in render.dot(a)
    assert "concentrate=false" in render.dot(a, colored=False, concentrate=False) and "#2da44e" not in render.dot(a, colored=False)
    told = tools.cycles(a)
    assert (told["count"], told["runtime_count"], told["safe_count"]) == (1, 1, 0) and told["cycles"][0]["path"] == ["a.py", "b.py", "c.py", "a.py"]
    assert tools.file_context(a, "a.py")["cycles"] == [{"path": ["cyclic.a", "cyclic.b", "cyclic.c", "cyclic.a"], "kind": "runtime"}]
    (ring,) = [x for x in tools.file_context(a, "a.py", compact=False)["all_insights"] if x["code"] == "in_cycle"]
    assert ring["detail"] == "involved in 1 cycle(s), largest has 3 modules"
    assert {r.code for r in a.insights.where("id = 'cyclic.a'").collect()} >= {"in_cycle"}


def test_scripts_and_aliases(spark, tmp_path):
    root = write(tmp_path / "web", {
        "src/index.js": "import { add } from './utils/math.js';\nimport React from 'react';\n", "src/utils/math.js": "export function add(a, b) { return a + b; }\n",
        "src/utils/math.ts": "export const sub = (a: number) => a;\n", "src/types/user.ts": "export interface User { name: string }\n",
        "src/components/Button.tsx": "import { User } from '../types/user';\n", "src/alias.ts": "import { sub } from '@lib/math';\n",
        "tsconfig.json": '{ // comment\n "compilerOptions": { "baseUrl": "src", "paths": { "@lib/*": ["utils/*"] } } }',
    })
    a = Analysis(spark, str(root), Settings(languages=("javascript", "typescript")))
    assert {r.id for r in a.modules.collect()} == {"js:src", "js:src.utils.math", "ts:src.utils.math", "ts:src.types.user", "ts:src.components.Button", "ts:src.alias"}
    edges = {(r.source, r.target) for r in a.edges.collect()}
    assert ("js:src", "js:src.utils.math") in edges and ("ts:src.components.Button", "ts:src.types.user") in edges
    assert any(s == "ts:src.alias" and t.endswith("utils.math") for s, t in edges)


def test_depth_joins_names(spark, project):
    a = Analysis(spark, str(project), Settings(max_depth=1))
    assert {r.id for r in a.modules.collect()} == {"myproject", "myproject.utils", "myproject.core", "myproject.api"}
    (edge,) = a.edges.collect()
    assert (edge.source, edge.target) == ("myproject.api", "myproject.core") and len(edge.lines) == edge.import_count > 3
    assert a.metrics.count() == 4 and "myproject.core.models" not in render.dot(a)


def test_tsconfig_elsewhere(spark, tmp_path):
    root = write(tmp_path / "web", {"app/lib/math.ts": "export const sub = 1;\n", "app/main.ts": "import { sub } from '@lib/math';\nimport x from '/lib/math';\n", "app/tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["lib/*"]}}}'})
    settings = Settings(languages=("typescript",))
    assert Analysis(spark, str(root), settings).edges.isEmpty()
    told = replace(settings, tsconfig="app/tsconfig.json")
    (edge,) = Analysis(spark, str(root), told).edges.collect()
    assert edge.import_count == 1
    (edge,) = Analysis(spark, str(root), replace(told, package_root="app")).edges.collect()
    assert edge.import_count == 2
    with pytest.raises(OSError):
        Analysis(spark, str(root), replace(settings, tsconfig="none.json")).edges.isEmpty()


def test_settings_of_languages_and_depth():
    got = from_mapping({"scan": {"language": {"typescript": {"tsconfig": "a.json", "package_root": "src"}}}, "analysis": {"max_depth": 2}, "thresholds": {"token_ratios": {"python": 3.5}}})
    assert (got.tsconfig, got.package_root, got.max_depth, got.thresholds.ratio_python) == ("a.json", "src", 2, 3.5)


def test_full_context_tells_cycles_lines_and_paths(spark, tmp_path):
    root = write(tmp_path / "ring", {"__init__.py": "", "a.py": "from . import b\n", "b.py": "from . import c\n", "c.py": "from . import a\n", "d.py": "from . import a\n"})
    a = Analysis(spark, str(root), Settings(rules=Rules(independence=(("ring.d", "ring.c"),))))
    row = {r.id: r for r in a.contexts(full=True).collect()}["ring.a"]
    assert row.cycles[0].severity == "low" and row.cycles[0].break_at.source in {"ring.a", "ring.b", "ring.c"}
    assert row.dependents[0].module == "ring.c" and row.dependents[0].lines == [1] and row.dependents_count == 2
    assert row.impact.transitive == 4 and row.threshold_profile == "default" and row.rel_path == "a.py"
    got = render.briefing(a, ["a.py", "ring.d", "nothing.py"])
    assert [f["module"] for f in got["files"]] == ["ring.a", "ring.d"] and got["not_found"] == ["nothing.py"]
    assert got["cycle_warnings"] == [["ring.a", "ring.b", "ring.c", "ring.a"]] and len(got["violations"]) == 1
    assert (got["combined_blast_radius"], got["total_unique_dependents"]) == (2, 1) and len(got["shared_dependencies"]) == 1
    assert render.briefing(a, ["x.py"]) == {"error": "no module found", "not_found": ["x.py"]}
    assert "-> ring.b (lines 1)" in render.module_text(a, "ring.a") and "<- ring.d" in render.module_text(a, "ring.a")
    assert render.module_text(a, "none") == "no module none\n" and render.symbol_graph(a)["total_symbols"] == 0
    (bad,) = a.violation_paths().collect()
    assert list(bad.path) == ["ring.d", "ring.a", "ring.b", "ring.c"]


def test_questions(analysis):
    got = tools.analyze(analysis)
    assert (got["modules"], got["dependencies"], got["has_cycles"], got["cycle_count"]) == (8, 5, False, 0) and sum(got["health"].values()) == 8
    assert tools.find(analysis, "ENG")["modules"][0]["file"] == "core/engine.py" and tools.cycles(analysis) == {"has_cycles": False}
    row = tools.file_context(analysis, "core/engine.py")
    assert row["file"] == "core/engine.py" and row["dependents"] == ["myproject.api.views"] and "cycles" not in row and "parse_error" not in row
    assert tools.file_context(analysis, "api/broken.py")["insights"][0] == "parse_failed" and tools.file_context(analysis, "api/broken.py")["parse_error"]
    assert tools.file_context(analysis, "api/broken.py", min_severity="critical")["insights"] == ["parse_failed"]
    full = tools.file_context(analysis, "api/broken.py", compact=False)
    assert full["all_insights"][0]["detail"] == "AST parse failed (LOC=1): all metrics unreliable"
    assert tools.file_context(analysis, "egine.py") == {"error": "'egine.py' not found", "suggestions": []}
    assert tools.context(analysis, ["core/engine.py"])["files"][0]["module"] == "myproject.core.engine"
    assert [m["file"] for m in tools.module_metrics(analysis, "ca", 1)["modules"]] == ["core/__init__.py"]
    assert {"classes", "functions"} <= set(tools.module_metrics(analysis, "cc", 0, compact=False)["modules"][0])
    assert tools.path(analysis, "api/views.py", "core/models.py")["hops"] == 1 and tools.path(analysis, "utils.py", "core/models.py")["path"] is None
    top = tools.overview(analysis)
    assert (top["modules"], top["edges"], top["packages"]) == (8, 5, 2) and all(h["ca"] > 0 for h in top["top_hubs"])
    assert tools.impact(analysis, mode="hotspots")["hotspots"] == [{"file": "core/engine.py", "name": "Engine", "kind": "class", "usage_count": 2}]
    unused = tools.impact(analysis, mode="unused", limit=1)
    assert (unused["total"], unused["showing"], len(unused["symbols"])) == (2, 1, 1) and unused["framework_filtered"]
    (hit,) = tools.impact(analysis, "core/engine.py", "Engine")["impacts"]
    assert hit["affected_modules"] == ["api/views.py"] and hit["affected_count"] == 1
    assert tools.impact(analysis, "core/engine.py", "Nothing")["available"] == ["Engine"] and tools.impact(analysis, "api/views.py")["symbols"] == []
    assert tools.symbols_of(analysis, "utils.py") == {"file": "utils.py", "total": 1, "symbols": [{"name": "format_name", "kind": "function", "line": 1}]}
    assert tools.symbols_of(analysis, "core/engine.py", compact=False)["symbols"][0]["usage_count"] == 2
    assert tools.hotspots(analysis)["available"] is False


def test_history(spark, tmp_path):
    root = write(tmp_path / "g", {"a.py": "def f(x):\n    if x: pass\n"})
    env = ["git", "-c", "user.name=A", "-c", "user.email=a@b.c", "-C", str(root)]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for k in range(3):
        (root / "a.py").write_text(f"def f(x):\n    if x: pass\n# {k}\n")
        subprocess.run([*env, "add", "."], check=True)
        subprocess.run([*env, "commit", "-qm", "c"], check=True)
    a = Analysis(spark, str(root))
    (row,) = a.hotspots().collect()
    assert row.id == "g.a" and row.commits == 3 and row.score == 6.0
    assert tools.hotspots(a)["hotspots"] == [{"file": "a.py", "hotspot_score": 6.0, "health": "healthy", "churn": "warm"}]
    assert tools.file_context(a, "a.py")["churn"] == "warm"
    assert Analysis(spark, str(write(tmp_path / "none", {"a.py": ""}))).hotspots() is None


def test_command_line(spark, project, tmp_path, capsys):
    assert cli.main([]) == 0
    assert cli.main(["metrics", str(project), "--limit", "3"]) == 0 and "instability" not in capsys.readouterr().err
    assert cli.main(["impact", str(project), "core/models.py"]) == 0 and "3 modules" not in capsys.readouterr().out
    assert cli.main(["context", str(project), "nothing.py"]) == 1
    assert cli.main(["analyze", str(project), "-f", "dot", "-o", str(tmp_path / "out")]) == 0 and (tmp_path / "out.dot").exists()
    (project / "girder.toml").write_text('[[rules.forbidden]]\nfrom = "myproject.api"\nto = ["myproject.core"]\n')
    assert cli.main(["check", str(project)]) == 1
    (tmp_path / "none.toml").write_text("")
    assert cli.main(["check", str(project), "--config", str(tmp_path / "none.toml")]) == 0
    capsys.readouterr()
    assert cli.main(["impact", str(project), "core/models.py", "--json"]) == 0 and json.loads(capsys.readouterr().out)["total"] == 2
    assert cli.main(["analyze", str(project), "--max-depth", "1", "-f", "json", "--exclude", "zz*", "yy*"]) == 0 and len(json.loads(capsys.readouterr().out)["nodes"]) == 4


def test_watch(spark, tmp_path):
    from girder.streaming.watch import watch

    src, seen = tmp_path / "in", []
    src.mkdir()
    spark.createDataFrame([("a", "1"), ("b", "2")], "rel_path string, content string").coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema("rel_path string, content string").json(str(src))
    q = watch(stream, str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: seen.append(sorted(tuple(r) for r in df.collect())))
    q.processAllAvailable()
    spark.createDataFrame([("a", "9"), ("b", "2"), ("c", "3")], "rel_path string, content string").coalesce(1).write.mode("append").json(str(src))
    q.processAllAvailable()
    q.stop()
    assert seen == [[("a", "added"), ("b", "added")], [("a", "modified"), ("c", "added")]]
