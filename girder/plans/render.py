"""Text, JSON, DOT and HTML of an analysis. Results are collected: they are for readers."""

from __future__ import annotations

import hashlib
import html
import json

from pyspark.sql import functions as F

from girder.operators import context, symbols
from girder.operators.insights import risk
from girder.operators.metrics import sort_metrics
from girder.plans.engine import Analysis

#: Lines that are shown of a dependency (fixed value).
SHOWN_LINES = 5
_COLORS = {"healthy": "#2da44e", "critical": "#cf222e"}


def _edges(a: Analysis) -> list:
    return a.edges.select("source", "target", "import_count").orderBy("source", "target").collect()


def as_dict(a: Analysis) -> dict:
    """Graph, metrics of each module and of the project, cycles and participation."""
    into: dict[str, list[str]] = {}
    out: dict[str, list[str]] = {}
    edges = _edges(a)
    for e in edges:
        out.setdefault(e.source, []).append(e.target)
        into.setdefault(e.target, []).append(e.source)
    cycles = a.cycle_report.orderBy("place").collect()
    nodes = [
        {"id": m.id, "file": m.rel_path, "package": m.package, "loc": m.loc, "language": m.language, "dependencies": sorted(out.get(m.id, [])), "dependents": sorted(into.get(m.id, [])), "metrics": _shown(m)}
        for m in a.metrics.orderBy("id").collect()
    ]
    project = a.project_metrics().first().asDict()
    return {
        "project": a.project,
        "nodes": nodes,
        "edges": [{"source": e.source, "target": e.target, "count": e.import_count} for e in edges],
        "metrics": project | {"avg_instability": round(project["avg_instability"] or 0, 3)},
        "cycles": [{"path": c.path, "length": c.length, "kind": c.kind, "severity": c.severity, "break_at": f"{c.source} → {c.target}"} for c in cycles],
        "participation": _participation(cycles),
    }


def _shown(m) -> dict:
    got = {"ca": m.ca, "ce": m.ce, "instability": round(m.instability, 3), "abstractness": round(m.abstractness, 3), "distance": round(m.distance, 3), "cc": m.cc, "cog": m.cog, "centrality": round(m.centrality, 6), "health": m.health}
    got |= {"parse_error": True} if m.parse_error else {}
    got |= {"role": m.role} if m.role != "source" else {}
    return got | ({"arch_role": m.arch_role} if m.arch_role else {})


def as_json(a: Analysis, indent: int = 2) -> str:
    return json.dumps(as_dict(a), indent=indent, default=str)


def summary(a: Analysis, sort: str = "ca", limit: int = 20) -> str:
    p = a.project_metrics().first()
    labels = ", ".join(f"{p[h]} {h}" for h in ("healthy", "moderate", "elevated", "high", "critical", "unknown") if p[h])
    head = [f"{a.project}: {p.modules} modules, {p.edges} edges, {p.loc or 0} lines, density {p.density:.4f}", f"instability {p.avg_instability or 0:.3f} on average, cycles: {'yes' if p.has_cycles else 'no'}", labels, ""]
    return "\n".join(head) + table(a, sort, limit)


def table(a: Analysis, sort: str = "ca", limit: int = 0) -> str:
    rows = sort_metrics(a.metrics, sort, limit).collect()
    lines = [f"{'module':<50} {'ca':>4} {'ce':>4} {'I':>6} {'cc':>5} {'cog':>5} {'loc':>6}  health"]
    return "\n".join(lines + [f"{r.id:<50} {r.ca:>4} {r.ce:>4} {r.instability:>6.3f} {r.cc:>5} {r.cog:>5} {r.loc:>6}  {r.health}" for r in rows]) + "\n"


def tree(a: Analysis) -> str:
    """Every module with what it imports and who imports it."""
    got, out = as_dict(a), []
    for n in got["nodes"]:
        mark = " (cycle)" if n["id"] in got["participation"] else ""
        out += [f"{n['id']}{mark}  {n['file']}, {n['loc']} lines", *(f"  -> {d}" for d in n["dependencies"]), *(f"  <- {d}" for d in n["dependents"])]
    return "\n".join(out) + "\n"


def cycle_text(a: Analysis) -> str:
    """The cycles in the report's order, then how many each module is in."""
    rows = a.cycle_report.orderBy("place").collect()
    if not rows:
        return "no cycles\n"
    told = "".join(f"{r.kind} {r.severity}: {' → '.join(r.path)}\n  break at {r.source} → {r.target}\n" for r in rows)
    return told + "participation\n" + "".join(f"  {m}: in {n} cycle(s)\n" for m, n in _participation(rows).items())


def _participation(rows: list) -> dict[str, int]:
    ring: dict[str, int] = {}
    for r in rows:
        for m in r.path[:-1]:
            ring[m] = ring.get(m, 0) + 1
    return dict(sorted(ring.items(), key=lambda x: (-x[1], x[0])))


def as_cycles(a: Analysis) -> dict:
    """Cycles and participation with the paths of files in place of module names."""
    rows = a.cycle_report.orderBy("place").collect()
    files = {r.id: r.rel_path for r in a.modules.select("id", "rel_path").collect()} if rows else {}
    cycles = [{"path": [files[m] for m in r.path], "length": r.length, "severity": r.severity, "kind": r.kind, "break_at": [files[r.source], files[r.target]]} for r in rows]
    return {"cycles": cycles, "participation": {files[m]: n for m, n in _participation(rows).items()}}


def impact(a: Analysis, module: str) -> dict:
    """Who imports a module, directly or through others."""
    direct = sorted(r[0] for r in a.edges.where(a.edges["target"] == module).select("source").distinct().collect())
    far = sorted({r[0] for r in a.reached.where(a.reached["node"] == module).select("seed").collect()} - {*direct, module})
    return {"module": module, "direct": direct, "transitive": far, "total": len(direct) + len(far)}


def impact_text(a: Analysis, module: str) -> str:
    got = impact(a, module)
    return "\n".join([f"{module}: {got['total']} modules affected", *(f"  direct {d}" for d in got["direct"]), *(f"  transitive {d}" for d in got["transitive"])]) + "\n"


def briefing(a: Analysis, asked: list[str]) -> dict:
    """What to know before changing several files together; names that mean no module are told apart."""
    found = {r.asked: r.id for r in a.resolve(asked).collect()}
    ids = list(dict.fromkeys(found[x] for x in asked if found.get(x)))
    missing = [x for x in asked if not found.get(x)]
    if not ids:
        return {"error": "no module found", "not_found": missing}
    rows = {r.id: r for r in a.measured.where(a.measured["id"].isin(ids)).withColumn("risk", risk(a.settings.thresholds)).collect()}
    touched = a.batch(ids).agg(*[F.count_if(f"is_{h}").alias(h) for h in ("dependency", "dependent", "transitive")]).first()
    shared = context.shared_dependencies(a.edges, ids).join(a.modules.select("id", "rel_path"), "id").orderBy("rel_path").collect() if len(ids) > 1 else []
    own = F.array(*map(F.lit, ids))
    rings = [r.path for r in a.cycle_report.where(F.arrays_overlap("path", own)).orderBy("place").collect()]
    bad = a.violations()
    broken = [f"{r.rule_type}: {r.source} -> {r.target} ({r.rule})" for r in bad.where(bad["source"].isin(ids) | bad["target"].isin(ids)).orderBy("rule_ord", "source", "target").collect()]
    got = {
        "files": [{"file": r.rel_path, "module": r.id, "health": r.health, "cc": r.cc, "risk": r.risk or ""} for r in (rows[i] for i in ids)],
        "combined_blast_radius": touched.transitive,
        "shared_dependencies": [r.rel_path for r in shared],
        "total_unique_dependencies": touched.dependency,
        "total_unique_dependents": touched.dependent,
    }
    return got | {name: value for name, value in (("cycle_warnings", rings), ("violations", broken), ("not_found", missing)) if value}


def module_text(a: Analysis, module: str) -> str:
    """One module: where it is, its metrics, what it imports on which lines, who imports it."""
    m = a.metrics.where(a.metrics["id"] == module).first()
    if m is None:
        return f"no module {module}\n"
    out = a.edges.where(a.edges["source"] == module).orderBy("target").collect()
    into = a.edges.where(a.edges["target"] == module).orderBy("source").collect()
    facts = [("file", m.rel_path), ("package", m.package), ("is package", m.is_package), ("lines", m.loc), ("depth", module.count(".")), ("language", m.language)]
    facts += [("ca", m.ca), ("ce", m.ce), ("instability", f"{m.instability:.3f}"), ("cyclomatic", m.cc), ("cognitive", m.cog), ("abstractness", f"{m.abstractness:.3f}"), ("distance", f"{m.distance:.3f}"), ("health", m.health)]
    lines = [module, *(f"  {name:<13}{value}" for name, value in facts), f"dependencies: {len(out)}"]
    lines += [f"  -> {e.target} (lines {', '.join(map(str, e.lines[:SHOWN_LINES]))})" for e in out]
    return "\n".join([*lines, f"dependents: {len(into)}", *(f"  <- {e.source}" for e in into)]) + "\n"


def symbol_graph(a: Analysis) -> dict:
    """Counts, hotspots and references of symbols, with the lines of each reference."""
    made = a.references.where("kind is not null")
    edges = made.groupBy("source", "target", "name").agg(F.array_sort(F.collect_list("line")).alias("lines")).orderBy("source", "target", "name").collect()
    hot = a.symbol_hotspots(2).orderBy(F.desc("usage"), "module", "name").collect()
    return {
        "total_symbols": symbols.registry(a.symbols).count(),
        "total_references": len(edges),
        "hotspots": [{"symbol": f"{r.module}.{r.name}", "usage_count": r.usage} for r in hot],
        "edges": [{"from": r.source, "to": f"{r.target}.{r.name}", "lines": r.lines} for r in edges],
    }


def _hue(package: str) -> float:
    """One hue for all packages that share their first two names."""
    return int(hashlib.md5(".".join(package.split(".")[:2]).encode()).hexdigest()[:4], 16) / 65535


def dot(a: Analysis, clusters: bool = True, rankdir: str = "LR", colored: bool = True, concentrate: bool = True) -> str:
    """GraphViz: packages as clusters, edges of cycles red, labels where there is more than one import.

    ``colored`` fills modules by their health, grey between the two ends; ``concentrate``
    lets GraphViz merge edges that run together.
    """
    red = {(x, y) for r in a.cycles.collect() for x, y in zip(r.path, r.path[1:], strict=False)}
    groups: dict[str, list] = {}
    for m in a.metrics.orderBy("id").collect():
        groups.setdefault(m.package if clusters else "", []).append(m)
    out = ["digraph modules {", f"  rankdir={rankdir};", f"  concentrate={str(concentrate).lower()};", "  node [shape=box, style=filled];"]
    for k, (package, rows) in enumerate(sorted(groups.items())):
        pad = "  "
        if package:
            out += [f"  subgraph cluster_{k} {{", f'    label="{package}"; color="{_hue(package):.3f} 0.3 0.8";']
            pad = "    "
        for m in rows:
            fill = _COLORS.get(m.health, "#d0d7de") if colored else "#ffffff"
            out.append(f'{pad}"{m.id}" [label="{m.id.split(".")[-1]}\\n({m.ca}/{m.ce})", tooltip="{m.id}\\n{m.rel_path}\\n{m.language}, {m.loc} lines", fillcolor="{fill}"];')
        out += ["  }"] if package else []
    for e in _edges(a):
        marks = (["color=red"] if (e.source, e.target) in red else []) + ([f'label="{e.import_count}"'] if e.import_count > 1 else [])
        out.append(f'  "{e.source}" -> "{e.target}"' + (f" [{', '.join(marks)}]" if marks else "") + ";")
    return "\n".join([*out, "}"]) + "\n"


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>
body{{margin:0;font:13px sans-serif;display:grid;grid-template:auto 1fr/1fr 260px;height:100vh}}header{{grid-column:1/3;padding:6px;border-bottom:1px solid #ddd}}
svg{{width:100%;height:100%}}aside{{padding:8px;overflow:auto;border-left:1px solid #ddd}}line{{stroke:#bbb}}line.on{{stroke:#cf222e}}circle{{cursor:pointer}}.off{{opacity:.12}}
</style></head><body><header><b>{title}</b> {n} modules, {cycles} cycles <input id="q" placeholder="search"> <select id="p"><option value="">all packages</option></select></header>
<svg id="g"></svg><aside id="d">Click a module.</aside><script>
const data={data},svg=document.getElementById('g'),W=svg.clientWidth,H=svg.clientHeight,ns='http://www.w3.org/2000/svg',at={{}},fill={{healthy:'#2da44e',critical:'#cf222e'}};
const N=data.nodes.length,gap=Math.sqrt(W*H/Math.max(N,1))*.6;
data.nodes.forEach((n,i)=>{{const r=gap*Math.sqrt(i+1)/2;n.x=W/2+r*Math.cos(2.4*i);n.y=H/2+r*Math.sin(2.4*i);at[n.id]=n}});
const links=data.links.map(l=>({{s:at[l.source],t:at[l.target]}}));
function step(heat){{
 const cell=new Map(),key=(x,y)=>Math.floor(x/gap/2)+':'+Math.floor(y/gap/2);
 data.nodes.forEach(n=>{{n.u=(W/2-n.x)*.01;n.v=(H/2-n.y)*.01;const k=key(n.x,n.y);cell.has(k)?cell.get(k).push(n):cell.set(k,[n])}});
 data.nodes.forEach(n=>{{for(let i=-1;i<2;i++)for(let j=-1;j<2;j++)(cell.get(key(n.x+2*i*gap,n.y+2*j*gap))||[]).forEach(m=>{{if(m===n)return;const x=n.x-m.x||.1,y=n.y-m.y||.1,d=x*x+y*y;n.u+=x*gap*gap/d*.3;n.v+=y*gap*gap/d*.3}})}});
 links.forEach(l=>{{const x=l.t.x-l.s.x,y=l.t.y-l.s.y,k=.02;l.s.u+=x*k;l.s.v+=y*k;l.t.u-=x*k;l.t.v-=y*k}});
 data.nodes.forEach(n=>{{const d=Math.hypot(n.u,n.v)||1,m=Math.min(d,heat);n.x=Math.min(W-15,Math.max(15,n.x+n.u/d*m));n.y=Math.min(H-15,Math.max(15,n.y+n.v/d*m))}});
}}
for(let h=gap;h>1;h*=.96)step(h);
links.forEach(l=>{{const e=document.createElementNS(ns,'line');[['x1',l.s.x],['y1',l.s.y],['x2',l.t.x],['y2',l.t.y]].forEach(p=>e.setAttribute(...p));l.e=e;svg.append(e)}});
function show(n){{const near=new Set([n]),out=[],into=[];
 links.forEach(l=>{{const on=l.s===n||l.t===n;l.e.setAttribute('class',on?'on':'off');if(on){{near.add(l.s);near.add(l.t);l.s===n?out.push(l.t.id):into.push(l.s.id)}}}});
 data.nodes.forEach(m=>m.e.setAttribute('class',near.has(m)?'':'off'));
 const d=document.getElementById('d');d.textContent='';const put=(tag,text)=>{{const e=document.createElement(tag);e.textContent=text;d.append(e)}};
 put('h3',n.id);[['file',n.file],['lines',n.loc],['health',n.health],['ca',n.ca],['ce',n.ce],['instability',n.instability],['cc',n.cc]].forEach(p=>put('div',p.join(': ')));
 put('h4','imports '+out.length);out.forEach(x=>put('div',x));put('h4','imported by '+into.length);into.forEach(x=>put('div',x));}}
data.nodes.forEach(n=>{{const e=document.createElementNS(ns,'circle'),t=document.createElementNS(ns,'title');t.textContent=n.id;e.append(t);[['cx',n.x],['cy',n.y],['r',n.radius],['fill',fill[n.health]||'#58a']].forEach(p=>e.setAttribute(...p));n.e=e;e.onclick=()=>show(n);svg.append(e)}});
const q=document.getElementById('q'),p=document.getElementById('p');[...new Set(data.nodes.map(n=>n.group))].sort().forEach(g=>p.append(new Option(g,g)));
q.oninput=p.onchange=()=>{{const hit=n=>n.id.toLowerCase().includes(q.value.toLowerCase())&&(!p.value||n.group===p.value);
 data.nodes.forEach(n=>n.e.setAttribute('class',hit(n)?'':'off'));links.forEach(l=>l.e.setAttribute('class',hit(l.s)&&hit(l.t)?'':'off'))}};
</script></body></html>"""


def page(a: Analysis) -> str:
    """One HTML page that draws the graph without anything from outside it."""
    rows = a.metrics.orderBy("id").collect()
    nodes = [{"id": m.id, "ca": m.ca, "ce": m.ce, "health": m.health, "file": m.rel_path, "loc": m.loc, "cc": m.cc, "instability": round(m.instability, 3), "group": (m.id.split(".") + [""])[1], "radius": min(30, max(6, 6 + 2 * (m.ca + m.ce))) / 2} for m in rows]
    data = json.dumps({"nodes": nodes, "links": [{"source": e.source, "target": e.target} for e in _edges(a)]}).replace("</", "<\\/")
    return _PAGE.format(title=html.escape(a.project), n=len(nodes), cycles=a.cycles.count(), data=data)
