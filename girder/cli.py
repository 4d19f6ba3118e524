"""Command line: ``python -m girder.cli COMMAND PROJECT``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from girder.config import Settings, find_settings, normal_languages
from girder.operators import metrics
from girder.plans import render
from girder.plans.engine import Analysis
from girder.session import build_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="girder", description="Architecture analysis of source trees on Spark.")
    commands = p.add_subparsers(dest="command")

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.add_argument("project")
        c.add_argument("--languages", default="", help="comma-separated: python, javascript, typescript")
        c.add_argument("--tsconfig", default="", help="tsconfig.json with the path aliases; the project's own by default")
        c.add_argument("--package-root", default="", help="folder that script specifiers with a leading slash start from; the project by default")
        return c

    c = command("analyze", "report on a project")
    c.add_argument("-f", "--format", choices=["text", "json", "dot", "html"], default="text")
    c.add_argument("-o", "--output")
    c.add_argument("--max-depth", type=int, help="names with more parts below the project are one module")
    c.add_argument("--exclude", nargs="*", action="extend", default=[])
    c.add_argument("--include", nargs="*", action="extend", default=[])
    c = command("context", "what to know before changing files")
    c.add_argument("files", nargs="+")
    c.add_argument("--full", action="store_true")
    c.add_argument("--text", action="store_true", help="a module's facts as text")
    c = command("show", "write the graph as a page")
    c.add_argument("-o", "--output", default="graph.html")
    c.add_argument("--max-depth", type=int)
    c = command("check", "check architecture rules; exit code 1 on a violation")
    c.add_argument("--config", help="settings file; the nearest girder.toml or pyproject.toml by default")
    c.add_argument("--no-cycles", action="store_true")
    c = command("metrics", "metrics of all modules")
    c.add_argument("--sort", default="ca")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--functions", action="store_true")
    c.add_argument("--json", action="store_true")
    c = command("impact", "who uses a module or symbol")
    c.add_argument("file", nargs="?")
    c.add_argument("-s", "--symbol")
    c.add_argument("--hotspots", action="store_true")
    c.add_argument("--unused", action="store_true")
    c.add_argument("--json", action="store_true")
    c = command("hotspots", "complex files that change often; exit code 1 without a history")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--days", type=int, default=90)
    c.add_argument("--json", action="store_true")
    return p


def _rows(df) -> str:
    return "".join(json.dumps(r.asDict(recursive=True), default=str) + "\n" for r in df.collect())


def _one(rows: dict) -> str:
    return json.dumps(rows, indent=2, default=str) + "\n"


def _dicts(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(args: argparse.Namespace) -> tuple[int, str]:
    """Exit code and output of a parsed command."""
    base = find_settings(args.project, getattr(args, "config", None)) if args.command in ("check", "impact") else Settings()
    base = replace(base, tsconfig=args.tsconfig or base.tsconfig, package_root=args.package_root or base.package_root)
    if getattr(args, "max_depth", None):
        base = replace(base, max_depth=args.max_depth)
    if args.languages:
        base = replace(base, languages=normal_languages(args.languages.split(",")))
    if args.command == "analyze":
        base = replace(base, exclude_patterns=(*base.exclude_patterns, *args.exclude), include_patterns=(*base.include_patterns, *args.include))
    a = Analysis(build_session("girder-cli"), args.project, base, getattr(args, "days", 90))
    if args.command == "analyze":
        made = {"text": render.summary, "json": render.as_json, "dot": render.dot, "html": render.page}[args.format](a)
        if not args.output:
            return 0, made
        suffix = {"text": ".txt"}.get(args.format, "." + args.format)
        path = Path(args.output if Path(args.output).suffix else args.output + suffix)
        path.write_text(made, encoding="utf-8")
        return 0, f"{path}\n"
    if args.command == "show":
        Path(args.output).write_text(render.page(a), encoding="utf-8")
        return 0, f"{args.output}\n"
    if args.command == "context":
        found = {r.asked: r.id for r in a.resolve(args.files).collect()}
        missing = [f for f in args.files if not found.get(f)]
        ids = [i for i in found.values() if i]
        if missing and not ids:
            near = [r.id for r in a.find(Path(missing[0]).stem).limit(10).collect()]
            return 1, "not found: " + ", ".join(missing) + "".join(f"\n  {n}" for n in near) + "\n"
        if len(args.files) == 1:
            if args.text:
                return 0, render.module_text(a, ids[0])
            rows = a.contexts(args.full)
            return 0, _rows(rows.where(rows["id"] == ids[0]))
        return 0, _one(render.briefing(a, args.files))
    if args.command == "check":
        rows = a.violation_paths().orderBy("rule_ord", "source", "target")
        bad = not rows.isEmpty() or args.no_cycles and not a.cycles.isEmpty()
        return int(bad), _rows(rows) + (render.cycle_text(a) if args.no_cycles else "")
    if args.command == "metrics":
        if args.functions:
            return 0, _rows(metrics.functions_by_complexity(a.symbols, 50 if args.json else 30))
        return 0, _rows(metrics.sort_metrics(a.metrics, args.sort, args.limit)) if args.json else render.table(a, args.sort, args.limit)
    if args.command == "impact":
        if args.json and (args.unused or args.hotspots or args.symbol):
            if args.unused:
                return 0, _one({"unused": _dicts(a.unused().select("module", "name", "kind", "line").orderBy("module", "line"))})
            if args.hotspots:
                return 0, _one({"hotspots": _dicts(a.symbol_hotspots().orderBy("usage", ascending=False))})
            return 0, _one({"symbol": args.symbol, "importers": _dicts(a.symbol_impact(args.symbol).orderBy("module", "importer"))})
        if args.unused:
            return 0, _rows(a.unused().select("module", "name", "kind", "line").orderBy("module", "line"))
        if args.hotspots:
            return 0, _rows(a.symbol_hotspots().orderBy("usage", ascending=False))
        if args.symbol:
            return 0, _rows(a.symbol_impact(args.symbol).orderBy("module", "importer"))
        found = a.resolve([args.file or ""]).first()
        if args.json and found and found.id:
            return 0, _one(render.impact(a, found.id))
        return (0, render.impact_text(a, found.id)) if found and found.id else (1, f"not found: {args.file}\n")
    rows = a.hotspots(args.limit)
    if rows is None:
        return 1, "no commit history\n"
    return 0, _one({"days": args.days, "hotspots": _dicts(rows)}) if args.json else _rows(rows)


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 0
    code, out = run(args)
    sys.stdout.write(out)
    return code


if __name__ == "__main__":
    sys.exit(main())
