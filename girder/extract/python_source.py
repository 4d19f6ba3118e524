"""Imports, symbols and complexity of Python sources, by the standard parser."""

from __future__ import annotations

import ast
from collections.abc import Iterable

# Statements and expressions that add a branch (fixed values).
_BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_ABSTRACT_BASES = {"ABC", "ABCMeta", "Protocol"}


def cyclomatic(node: ast.AST) -> int:
    """One, one more for each branch, and for each operand of a boolean chain after the first."""
    return 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))


def cognitive(body: Iterable[ast.stmt], depth: int = 0) -> int:
    """Branches weighted by how deep they are nested."""
    return sum(_cognitive_of(s, depth) for s in body)


def _cognitive_of(s: ast.stmt, depth: int) -> int:
    chains = sum(len(c.values) - 1 for c in ast.iter_child_nodes(s) if isinstance(c, ast.BoolOp))
    if isinstance(s, ast.If):
        rest = 0
        if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If):
            rest = cognitive(s.orelse, depth)
        elif s.orelse:
            rest = 1 + cognitive(s.orelse, depth + 1)
        return chains + 1 + depth + cognitive(s.body, depth + 1) + rest
    if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
        return chains + 1 + depth + cognitive(s.body, depth + 1) + (1 + cognitive(s.orelse, depth + 1) if s.orelse else 0)
    if isinstance(s, (ast.Try, ast.TryStar)):
        caught = sum(1 + depth + cognitive(h.body, depth + 1) for h in s.handlers)
        return chains + caught + sum(cognitive(part, depth) for part in (s.body, s.orelse, s.finalbody))
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return chains + 1 + depth + cognitive(s.body, depth + 1)
    if isinstance(s, _FUNCTIONS):
        return chains + cognitive(s.body, depth + 1)
    if isinstance(s, ast.ClassDef):
        return chains + cognitive(s.body, depth)
    return chains


def _dotted(node: ast.expr) -> str:
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def _decorators(node: ast.AST) -> list[str]:
    return [name for name in map(_dotted, node.decorator_list) if name]


def _is_abstract(node: ast.ClassDef) -> bool:
    last = {_dotted(b).rpartition(".")[2] for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))}
    meta = any(k.arg == "metaclass" and _dotted(k.value).rpartition(".")[2] == "ABCMeta" for k in node.keywords)
    marked = any(name.rpartition(".")[2] == "abstractmethod" for f in node.body if isinstance(f, _FUNCTIONS) for name in _decorators(f))
    return bool(last & _ABSTRACT_BASES) or meta or marked


def symbols(tree: ast.Module) -> list[dict]:
    """Top-level classes and functions, and the methods of those classes."""
    out = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            methods = [f for f in node.body if isinstance(f, _FUNCTIONS)]
            out.append(_symbol(node, node.name, "class", len(methods), _is_abstract(node)))
            out += [_symbol(f, f"{node.name}.{f.name}", "method", 0, False) for f in methods]
        elif isinstance(node, _FUNCTIONS):
            out.append(_symbol(node, node.name, "function", 0, False))
    return out


def _symbol(node: ast.AST, name: str, kind: str, methods: int, abstract: bool) -> dict:
    return {"name": name, "kind": kind, "line": node.lineno, "end_line": node.end_lineno or node.lineno, "method_count": methods, "complexity": cyclomatic(node), "is_abstract": abstract, "decorators": _decorators(node)}


def _is_guard(node: ast.stmt) -> bool:
    return isinstance(node, ast.If) and (isinstance(node.test, ast.Name) and node.test.id == "TYPE_CHECKING" or isinstance(node.test, ast.Attribute) and node.test.attr == "TYPE_CHECKING")


def imports(tree: ast.Module) -> list[dict]:
    """Raw imports in order: ``raw, level, name, line, is_from_import, is_type_checking, is_deferred``.

    ``from X import y`` names ``X.y``, and ``X`` itself unless an earlier import named it. Blocks other
    than functions, classes, ``if``, and the body and handlers of ``try`` are not entered.
    """
    out: list[dict] = []
    named: set[tuple[int, str]] = set()

    def add(level: int, raw: str, name: str, node: ast.stmt, is_from: bool, checking: bool, deferred: bool) -> None:
        named.add((level, raw))
        out.append({"raw": raw, "level": level, "name": name, "line": node.lineno, "is_from_import": is_from, "is_type_checking": checking, "is_deferred": deferred})

    def walk(body: list[ast.stmt], checking: bool, deferred: bool, top: bool) -> None:
        for node in body:
            if top and _is_guard(node):
                walk(node.body, True, deferred, False)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    add(0, a.name, a.name, node, False, checking, deferred)
            elif isinstance(node, ast.ImportFrom):
                base = node.module or ""
                for a in node.names:
                    add(node.level, f"{base}.{a.name}" if base else a.name, a.name, node, True, checking, deferred)
                if (node.level, base) not in named:
                    add(node.level, base, base if not node.level else node.names[0].name, node, True, checking, deferred)
            elif isinstance(node, _FUNCTIONS):
                walk(node.body, checking, True, False)
            elif isinstance(node, ast.ClassDef):
                walk(node.body, checking, deferred, False)
            elif isinstance(node, ast.If):
                walk(node.body, checking, deferred, False)
                walk(node.orelse, checking, deferred, False)
            elif isinstance(node, ast.Try):
                walk(node.body, checking, deferred, False)
                for h in node.handlers:
                    walk(h.body, checking, deferred, False)

    walk(tree.body, False, False, True)
    return out


def parse(source: str) -> dict:
    """All of the above; a source that doesn't parse has ``parse_error`` and nothing else."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return {"imports": [], "symbols": [], "cyclomatic": 1, "cognitive": 0, "parse_error": True, "loc": None}
    return {"imports": imports(tree), "symbols": symbols(tree), "cyclomatic": cyclomatic(tree), "cognitive": cognitive(tree.body), "parse_error": False, "loc": None}
