"""Imports, symbols and complexity of JavaScript and TypeScript sources.

A tokenizer takes the text apart (comments, strings, templates with their expressions,
regular expressions), and passes over the tokens read what the operators need. There is no
grammar behind it: text that isn't a script gives few symbols rather than an error.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<number>\d[\w.]*)|(?P<word>[\w$#@\u0080-\U0010ffff]+)"""
    r"""|(?P<op>=>|\?\?=?|\?\.(?!\d)|&&=?|\|\|=?|\.\.\.|===?|!==?|[-+*/%<>]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@\\])|(?P<tick>`)|(?P<rest>.)""",
    re.DOTALL,
)
# A slash after one of these begins a regular expression (fixed values).
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "??", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "do", "else", "+", "-", "*", "%", "<", ">", "&", "|", "^", "~", "===", "==", "!==", "!="}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_CONTROL = {"if", "for", "while", "do", "switch", "catch"}
_LOGIC = {"&&", "||", "??"}
_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int


def tokenize(source: str) -> tuple[list[Token], set[int]]:
    """Tokens, and the lines that comments lie on (lines count from 1)."""
    out: list[Token] = []
    commented: set[int] = set()
    at, line, closers = 0, 1, []
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0]
        if text == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (r := _REGEX.match(source, at)):
            kind, text = "regex", r[0]
        if kind == "tick" or text == "}" and closers and closers[-1] == 0:
            if text == "}":
                closers.pop()
                out.append(Token("op", "}", line))
            at, line = _template(source, at + 1, line, out, closers)
            continue
        if kind == "comment":
            commented.update(range(line, line + text.count("\n") + 1))
        elif kind != "space":
            if closers and text in "{}":
                closers[-1] += 1 if text == "{" else -1
            out.append(Token(kind, text, line))
        line += text.count("\n")
        at += len(text)
    return out, commented


def _template(source: str, at: int, line: int, out: list[Token], closers: list[int]) -> tuple[int, int]:
    """The text of a template up to its end or its next expression."""
    start = at
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            break
        elif source.startswith("${", at):
            break
        else:
            at += 1
    text = source[start:at]
    out.append(Token("template", text, line))
    line += text.count("\n")
    if source.startswith("${", at):
        closers.append(0)
        out.append(Token("op", "{", line))
        return at + 2, line
    return at + 1, line


def _unquote(t: Token) -> str:
    return re.sub(r"\\(.)", r"\1", t.text[1:-1])


def _text(ts: list[Token], i: int) -> str:
    return ts[i].text if 0 <= i < len(ts) else ""


def _close(ts: list[Token], i: int) -> int:
    """The place after the bracket that closes the one at ``i``."""
    depth = 0
    while i < len(ts):
        if ts[i].kind == "op":
            depth += (ts[i].text in "([{") - (ts[i].text in ")]}")
            if depth <= 0:
                return i + 1
        i += 1
    return i


def _names(ts: list[Token]) -> list[str]:
    """What an import or export clause takes: default, ``*``, or original names."""
    out, i = [], 0
    while i < len(ts):
        t = ts[i]
        if t.text == "*":
            out.append("*")
            i += 3 if _text(ts, i + 1) == "as" else 1
        elif t.text == "{":
            end = _close(ts, i)
            fresh = True
            for x in ts[i + 1 : end - 1]:
                if x.text == ",":
                    fresh = True
                elif fresh and x.kind in ("word", "string") and x.text != "type":
                    out.append(x.text)
                    fresh = False
            i = end
        else:
            if t.kind == "word" and t.text != "type":
                out.append("default")
            i += 1
    return out


def imports(ts: list[Token]) -> list[dict]:
    """Static, dynamic, required and re-exported specifiers; one row for each name."""
    forms: list[list[tuple[str, int, list[str], bool]]] = [[], [], [], []]
    for i, t in enumerate(ts):
        if t.kind != "word" or _text(ts, i - 1) in (".", "?."):
            continue
        after = ts[i + 1] if i + 1 < len(ts) else None
        if t.text == "import" and after is not None:
            if after.kind == "string":
                forms[0].append((_unquote(after), t.line, ["*"], False))
            elif after.text == "(":
                if i + 2 < len(ts) and ts[i + 2].kind == "string":
                    forms[1].append((_unquote(ts[i + 2]), t.line, ["*"], False))
            else:
                j = _from(ts, i + 1)
                if j:
                    forms[0].append((_unquote(ts[j]), t.line, _names(ts[i + 1 : j - 1]) or ["*"], True))
        elif t.text == "require" and after is not None and after.text == "(" and i + 2 < len(ts) and ts[i + 2].kind == "string":
            forms[2].append((_unquote(ts[i + 2]), t.line, ["*"], False))
        elif t.text == "export" and after is not None and after.text in ("{", "*", "type"):
            j = _from(ts, i + 1)
            if j:
                forms[3].append((_unquote(ts[j]), t.line, _names(ts[i + 1 : j - 1]) or ["*"], True))
    seen, out = set(), []
    for specifier, line, names, is_from in (f for form in forms for f in form):
        if (specifier, line) not in seen:
            seen.add((specifier, line))
            out += [{"raw": specifier, "level": 0, "name": n, "line": line, "is_from_import": is_from, "is_type_checking": False, "is_deferred": False} for n in names]
    return out


def _from(ts: list[Token], i: int) -> int:
    """The place of the specifier after ``from``, 0 if the statement has none."""
    while i < len(ts) and ts[i].text not in (";", "(", "="):
        if ts[i].text == "{":
            i = _close(ts, i)
            continue
        if ts[i].text == "from" and i + 1 < len(ts) and ts[i + 1].kind == "string":
            return i + 1
        i += 1
    return 0


def symbols(ts: list[Token], typescript: bool) -> list[dict]:
    """Classes, functions and arrow functions at any depth; in TypeScript interfaces, types and enums."""
    out = []
    for i, t in enumerate(ts):
        if t.kind != "word" or _text(ts, i - 1) in (".", "?."):
            continue
        name = ts[i + 1].text if i + 1 < len(ts) and ts[i + 1].kind == "word" and _NAME.fullmatch(ts[i + 1].text) else ""
        if t.text == "class" and name and name not in ("extends", "implements"):
            body = _find(ts, i, "{")
            out.append(_symbol(ts, i, _close(ts, body), name, "class", _methods(ts, body), _text(ts, i - 1) == "abstract"))
        elif t.text == "function":
            j = i + 2 if _text(ts, i + 1) == "*" else i + 1
            if j < len(ts) and ts[j].kind == "word" and _text(ts, j + 1) in ("(", "<"):
                body = _find(ts, _close(ts, _find(ts, j, "(")) - 1, "{")
                out.append(_symbol(ts, i, _close(ts, body), ts[j].text, "function", 0, False))
        elif t.text in ("const", "let", "var") and name and (end := _arrow(ts, i + 2)):
            out.append(_symbol(ts, i, end, name, "function", 0, False))
        elif typescript and t.text in ("interface", "enum") and name and _text(ts, i + 2) in ("{", "extends", "<"):
            out.append(_symbol(ts, i, _close(ts, _find(ts, i, "{")), name, t.text, 0, t.text == "interface"))
        elif typescript and t.text == "type" and name and _text(ts, i + 2) in ("=", "<"):
            out.append(_symbol(ts, i, i + 3, name, "type", 0, True))
    return out


def _find(ts: list[Token], i: int, text: str) -> int:
    while i < len(ts) and ts[i].text != text:
        i += 1
    return i


def _arrow(ts: list[Token], i: int) -> int:
    """The end of the arrow function that a variable's initialiser is, 0 if it is something else."""
    while _text(ts, i) == ":" or i < len(ts) and ts[i].text not in ("=", ";", ",", "of", "in"):  # a type annotation
        i = _close(ts, i) if ts[i].text in ("(", "[", "{") else i + 1
    if _text(ts, i) != "=":
        return 0
    i += 1
    i += _text(ts, i) == "async"
    if _text(ts, i) == "(":
        i = _close(ts, i)
        while i < len(ts) and _text(ts, i) not in ("=>", ";", "{", ","):
            i += 1
    elif i < len(ts) and ts[i].kind == "word":
        i += 1
    if _text(ts, i) != "=>":
        return 0
    if _text(ts, i + 1) == "{":
        return _close(ts, i + 1)
    while i < len(ts) and ts[i].text != ";":
        i = _close(ts, i) if ts[i].text in ("(", "[", "{") else i + 1
    return i


def _methods(ts: list[Token], body: int) -> int:
    """Names followed by parameters and a block, directly in a class body."""
    n, i, end = 0, body + 1, _close(ts, body) - 1
    while i < end:
        if ts[i].kind == "word" and _text(ts, i + 1) == "(" and ts[i].text not in _CONTROL:
            j = _close(ts, i + 1)
            while j < end and ts[j].text not in ("{", ";", "}"):
                j += 1
            n += _text(ts, j) == "{"
            i = _close(ts, j) if _text(ts, j) == "{" else j + 1
        else:
            i = _close(ts, i) if ts[i].text in ("{", "(", "[") else i + 1
    return n


def _symbol(ts: list[Token], i: int, end: int, name: str, kind: str, methods: int, abstract: bool) -> dict:
    part = ts[i:end]
    return {"name": name, "kind": kind, "line": ts[i].line, "end_line": part[-1].line if part else ts[i].line, "method_count": methods, "complexity": cyclomatic(part), "is_abstract": abstract, "decorators": []}


def _is_ternary(ts: list[Token], i: int) -> bool:
    """A question mark that isn't the mark of an optional name."""
    return ts[i].text == "?" and ts[i].kind == "op" and _text(ts, i + 1) not in (":", ")", ",", "=", ";", ".")


def cyclomatic(ts: list[Token]) -> int:
    n, loops = 1, 0
    for i, t in enumerate(ts):
        if t.kind == "word" and _text(ts, i - 1) not in (".", "?.") and _text(ts, i + 1) != ":":
            if t.text == "do":
                loops += 1
            if t.text == "while" and loops and _text(ts, i - 1) in ("}", ";"):
                loops -= 1  # the end of a do
            elif t.text in ("if", "for", "while", "do", "case", "catch"):
                n += 1
        elif t.kind == "op":
            n += t.text in _LOGIC or _is_ternary(ts, i)
    return n


def _unwind(call: Generator) -> int:
    """What a generator returns that yields the calls it waits for: their depth is bounded by memory alone."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def cognitive(ts: list[Token]) -> int:
    """Control statements weighted by their nesting, one for each else and each ``&&`` or ``||``."""
    total = 0
    closes = _closes(ts)

    def run(i: int, end: int, depth: int) -> Generator:
        while i < end:
            i = yield one(i, end, depth)
        return i

    def statement(i: int, end: int, depth: int) -> Generator:
        """A block, or what goes up to a semicolon."""
        if _text(ts, i) == "{":
            stop = min(end, closes[i])
            yield run(i + 1, stop - 1, depth)
            return stop
        if i < end and ts[i].text in _CONTROL:
            return (yield one(i, end, depth))
        while i < end and ts[i].text not in (";", "}"):
            i = yield one(i, end, depth)
        return i + (_text(ts, i) == ";")

    def one(i: int, end: int, depth: int) -> Generator:
        nonlocal total
        t = ts[i]
        if t.kind == "word" and t.text in _CONTROL and _text(ts, i - 1) not in (".", "?.") and _text(ts, i + 1) != ":":
            total += 1 + depth
            word, i = t.text, i + 1
            i += _text(ts, i) == "await"
            if word != "do" and _text(ts, i) == "(":
                stop = min(end, closes[i])
                yield run(i + 1, stop - 1, depth + 1)
                i = stop
            if i < end:
                i = yield statement(i, end, depth + 1)
            if word == "do" and _text(ts, i) == "while" and i < end:
                stop = min(end, closes.get(i + 1, i + 2))
                yield run(i + 2, stop - 1, depth + 1)
                i = stop
            if word == "if" and _text(ts, i) == "else" and i < end:
                total += 1
                i = (yield statement(i + 1, end, depth + 1)) if i + 1 < end else i + 1
            return i
        if t.kind == "op":
            total += t.text in ("&&", "||")
            if _is_ternary(ts, i):
                total += 1 + depth
        return i + 1

    _unwind(run(0, len(ts), 0))
    return total


def _closes(ts: list[Token]) -> dict[int, int]:
    """For each opening bracket the place after the one that closes it, whatever its form; the end if none does."""
    out, opened = {}, []
    for i, t in enumerate(ts):
        if t.kind == "op" and t.text in "([{":
            opened.append(i)
        elif t.kind == "op" and t.text in ")]}" and opened:
            out[opened.pop()] = i + 1
    return out | dict.fromkeys(opened, len(ts))


def lines_of_code(source: str, commented: set[int]) -> int:
    """Lines that aren't blank and that no comment touches."""
    return sum(bool(x.strip()) and k not in commented for k, x in enumerate(source.splitlines(), 1))


def parse(source: str, typescript: bool = False) -> dict:
    """All of the above."""
    ts, commented = tokenize(source)
    return {"imports": imports(ts), "symbols": symbols(ts, typescript), "cyclomatic": cyclomatic(ts), "cognitive": cognitive(ts), "parse_error": False, "loc": lines_of_code(source, commented)}
