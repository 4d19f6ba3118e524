"""Secret scans with a recursive decoding worklist.

The text itself is the first layer. From each layer come further ones: its percent-encoded
runs, its backslash escapes, its base64 runs, and, where those decode to compressed data,
what that unpacks to. A worklist decodes and rescans layer after layer until none is new;
a layer whose content was met before along its own chain of decodings is a cycle and ends
there. Every layer keeps, for each of its characters, the span of the original text that
it was made from, so that a find in any depth names code points of the document.

Compressed data is unpacked as a stream, member after member to its end, and read in
windows of about :data:`PIECE` bytes that are parted only where no find and nothing to
decode can cross. A window grows as long as there is no such place. Bytes that are not
UTF-8 stand for the Latin-1 characters of their numbers.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain as joined
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import text_or_empty

KINDS = ("assign", "access", "hex")
# Patterns of the three kinds (fixed values).
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_ASSIGN_LEAST, _ACCESS_LEAST, _HEX_LEAST = 6, 20, 24

# No find of any kind, and nothing to decode, without one of these; much faster than the patterns.
_CUE = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_LONG_HEX = re.compile(r"[0-9a-f]{24}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_DEEP_PERCENT = re.compile(r"%(?:25){8,}")
_DEEP_ESCAPE = re.compile(r"\\(u005[cC]|x5[cC])\1{7,}")
#: Fewest characters of a run that is tried as base64.
BASE64_LEAST = 16
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{BASE64_LEAST},}}={{0,2}}")
#: Line breaks, also written as escapes, that wrapped base64 goes on across.
_BREAK = r"[ \t]*(?:\r\n|\n|\r|\\r\\n|\\n)[ \t]*"
_WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{{BASE64_LEAST},}}(?:{_BREAK}[A-Za-z0-9+/_-]+(?![A-Za-z0-9+/_-])(?=={{0,2}}(?:[ \t]*(?:[\r\n]|\Z)|[\"'`<>),;\]}}\\])))+={{0,2}}")
_BREAKS = re.compile(_BREAK)
#: Text that may stand for bytes with escapes among them.
_PERCENT_BYTES = re.compile(r"[!-~]+")
_X_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|[ -\[\]-~])+")
_X_BYTE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)", re.DOTALL)
_X_NAMED = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Bytes unpacked at a time.
PIECE = 1 << 20
#: Where neither a find nor anything to decode goes on, but for runs of \x escapes in a line.
_PARTS = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])|(?<=[,;.:\"')}\]>])\r?\n|\n\n|\x00(?=\x00)")


@dataclass(frozen=True)
class Layer:
    """A decoded text. ``start[i]`` and ``end[i]`` are the original span of character i.

    Characters of compressed data all have the span of the whole; ``origin`` names the data
    and ``place[i]`` is the character of it that character i was made from.
    """

    text: str
    start: np.ndarray | None
    end: np.ndarray | None
    chain: tuple[bytes, ...]
    how: tuple[str, ...]
    origin: tuple = ()
    place: np.ndarray | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None or self.end is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def within(self, a: int, b: int) -> tuple:
        """What tells characters a to b from others of the same span."""
        return () if self.place is None else (*self.origin, int(self.place[a:b].min()), int(self.place[a:b].max()))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Finds of the three kinds in one layer; leftmost and non-overlapping by kind."""
    out = []
    if _CUE.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    for m in _LONG_HEX.finditer(text):
        # a run that was found already holds every further match within it
        if not out or out[-1][0] != "hex" or out[-1][2] <= m.start():
            out.append(("hex", m.start(), _HEX.match(text, m.start()).end()))
    return out


def _substitute(layer: Layer, pieces: list[tuple[int, int, str]], how: str) -> Layer:
    """The layer with runs replaced by their decoding, each character of which stands for its whole run."""
    text, out, starts, ends, places, at = layer.text, [], [], [], [], 0
    own_s = np.arange(len(text)) if layer.start is None else layer.start
    own_e = np.arange(1, len(text) + 1) if layer.end is None else layer.end
    for a, b, piece in pieces:
        out += [text[at:a], piece]
        starts += [own_s[at:a], np.full(len(piece), own_s[a:b].min())]
        ends += [own_e[at:a], np.full(len(piece), own_e[a:b].max())]
        if layer.place is not None:
            places += [layer.place[at:a], np.full(len(piece), layer.place[a:b].min())]
        at = b
    out.append(text[at:])
    starts.append(own_s[at:])
    ends.append(own_e[at:])
    place = None if layer.place is None else np.concatenate([*places, layer.place[at:]])
    return Layer("".join(out), np.concatenate(starts), np.concatenate(ends), layer.chain, (*layer.how, how), layer.origin, place)


_ESCAPED = {0xDC00 + b: chr(b) for b in range(0x80, 0x100)}


def _lenient(raw: bytes) -> tuple[str, list[int]]:
    """Bytes as UTF-8, others as Latin-1, and how many bytes each character has."""
    text = raw.decode("utf-8", "surrogateescape")
    if text.isascii():
        return text, [1] * len(text)
    width = [1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode("utf-8")) for c in text]
    return text.translate(_ESCAPED), width


def _percent(layer: Layer) -> Iterator[Layer]:
    deep = [(m.start(), m.end(), "%25") for m in _DEEP_PERCENT.finditer(layer.text)] if "%2525" in layer.text else []
    if deep:  # many layers of nothing but percent signs are taken off at once
        yield _substitute(layer, deep, "url")
        return
    pieces = []
    if "%" in layer.text:
        for m in _PERCENT.finditer(layer.text):
            raw = bytes.fromhex(m[0].replace("%", ""))
            at = m.start()
            for c, n in zip(*_lenient(raw), strict=True):  # each character with its own escapes
                pieces.append((at, at + 3 * n, c))
                at += 3 * n
    if pieces:
        yield _substitute(layer, pieces, "url")


def _unicode(layer: Layer) -> Iterator[Layer]:
    deep = [(m.start(), m.end(), "\\" + m[1]) for m in _DEEP_ESCAPE.finditer(layer.text)] if "\\" in layer.text else []
    if deep:  # likewise layers of backslashes
        yield _substitute(layer, deep, "unicode")
        return
    pieces = []
    if "\\" in layer.text:
        for run in _ESCAPES.finditer(layer.text):
            at, high = run.start(), None
            for m in _ESCAPE.finditer(run[0]):
                a, b = at + m.start(), at + m.end()
                code = int(next(g for g in m.groups() if g), 16)
                if code > 0x10FFFF:
                    high = None
                elif 0xDC00 <= code <= 0xDFFF:
                    if high:
                        pieces.append((high[0], b, chr(0x10000 + ((high[1] - 0xD800) << 10) + code - 0xDC00)))
                    high = None
                elif 0xD800 <= code <= 0xDBFF:
                    high = (a, code)
                else:
                    high = None
                    pieces.append((a, b, chr(code)))
    if pieces:
        yield _substitute(layer, pieces, "unicode")


def _packing(head: bytes) -> tuple[str, Callable] | None:
    """The name of a compression and a maker of its decompressor."""
    if head[:2] == b"\x1f\x8b":
        return "gzip", lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0 and not head[1] & 0x20:
        return "zlib", zlib.decompressobj
    if head[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return "xz", lambda: lzma.LZMADecompressor(memlimit=1 << 27)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return "zstd", lambda: zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    return None


def _member(name: str, d, source: Iterator[bytes], rest: list[bytes]) -> Iterator[bytes]:
    """One member in bounded pieces; ``rest`` takes what of the input comes after it."""
    if name == "zstd":  # its output can't be bounded, but a few bytes hold few blocks of 128 KiB
        for given in source:
            view = memoryview(given)
            for k in range(0, len(view), 64):
                yield d.decompress(view[k : k + 64])
                if d.eof:
                    rest += [d.unused_data, bytes(view[k + 64 :])]
                    return
        return
    zlike = name in ("gzip", "zlib")
    for given in source:
        while True:
            made = d.decompress(given, PIECE)
            given = d.unconsumed_tail if zlike else b""
            yield made
            if d.eof:
                rest.append(d.unused_data)
                return
            if len(made) < PIECE and not given and (zlike or d.needs_input):
                break


def _unpack(source: Iterator[bytes], failed: list, trailing: bool) -> Iterator[bytes]:
    """All members of compressed data, and, if ``trailing``, other bytes after them; ends where the data is broken."""
    head = b""
    while True:
        for more in source:
            head += more
            if len(head) >= 6:
                break
        if not head:
            return
        packing = _packing(head)
        if packing is None:
            if trailing:
                yield head
                yield from source
            return
        rest: list[bytes] = []
        try:
            yield from _member(packing[0], packing[1](), joined([head], source), rest)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError) as e:
            failed.append(e)
            return
        except Exception as e:  # the zstandard module's own error has no public base class
            if type(e).__name__ != "ZstdError":
                raise
            failed.append(e)
            return
        head = b"".join(rest)


def _head(source: Iterator[bytes]) -> bytes:
    head = b""
    for more in source:
        head += more
        if len(head) >= 4096:
            break
    return head[:4096]


def _streams(make: Callable[[], Iterator[bytes]], how: tuple[str, ...], outer: tuple[bytes, ...], trailing: bool, failed: list) -> Iterator[tuple[tuple[str, ...], Iterator[bytes]]]:
    """What ``make`` gives, unpacked as often as it was packed; where that breaks, also the bytes that broke."""
    head = _head(make())
    packing = _packing(head)
    if packing is None or head in outer:  # ``outer`` ends data that unpacks to itself
        yield how, make()
        return
    broken: list = []
    yield from _streams(lambda: _unpack(make(), broken, trailing), (*how, packing[0]), (*outer, head), trailing, failed)
    if broken and outer:
        yield how, make()
    failed += broken


def _windows(source: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a stream, parted where nothing crosses."""
    held, most = bytearray(), PIECE
    for piece in source:
        held += piece
        if len(held) < most:
            continue
        cut, end = 0, len(held)
        for start in (max(0, len(held) - (PIECE >> 4)), 0):
            while not cut and end > start:
                last = None
                for last in _PARTS.finditer(held, start, end):
                    pass
                if last is None:
                    break
                line = held.rfind(b"\n", 0, last.start()) + 1
                if b"\\x" in held[line : last.end()]:
                    end = line
                else:
                    cut = last.end()
        if cut:
            yield bytes(held[:cut])
            del held[:cut]
        most = max(PIECE, 2 * len(held))
    if held:
        yield bytes(held)


def _packed_layers(layer: Layer, raw: bytes, a: int, b: int, how: tuple[str, ...], trailing: bool, failed: list) -> Iterator[Layer]:
    """What compressed data that stands in ``layer`` from a to b holds, window by window."""
    first, last = layer.span(a, b)
    inside = (*layer.within(a, b), first, last, hashlib.blake2b(raw, digest_size=16).digest())
    for ways, source in _streams(lambda: iter([raw]), how, (), trailing, failed):
        at = 0
        for window in _windows(source):
            text, _ = _lenient(window)
            yield Layer(text, np.full(len(text), first), np.full(len(text), last), layer.chain, (*layer.how, *ways), (*inside, ways), np.arange(at, at + len(text)))
            at += len(text)


def _packed_escapes(layer: Layer) -> Iterator[Layer]:
    """Compressed data written with percent or ``\\x`` escapes, other bytes as they are."""
    found = []
    if "%" in layer.text:
        for m in _PERCENT_BYTES.finditer(layer.text):
            if _PERCENT.search(m[0]):
                found.append((m, unquote_to_bytes(m[0]), "url"))
    if "\\x" in layer.text:
        for m in _X_BYTES.finditer(layer.text):
            if "\\x" in m[0]:
                raw = _X_BYTE.sub(lambda e: chr(int(e[1], 16)) if e[1] else _X_NAMED.get(e[2], e[2]), m[0])
                found.append((m, raw.encode("latin-1"), "unicode"))
    for m, raw, how in found:
        for start in _PACKED.finditer(raw):
            yield from _packed_layers(layer, raw[start.start() :], m.start(), m.end(), (how,), False, [])


def _packed_text(layer: Layer) -> Iterator[Layer]:
    """Compressed data as the characters of a decoded layer."""
    if layer.how and layer.text[:1] in ("\x1f", "x", "B", "\xfd", "("):
        try:
            raw = layer.text.encode("latin-1")
        except UnicodeEncodeError:
            return
        if _PACKED.match(raw):
            yield from _packed_layers(layer, raw, 0, len(layer.text), (), True, [])


def _base64(layer: Layer) -> Iterator[tuple[bool, Iterator[Layer]]]:
    runs = [(m.start(), m.end(), m[0], None) for m in _BASE64.finditer(layer.text)]
    if runs and ("\n" in layer.text or "\r" in layer.text or "\\" in layer.text):
        for m in _WRAPPED.finditer(layer.text):
            kept = np.ones(m.end() - m.start(), bool)
            for gap in _BREAKS.finditer(m[0]):
                kept[gap.start() : gap.end()] = False
            runs.append((m.start(), m.end(), _BREAKS.sub("", m[0]), np.flatnonzero(kept) + m.start()))
    for first, last, run, places in runs:
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1:
            run = run[:-1]
        raw = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        plain = _plain_base64(layer, raw, first, places)
        if _packing(raw) is None:
            yield False, plain
        else:
            yield True, _packed_or_plain(layer, raw, first, last, plain)


def _packed_or_plain(layer: Layer, raw: bytes, first: int, last: int, plain: Iterator[Layer]) -> Iterator[Layer]:
    """What the data holds, and its bytes as they are where it doesn't unpack whole."""
    failed: list = []
    yield from _packed_layers(layer, raw, first, last, ("base64",), True, failed)
    if failed:
        yield from plain


def _plain_base64(layer: Layer, raw: bytes, first: int, places: np.ndarray | None) -> Iterator[Layer]:
    # the characters of each group of four that hold a character's bytes
    text, widths = _lenient(raw)
    width = np.array(widths)
    stop = np.cumsum(width)
    a, b = (stop - width) * 4 // 3, -(-stop * 4 // 3) - 1
    a, b = (first + a, first + b) if places is None else (places[a], places[b])
    own_s = layer.start if layer.start is not None else np.arange(len(layer.text))
    own_e = layer.end if layer.end is not None else np.arange(1, len(layer.text) + 1)
    place = None if layer.place is None else layer.place[a]
    yield Layer(text, own_s[a], own_e[b], layer.chain, (*layer.how, "base64"), layer.origin, place)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def layers(text: str) -> Iterator[Layer]:
    """The text and all that can be decoded from it, layer by layer."""
    yield from _layers(Layer(text, None, None, (), ()), set())


def _layers(top: Layer, met: set[tuple]) -> Iterator[Layer]:
    work, packed = deque([top]), deque()
    while work or packed:
        if not work:  # windows one by one, each with all that comes from it
            chain, made = packed.popleft()
            for window in made:
                if (own := _unmet(window, chain, met)) is not None:
                    yield from _layers(own, met)
            continue
        layer = work.popleft()
        yield layer
        chain = (*layer.chain, _digest(layer.text) if layer.how or "%" in layer.text or "\\" in layer.text else b"")
        packed += [(chain, _packed_escapes(layer)), (chain, _packed_text(layer))]
        for made in joined(_percent(layer), _unicode(layer)):
            if (own := _unmet(made, chain, met)) is not None:
                work.append(own)
        for late, some in _base64(layer):
            if late:
                packed.append((chain, some))
                continue
            for made in some:
                if (own := _unmet(made, chain, met)) is not None:
                    work.append(own)


def _unmet(made: Layer, chain: tuple[bytes, ...], met: set[tuple]) -> Layer | None:
    """The layer with its chain; None for a cycle, or the same text from the same place by another way."""
    if not made.text:
        return None
    own = _digest(made.text)
    key = (own, *made.span(0, len(made.text)), made.within(0, len(made.text)))
    if own in chain or key in met:
        return None
    met.add(key)
    return replace(made, chain=chain)


def scan(text: str) -> list[tuple[str, int, int, str, str]]:
    """All finds: kind, start, end, the ways of decoding (empty for the text itself), and the value found."""
    out, seen = [], set()
    for layer in layers(text):
        for kind, a, b in base_spans(layer.text):
            start, end = layer.span(a, b)
            value = layer.text[a:b]
            key = (kind, start, end, value, layer.within(a, b))
            if layer.how and key in seen:
                continue
            seen.add(key)
            out.append((kind, start, end, "+".join(layer.how), value))
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0]), f[2], f[3]))


_FOUND = "doc_id string, finds array<struct<kind:string,start:long,end:long,decoded_by:string,value:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, finds`` (kind, start, end, decoded_by, value).

    Spans are code points of the whole text, end exclusive, in order of start, then kind.
    ``decoded_by`` is empty for finds in the text itself and else names the decodings; a
    find in a decoded layer that has the kind, span and value of an earlier one is that one,
    but finds at different places of compressed data, which share its span, all count. Null
    texts count as empty; rows that repeat come out as often as they came in; null ids pass
    through; an empty table gives an empty result; other columns are ignored. A run that
    doesn't decode is left as it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            finds = [[{"kind": k, "start": a, "end": b, "decoded_by": how, "value": v} for k, a, b, how, v in scan(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "finds": finds})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, _FOUND).withColumn("doc_id", F.col("doc_id").cast("long"))
