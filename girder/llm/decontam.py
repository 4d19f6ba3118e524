"""Benchmark decontamination by the q-gram lemma.

A benchmark item of ``m`` characters that occurs in a document with at most ``k`` edits
shares ``m + 1 - q - k * q`` or more character q-grams with the place where it occurs, on
at most ``2 k + 1`` neighbouring diagonals. Each document is scanned once: the codes of its
q-grams are tested against a bit map, the few that remain are looked up with their places
in the items, and the hits are counted in overlapping bands of ``2 k + 1`` diagonals, once
with each of two offsets. Regions that meet the bound are verified by a banded alignment of
the whole item, which gives the edit distance and the place.

Texts and items are compared lower-cased, with every run of characters other than letters
and digits as one space; edits are counted on that form, and an item lies between word
boundaries of it, never inside words. Places are mapped back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import text_or_empty

Q = 12
#: From this q on items share the least.
SHARED_Q = 8
#: Edits allowed, as a share of the item's length.
EDITS = 0.08
#: Characters of items that are broadcast at a time.
BLOCK_CHARS = 4_000_000

_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(r"[^\W_]+")


def normalize(text: str) -> tuple[str, np.ndarray]:
    """The compared form of a text and, for each of its characters, its place in the text."""
    parts, places, end = [], [], 0
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow when lower-cased
        lower = "".join(c if len(c) == 1 else o for o, c in ((o, o.lower()) for o in text))
    for m in _WORDS.finditer(lower):
        if parts:
            parts.append(" ")
            places.append(np.array([end], np.int64))
        parts.append(m[0])
        places.append(np.arange(m.start(), m.end()))
        end = m.end()
    return "".join(parts), np.concatenate(places) if places else np.zeros(0, np.int64)


def compared(text: str) -> str:
    """Only the compared form; much faster than :func:`normalize`."""
    lower = text.lower()
    if len(lower) != len(text):
        return normalize(text)[0]
    return " ".join(_WORDS.findall(lower))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_codes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram, by doubling: the code of 2 n characters is made from two of n."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = {1: points.astype(np.uint64)}
    size = 1
    while size * 2 <= q:
        p = powers[size]
        powers[size * 2] = (p[:-size] ^ (p[:-size] >> np.uint64(29))) * _MIX + p[size:]
        size *= 2
    code, at = None, 0
    for size in sorted(powers, reverse=True):
        if at + size <= q:
            p = powers[size][at : at + n]
            code = p.copy() if code is None else (code ^ (code >> np.uint64(31))) * _MIX + p
            at += size
    code ^= code >> np.uint64(32)
    code *= _MIX
    return code


@dataclass
class Item:
    item_id: int
    text: str
    edits: int
    q: int
    least: int


def make_items(rows: list[tuple[int, str | None]], q: int = Q, edits: float = EDITS) -> list[Item]:
    """Items with their edit budget, the largest q that keeps the lemma's bound selective, and that bound."""
    out = []
    for item_id, text in rows:
        t = compared(text or "")
        if t:
            k = int(edits * len(t))
            own = next((x for x in range(min(q, len(t)), 0, -1) if bound(len(t), x, k) >= max(1, len(t) // 8)), max(1, min(q, len(t) // (k + 1))))
            out.append(Item(item_id, t, k, own, max(1, bound(len(t), own, k))))
    # Texts are gone through once for each q, and a smaller q serves an item as well: the
    # longer ones of a benchmark share one.
    shared = min((i.q for i in out if i.q >= SHARED_Q), default=0)
    for i in out:
        if i.q >= SHARED_Q:
            i.q, i.least = shared, max(1, bound(len(i.text), shared, i.edits))
    return out


def bound(m: int, q: int, k: int) -> int:
    """The q-gram lemma: shared q-grams of ``m`` characters and a copy with ``k`` edits, at least."""
    return m + 1 - q - k * q


class ItemIndex:
    """The q-grams of a block of items: for each q a bit map, and sorted codes with their places."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.edits, self.least = np.array([i.edits for i in items]), np.array([i.least for i in items])
        self.by_q: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in sorted({i.q for i in items}):
            codes, owner, place = [], [], []
            for n, item in enumerate(items):
                if item.q == q:
                    c = gram_codes(_codes(item.text), q)
                    codes.append(c)
                    owner.append(np.full(len(c), n, np.int32))
                    place.append(np.arange(len(c), dtype=np.int32))
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[(code >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_q[q] = (bits, code[order], np.concatenate(owner)[order], np.concatenate(place)[order])

    def candidates(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item number and first and last diagonal of every region that meets the bound."""
        points = _codes(text)
        for q, (bits, code, owner, place) in self.by_q.items():
            grams = gram_codes(points, q)
            at = np.flatnonzero(bits[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo = np.searchsorted(code, grams[at], "left")
            n = np.searchsorted(code, grams[at], "right") - lo
            if not n.sum():
                continue
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            hit = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            yield from self._bands(owner[hit], np.repeat(at, n), place[hit])

    def _bands(self, who: np.ndarray, where: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Bands with enough hits, counted by different places in the item and in the text.

        In an alignment every shared q-gram has its own place in both; text that repeats
        itself hits one place again and again.
        """
        enough = np.bincount(who, minlength=len(self.items)) >= self.least
        keep = enough[who]
        if not keep.any():
            return
        who, where, place = who[keep], where[keep], place[keep]
        diagonal = where - place
        edits, least = self.edits[who], self.least
        width = 4 * edits + 2  # any 2 k + 1 neighbouring diagonals lie within a band of one offset
        for offset in (np.zeros_like(width), width // 2):
            band = (diagonal + offset) // width
            order = np.lexsort((band, who))
            w, b = who[order], band[order]
            cut = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (b[1:] != b[:-1]))))
            count = np.diff(np.concatenate((cut, [len(w)])))
            good = cut[count >= least[w[cut]]]
            for i, n in zip(good.tolist(), count[count >= least[w[cut]]].tolist(), strict=True):
                rows = order[i : i + n]
                if min(len(np.unique(place[rows])), len(np.unique(where[rows]))) < least[w[i]]:
                    continue
                first = int(b[i]) * int(width[order[i]]) - int(offset[order[i]])
                yield int(w[i]), first, first + int(width[order[i]]) - 1

    def _merged(self, text: str) -> Iterator[tuple[int, int, int]]:
        """The candidates, two bands that overlap by half as one."""
        now = None
        for n, first, last in sorted(set(self.candidates(text))):
            if now and now[0] == n and first <= now[2] and last - now[1] <= 6 * self.items[n].edits + 3:
                now = (n, now[1], last)
                continue
            if now:
                yield now
            now = (n, first, last)
        if now:
            yield now

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """All ``item number, start, end, edits`` in compared form: the best place of each region."""
        found = {}
        for n, first, last in self._merged(text):
            item = self.items[n]
            lo, hi = max(0, first - item.edits), min(len(text), last + len(item.text) + item.edits + 1)
            whole = _whole(text, item.text, lo, hi)  # without edits there is nothing to align
            got = (0, whole - lo, whole - lo + len(item.text)) if whole >= 0 else banded(item.text, text[lo:hi], first - lo, last - lo, item.edits, _boundaries(text, lo, hi))
            if got is not None:
                edits, start, end = got
                key = (n, lo + end)
                if key not in found or found[key][3] > edits:
                    found[key] = (n, lo + start, lo + end, edits)
        return _apart(list(found.values()))


def _whole(text: str, item: str, lo: int, hi: int) -> int:
    """Where the item stands between word boundaries, unedited; -1 if nowhere."""
    at = text.find(item, lo, hi)
    while at >= 0:
        end = at + len(item)
        if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
            return at
        at = text.find(item, at + 1, hi)
    return -1


def _boundaries(text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For the places from ``lo`` to ``hi``: may an item start there, and may one end there?"""
    space = _codes(text[max(0, lo - 1) : hi + 1]) == 32
    before = space if lo else np.concatenate(([True], space))
    after = space[1:] if lo else space
    n = hi - lo + 1
    return before[:n], np.concatenate((after, [True]))[:n] if hi == len(text) else after[:n]


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of matches of one item that overlap, the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (m[0], m[3], m[1], m[2])):
        if all(o[0] != m[0] or m[2] <= o[1] or o[2] <= m[1] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: (m[1], m[2], m[0]))


def banded(item: str, region: str, first: int, last: int, most: int, limits: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, int, int] | None:
    """Edit distance, start and end of the best place of the whole ``item`` in ``region``.

    Only diagonals from ``first - most`` to ``last + most`` are walked; None if the distance
    is over ``most``. ``limits`` says of each place of the region, its end too, whether the
    item may start and end there. A row of the table is one numpy step over the band.
    """
    a, r = _codes(item), _codes(region)
    lo, width = first - most, last - first + 2 * most + 1
    far = len(a) + len(r) + 1
    # cost[d] and origin[d]: the cell of row i on diagonal lo + d, that is column i + lo + d
    col = np.arange(width) + lo
    inside = (col >= 0) & (col <= len(r))
    starts, ends = (np.ones(len(r) + 1, bool),) * 2 if limits is None else limits
    cost = np.where(inside & starts[np.clip(col, 0, len(r))], 0, far)
    origin = col.copy()
    ramp = np.arange(width)
    padded = np.full(len(a) + width + len(r) + 2, 0xFFFFFFFF, np.uint32)
    for i in range(len(a)):
        col = col + 1  # columns of row i + 1
        inside = (col >= 0) & (col <= len(r))
        sub = np.where((col >= 1) & (col <= len(r)), r[np.clip(col - 1, 0, max(0, len(r) - 1))] if len(r) else 0, padded[0])
        diag = cost + (sub != a[i])
        down = np.concatenate((cost[1:], [far])) + 1
        take = down < diag
        best = np.where(take, down, diag)
        start = np.where(take, np.concatenate((origin[1:], [0])), origin)
        best = np.where(inside, best, far)
        # runs of skipped text: best[d] = min over e <= d of best[e] + d - e
        key = (best - ramp) * (width + 1) + (width - ramp)
        low = np.minimum.accumulate(key)
        source = width - low % (width + 1)
        cost = best[source] + ramp - source
        origin = start[source]
        cost = np.where(inside, cost, far)
        if cost.min() > most:
            return None
    cost = np.where(inside & ends[np.clip(col, 0, len(r))], cost, far)
    d = int(np.lexsort((-origin, cost))[0])
    return (int(cost[d]), int(origin[d]), int(col[d])) if cost[d] <= most else None


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str, q: int, edits: float, chars: int) -> Iterator[ItemIndex]:
    """The items of the benchmark in blocks of ``chars`` characters, or one item, at most."""
    asked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).orderBy("item_id", "text")
    block, size = [], 0
    for row in chain(((r[0], r[1]) for r in asked.toLocalIterator()), [None]):
        if block and (row is None or size + len(row[1] or "") > chars):
            if items := make_items(block, q, edits):
                yield ItemIndex(items)
            block, size = [], 0
        if row is not None:
            block.append(row)
            size += len(row[1] or "")


_HIT = "doc_id string, item_id long, start long, end long, edits int, item_chars int"


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edits: float = EDITS,
    q: int = Q,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Every place where a document holds a benchmark item: ``doc_id, item_id, start, end, edits, item_chars``.

    ``start`` and ``end`` are code points of the whole text, ``edits`` and ``item_chars``
    are of the compared form. An item occurs where its whole text aligns with at most
    ``edits`` of its length. The benchmark is a stated query set: it is gone through in
    blocks of at most ``block_chars`` characters (or one item), each of which is broadcast
    and scanned against all rows, so that what is broadcast never grows with it. Null and
    empty texts hold nothing; null and empty items occur nowhere; items that repeat are
    each reported. Documents that repeat are each reported; one without an id comes with a
    null ``doc_id``. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = None
    for index in _indexes(benchmark, item_col, item_text_col, q, edits, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                    if got := index.matches(compared(text)):
                        places = normalize(text)[1]
                        for n, start, end, cost in got:
                            item = index.items[n]
                            out.append((doc_id, item.item_id, int(places[start]), int(places[end - 1]) + 1, cost, len(item.text)))
                made = pd.DataFrame(out, columns=[c.split()[0] for c in _HIT.split(", ")])
                yield made.astype({"doc_id": object, "item_id": "Int64"})

        part = rows.mapInPandas(scan, _HIT)
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], _HIT) if found is None else found
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Each row goes by its own text, whatever its id: null and empty texts stay, rows that
    repeat stay or go together. With an empty benchmark, or one of empty items, all rows
    stay; an empty table gives an empty result.
    """
    for index in _indexes(benchmark, item_col, item_text_col, q, edits, block_chars):
        docs = docs.where(_is_clean(docs.sparkSession.sparkContext.broadcast(index))(text_or_empty(text_col)))
    return docs


def _is_clean(shared: Broadcast[ItemIndex]):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.matches(compared(t)) for t in texts], dtype=bool)

    return clean
