"""SimHash near-duplicates by vantage-point trees.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are dealt
out by a vantage-point tree: a node has a pivot and a radius, and a fingerprint goes left
where its Hamming distance from the pivot is within the radius, else right. A fingerprint
is *resident* in the one shard it falls into, and *visits* every shard that the triangle
inequality lets hold a fingerprint within the link distance: near a boundary, both sides.
Every linked pair thus meets in a shard. In a shard a tree of the same kind prunes down
to small leaves that are compared whole, and the pairs go straight into a union-find: a
shard hands on a spanning forest, never all pairs of a group. Chains over shards are
closed by alternating large-star and small-star steps on the shards' edges.

Rows of one fingerprint are one vertex, so a group of copies costs what one row costs, and
fingerprints so close together that no pivot parts them are few: there are 2,081 within two
bits of one and 43,745 within three.

Only the shape of the upper tree comes from a sample, of :data:`SAMPLE` fingerprints or
:data:`PER_SHARD` for each shard; it decides where rows are compared, never whether. A
shard of more than :data:`BLOCK_ROWS` rows is compared in parts, each of its residents'
parts with each of its visitors', so that what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import drop_rows, numbered, text_or_empty
from girder.session import discard, materialize

SEED = 42
#: Fingerprints from which the upper tree is grown.
SAMPLE, PER_SHARD = 16_384, 32
#: Rows of a shard that are compared in one task.
BLOCK_ROWS = 1 << 17
LEAF = 128
_CHUNK = 16_384


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of ``width``-word shingles, repeats included; 0 for a text without words."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        part = words[k : k + _CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, row_col: str | None = None) -> DataFrame:
    """``doc_id, row, fp``: the fingerprint as a signed long, and the number of the row if a column has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "row": batch["row"].array, "fp": fp.view(np.int64)})

    row = F.col(row_col) if row_col else F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), row.cast("long").alias("row"), text_or_empty(text_col).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, row long, fp long")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "fp")


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """The upper tree: ``nodes`` holds (pivot, radius, left, right); a child under 0 is shard ~child."""

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.shards = 0
        self.root = self._grow(sample, max(0, int(np.ceil(np.log2(max(1, shards))))))

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        split = _best_split(sample) if depth and len(sample) >= 16 else None
        if split is None:
            self.shards += 1
            return ~(self.shards - 1)
        pivot, radius, near = split
        at = len(self.nodes)
        self.nodes.append((pivot, radius, 0, 0))
        self.nodes[at] = (pivot, radius, self._grow(sample[near], depth - 1), self._grow(sample[~near], depth - 1))
        return at

    def route(self, fp: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard that is concerned: its number, the rows that visit it, which of them reside."""
        stack = [(self.root, np.arange(len(fp)), np.ones(len(fp), bool))]
        while stack:
            at, rows, home = stack.pop()
            if not len(rows):
                continue
            if at < 0:
                yield ~at, rows, home
                continue
            pivot, radius, left, right = self.nodes[at]
            d = _distance(fp[rows], pivot).astype(np.int64)
            near = d <= radius
            go = d <= radius + reach
            stack.append((left, rows[go], (home & near)[go]))
            go = d > radius - reach
            stack.append((right, rows[go], (home & ~near)[go]))


def _best_split(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int, np.ndarray] | None:
    """The pivot that leaves the fewest points near its boundary; None if none splits."""
    best = None
    for pivot in points[:: max(1, len(points) // tries)][:tries]:
        d = _distance(points, pivot).astype(np.int64)
        radius = int(np.median(d))
        near = d <= radius
        if near.all():
            radius -= 1
            near = d <= radius
        if not near.any() or near.all():
            continue
        both = np.count_nonzero(np.abs(d - radius) <= 2) / len(d) + abs(near.mean() - 0.5)
        if best is None or both < best[0]:
            best = (both, pivot, radius, near)
    return best and best[1:]


class Forest:
    """Union-find over positions, with vectorised tests of what is joined already."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.up[a], self.up[b]
        differ = a != b
        if not differ.any():
            return
        pairs = np.unique(a[differ] * len(self.up) + b[differ])
        for x, y in zip((pairs // len(self.up)).tolist(), (pairs % len(self.up)).tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
        self.flatten()

    def flatten(self) -> None:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return
            self.up = above


def link_shard(fp: np.ndarray, resident: np.ndarray, reach: int, seeking: np.ndarray | None = None) -> np.ndarray:
    """The root's position for each of the shard's fingerprints, by links of those that seek (all) to its residents."""
    forest = Forest(len(fp))
    stack = [(np.flatnonzero(resident), np.arange(len(fp)) if seeking is None else np.flatnonzero(seeking))]
    while stack:
        held, seek = stack.pop()
        if not len(held) or not len(seek):
            continue
        split = _best_split(fp[held], 4) if len(held) > LEAF else None
        if split is None:
            for h in range(0, len(held), 4096):
                block = held[h : h + 4096]
                step = max(1, (1 << 19) // len(block))
                for k in range(0, len(seek), step):
                    rows = seek[k : k + step]
                    i, j = np.nonzero(_distance(fp[rows][:, None], fp[block][None, :]) <= reach)
                    forest.join(rows[i], block[j])
            continue
        pivot, radius, near = split
        d = _distance(fp[seek], pivot).astype(np.int64)
        stack.append((held[near], seek[d <= radius + reach]))
        stack.append((held[~near], seek[d > radius - reach]))
    forest.flatten()
    return forest.up


def link_edges(distinct: DataFrame, reach: int, sample: int = SAMPLE, block_rows: int | None = None, spread: int = 4) -> DataFrame:
    """Edges ``a, b`` that join all fingerprints linked by ``reach`` bits or fewer.

    The number of shards grows as the root of the number of fingerprints: it balances the
    rows of a shard against the visits, of which each level of the tree makes half as many
    again; the wider the reach, the fewer shards (a larger ``spread``) are worth their visits.
    With a column ``band`` only fingerprints of one band or of neighbouring ones are linked:
    each shard has a part for each band, and rows also visit the next band.
    """
    spark, most = distinct.sparkSession, block_rows or BLOCK_ROWS
    banded = "band" in distinct.columns
    shards = int(np.ceil(np.sqrt(distinct.count()) / spread))
    picked = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(sample, PER_SHARD * shards)).collect()]
    tree = VantageTree(np.array(picked, np.int64).view(np.uint64), shards)
    tree_b = spark.sparkContext.broadcast(tree)  # a node for each shard at most

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            band = batch["band"].to_numpy() if banded else np.zeros(len(fp), np.int32)
            for s, rows, home in tree_b.value.route(fp.view(np.uint64), reach):
                for above in range(1 + banded):
                    shard = (band[rows] + above) * tree_b.value.shards + s
                    yield pd.DataFrame({"shard": shard.astype(np.int32), "fp": fp[rows], "resident": home & (above == 0)})

    def link(batch: pd.DataFrame) -> pd.DataFrame:
        fp = batch["fp"].to_numpy()
        up = link_shard(fp.view(np.uint64), batch["resident"].to_numpy(), reach, batch["seeks"].to_numpy())
        linked = np.flatnonzero(up != np.arange(len(up)))
        return pd.DataFrame({"a": fp[linked], "b": fp[up[linked]]})

    dealt, path = materialize(distinct.select("fp", *["band"] * banded).mapInPandas(route, "shard int, fp long, resident boolean"), "visits")
    edges, _ = materialize(parted(dealt, most).groupBy("shard", "i", "j").applyInPandas(link, "a long, b long"), "links")
    discard(spark, path)
    return edges


def parted(dealt: DataFrame, most: int) -> DataFrame:
    """``shard, i, j, fp, resident, seeks``: each shard's residents in parts ``i`` by its visitors in parts ``j``.

    Shards of up to ``most`` rows are one part, in which a row has both roles.
    """
    sizes = dealt.groupBy("shard").agg(F.sum(F.col("resident").cast("long")).alias("held"), F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > most).select("shard", F.ceil(F.col("held") / most).cast("int").alias("is"), F.ceil(F.col("n") / most).cast("int").alias("js"))
    large = F.broadcast(large)  # a row for each shard at most
    one = F.lit(0)
    small = dealt.join(large, "shard", "left_anti").select("shard", one.alias("i"), one.alias("j"), "fp", "resident", F.lit(True).alias("seeks"))
    split = dealt.join(large, "shard").withColumn("is", F.greatest("is", F.lit(1)))
    own_i, own_j = F.pmod(F.xxhash64("fp"), F.col("is")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("js")).cast("int")
    seeks = split.select("shard", F.explode(F.sequence(one, F.col("is") - 1)).alias("i"), own_j.alias("j"), "fp", F.lit(False).alias("resident"), F.lit(True).alias("seeks"))
    held = split.where("resident").select("shard", own_i.alias("i"), F.explode(F.sequence(one, F.col("js") - 1)).alias("j"), "fp", "resident", F.lit(False).alias("seeks"))
    return small.unionByName(seeks).unionByName(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """``node, root`` for every node of an edge, by large-star and small-star steps.

    The steps need rounds in the order of the squared logarithm of the number of edges;
    more than that, and 60, are an error.

    Minima are aggregated before they are joined back, so that a star of any size is
    combined on the map side and its join can be split.

    Up to ``few`` distinct edges each step is one task without a shuffle: dealing few rows
    over all partitions, round after round, costs the driver more memory than they take.
    No step makes more edges than it gets, so the first count decides.
    """
    spark = edges.sparkSession
    now, path = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    last, n = None, now.count()
    together = (lambda rows: rows.coalesce(1).hint("merge")) if n <= few else (lambda rows: rows)
    for _ in range(max(60, n.bit_length() ** 2)):
        both = together(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = materialize(large, "large-star")
        large = together(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), F.col("u").alias("y"), "m")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("y").alias("u"), F.col("m").alias("v")))).alias("e"))
        small, small_path = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        discard(spark, path)
        discard(spark, large_path)
        now, path = small, small_path
        # A forest of stars is a fixed point: the sum of its edges changes no more.
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = said
    raise RuntimeError("the components didn't close")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 2) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint, component_id``.

    A component holds all rows that chains of links join, where a link is a difference of
    ``reach`` bits or fewer; its id is its smallest ``doc_id`` (null where all are null).
    Null texts count as empty. A text without words has fingerprint zero and is linked like
    any other; one with fewer than ``width`` words is one shingle. Rows that repeat come
    out as often as they came in; other columns are ignored.
    """
    prints, _ = materialize(fingerprints(docs, id_col, text_col, width).drop("row"), "fingerprints")
    named = _named(prints, reach)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(prints: DataFrame, reach: int) -> DataFrame:
    """``fp, root, component_id`` for each fingerprint of ``doc_id, fp``."""
    distinct, _ = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(link_edges(distinct, reach))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def later_rows(members: DataFrame) -> DataFrame:
    """Of ``root, doc_id, row`` all rows but the one that stays of each root: that with the smallest id, null last, then the first."""
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    first = first.select(F.col("first.row").alias("_stays"))
    return members.join(first, members["row"] == first["_stays"], "left_anti").select("row")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 2, similarity: tuple[int, int] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each component.

    It is the row with the smallest id, null ids last; of rows that repeat that id the first.
    Null texts count as empty; texts without words are one component. An empty table gives
    an empty result. With ``similarity``, a fraction, a link is a Jaccard similarity of the
    sets of ``width``-word shingles of at least that: :mod:`girder.llm.shingle_dedup` checks
    the texts that fingerprints join, and finds the links between fingerprints further apart.
    """
    if similarity is not None:
        from girder.llm import shingle_dedup

        return shingle_dedup.near_dedup(docs, id_col, text_col, width, similarity)
    table, row = numbered(docs)
    prints, _ = materialize(fingerprints(table, id_col, text_col, width, row), "fingerprints")
    return drop_rows(table, row, later_rows(prints.join(_named(prints, reach).select("fp", "root"), "fp")))
