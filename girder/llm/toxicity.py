"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. Every
window of a document is compressed with each of them, and what the toxic one saves over the
ordinary one is the window's gain. A document's distance is the mean, over its windows, of
what the gains exceed a least gain by. Thresholds on that distance, calibrated on labelled
rows, turn it into a probability.

A label marks a whole document, but only some passages of it are toxic. Toxic text are the
passages of toxic documents made of byte sequences that are found in far more toxic than
ordinary documents. Both dictionaries begin with what is trained on ordinary text, so that
they compress it alike and the difference comes from toxic wording. For calibration each
half of the labelled rows is measured with toxic text from the other half.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import text_or_empty
from girder.llm.quality import labelled_sample
from girder.session import discard, materialize

#: Most labelled rows, and most bytes of them, that a model is fitted on; of more, those with the smallest hashes.
MAX_LABELLED, MAX_BYTES = 12_000, 64_000_000
THRESHOLD = 0.3
WINDOW = 48
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 2_048
GRAM, GRAM_BITS = 5, 22
#: A byte sequence marks a passage if its share of toxic documents is this many times that of ordinary ones.
RATIO = 8.0
#: Least gains, in bytes, among which the calibration chooses.
LEAST_GAINS = (0, 1, 2, 3)


def flat(text: str) -> bytes:
    """The compared form: ASCII letters lower-cased, words between single spaces."""
    return b" " + b" ".join(text.encode("utf-8", "replace").lower().split()) + b" "


def windows(body: bytes, size: int = WINDOW) -> list[bytes]:
    """Pieces of about ``size`` bytes, cut at spaces, that share the space between them."""
    out, at, last = [], 0, len(body) - 1
    while at < last:
        end = body.find(b" ", min(last, at + size))
        out.append(body[at : end + 1])
        at = end
    return out or [b" "]


class Scales:
    """The two dictionaries, ready to weigh windows."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self._pair = None

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_pair": None}

    def gains(self, body: bytes) -> np.ndarray:
        """For each window its compressed length by the ordinary less that by the toxic dictionary."""
        if self._pair is None:
            self._pair = tuple(map(_compressor, (self.ordinary, self.toxic)))
        ordinary, toxic = (c.compress for c in self._pair)
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(body)])

    def distances(self, text: str) -> list[float]:
        """The document's distance for each of the least gains."""
        g = self.gains(flat(text))
        return [float(np.maximum(g - least, 0).mean()) for least in LEAST_GAINS]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(compression_level=LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    given = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    given.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=given, compression_params=params)


def _grams(body: bytes) -> np.ndarray:
    n = len(body) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    b = np.frombuffer(body, np.uint8).astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = code * np.uint64(257) + b[k : k + n]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


class Frequencies:
    """In how many ordinary and in how many toxic documents each gram code is found."""

    def __init__(self, bodies: Iterable[bytes] = (), labels: Iterable[int] = ()) -> None:
        self.count = np.zeros((2, 1 << GRAM_BITS), np.int32)
        self.documents = np.zeros(2, np.int64)
        for body, label in zip(bodies, labels, strict=True):
            self.count[int(bool(label)), np.unique(_grams(body))] += 1
            self.documents[int(bool(label))] += 1

    def __add__(self, other: Frequencies) -> Frequencies:
        out = Frequencies()
        out.count, out.documents = self.count + other.count, self.documents + other.documents
        return out

    def marking(self) -> np.ndarray:
        """For each gram code: is it found in far more toxic than ordinary documents?"""
        ordinary, toxic = self.documents.tolist()
        share = (self.count[0] + 0.5) / (ordinary + 1)
        return (self.count[1] >= max(4, toxic // 200)) & (self.count[1] / (toxic + 1) >= RATIO * share)


def passages(body: bytes, marked: np.ndarray) -> list[bytes]:
    """The runs of a document that marked grams cover."""
    hit = marked[_grams(body)]
    on = np.zeros(len(body), bool)
    for k in range(GRAM):
        on[k : k + len(hit)] |= hit
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    return [body[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _train(samples: list[bytes], size: int, **how: int) -> bytes:
    """A trained dictionary; all distinct samples one after the other where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))


def train_scales(bodies: list[bytes], labels: np.ndarray) -> list[Scales]:
    """Dictionaries with toxic text from the rows with odd places, from those with even ones, and from all."""
    ordinary = _train([w for body, label in zip(bodies, labels, strict=True) if not label for w in windows(body, 2 * WINDOW)], ORDINARY_BYTES)
    halves = [Frequencies(bodies[k::2], labels[k::2]) for k in (1, 0)]
    out = []
    for counted, rows in ((halves[0], range(1, len(bodies), 2)), (halves[1], range(0, len(bodies), 2)), (halves[0] + halves[1], range(len(bodies)))):
        marked = counted.marking()
        found = [p for i in rows if labels[i] for p in passages(bodies[i], marked)]
        out.append(Scales(ordinary, ordinary + _train(found, TOXIC_BYTES, d=6, steps=8)))
    return out


class Thresholds:
    """Probability by distance: pooled steps of the labelled rows, joined by lines so that a larger distance never scores less."""

    def __init__(self, distance: np.ndarray, label: np.ndarray) -> None:
        pooled: list[list[float]] = []  # toxic rows, rows, sum of distances
        for x in np.unique(distance):
            rows = label[distance == x]
            pooled.append([float(rows.sum()), float(len(rows)), float(x) * len(rows)])
            while len(pooled) > 1 and pooled[-2][0] * pooled[-1][1] >= pooled[-1][0] * pooled[-2][1]:
                last = pooled.pop()
                pooled[-1] = [a + b for a, b in zip(pooled[-1], last, strict=True)]
        share = (label.sum() + 1) / (len(label) + 2)
        at = [s / n for _, n, s in pooled]
        p = [(t + share) / (n + 1) for t, n, _ in pooled]
        # beyond the last step the probability goes on towards 1
        self.x = np.array([*at, 2 * at[-1] + 1.0]) if at else np.array([0.0, 1.0])
        self.p = np.maximum.accumulate(np.array([*p, (p[-1] + 1) / 2])) if at and 0 < label.sum() < len(label) else np.full(len(self.x), share)

    def score(self, distance: np.ndarray) -> np.ndarray:
        return np.interp(distance, self.x, self.p)


def separation(distance: np.ndarray, label: np.ndarray) -> float:
    """The share of pairs of a toxic and an ordinary row that the distance puts in order; ties count half."""
    _, at, n = np.unique(distance, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    toxic = int(label.sum())
    pairs = toxic * (len(label) - toxic)
    return float((rank[label > 0].sum() - toxic * (toxic + 1) / 2) / pairs) if pairs else 0.5


class Detector:
    """Dictionaries and calibrated thresholds."""

    def __init__(self, scales: Scales, distances: np.ndarray, labels: np.ndarray) -> None:
        self.scales = scales
        self.least = int(np.argmax([round(separation(d, labels), 4) for d in distances.T]))
        self.thresholds = Thresholds(distances[:, self.least], labels)

    def score(self, texts: Iterable[str]) -> np.ndarray:
        return self.thresholds.score(np.array([self.scales.distances(t)[self.least] for t in texts], float))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 4, held_remainder: int = 2, most: int = MAX_LABELLED, most_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """Train on at most ``most`` labelled rows of ``most_bytes`` together, outside the fold.

    See :func:`girder.llm.quality.labelled_sample`. The dictionaries are trained on the
    driver; the labelled rows are measured for calibration where they lie. With one class
    only, or no rows, every score is that class's smoothed share.
    """
    spark, row_hash = docs.sparkSession, F.xxhash64("text", "label")
    sample, path = materialize(labelled_sample(docs, labels, label_col, modulus, held_remainder, most, id_col, text_col), "labelled")
    sizes = sorted((r[0], r[1]) for r in sample.select(row_hash, F.octet_length("text")).collect())
    total = np.cumsum([n for _, n in sizes])
    within = [h for (h, _), t in zip(sizes, total.tolist(), strict=True) if t <= most_bytes]
    taken = sample.where(row_hash <= within[-1]) if within else sample.limit(0)
    rows = sorted((r["text"], int(r["label"] > 0)) for r in taken.collect())  # whatever order tasks ended in
    order = np.random.default_rng(0).permutation(len(rows))
    bodies, label = [flat(rows[i][0]) for i in order], np.array([rows[i][1] for i in order])
    *by_half, whole = train_scales(bodies, label)
    # rows at even places are measured with toxic text from odd ones; equal rows go by the first
    halves: dict[tuple[int, int], int] = {}
    for at, i in enumerate(order):
        halves.setdefault((hash_of(rows[i][0]), rows[i][1]), at % 2)
    shared = spark.sparkContext.broadcast((by_half, halves))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scales, half_of = shared.value
        for batch in batches:
            measured = [scales[half_of[hash_of(t), int(n > 0)]].distances(t) for t, n in zip(batch["text"], batch["label"], strict=True)]
            yield pd.DataFrame({"label": (batch["label"] > 0).astype("int32"), "distances": measured})

    measured = sorted((r["label"], tuple(r["distances"])) for r in taken.mapInPandas(run, "label int, distances array<double>").collect())
    discard(spark, path)
    return Detector(whole, np.array([d for _, d in measured]).reshape(-1, len(LEAST_GAINS)), np.array([n for n, _ in measured], float))


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def score_documents(docs: DataFrame, detector: Detector, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row.

    Null texts count as empty and are scored too; texts of any length are measured whole.
    Ids pass through as they are, null and repeated ones too; an empty table gives an empty
    result; other columns are ignored. What is broadcast has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": shared.value.score(batch["text"])})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, score double")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
