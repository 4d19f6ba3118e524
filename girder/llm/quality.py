"""Quality classification: histogram gradient-boosted trees over document statistics.

The statistics of a text are numbers that numpy finds from its bytes: shares of character
classes, lengths of words and lines, repetition of words and lines, and so on. Trees are
grown level by level on binned statistics by logistic loss and are flattened into arrays,
so that a batch of documents walks all trees with a few numpy steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import crc_bucket, text_or_empty

#: Most labelled rows that a model is fitted on; of more, those with the smallest hashes.
MAX_LABELLED = 20_000
THRESHOLD = 0.3

NAMES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "ascii_punct", "non_ascii",
    "hash_like", "bang", "pipe", "comma", "period", "colon", "quote", "slash", "other_control",
    "word_mean", "word_sd", "word_max", "short_words", "long_words",
    "line_mean", "line_sd", "empty_lines", "repeat_lines", "repeat_words", "top_word", "same_as_next", "pair_repeat",
    "upper_words", "punct_end", "marked_words", "byte_entropy", "compression",
)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13),
    "ascii_punct": [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], "non_ascii": range(128, 256),
    "hash_like": b"#$%&*@^~_=+<>", "bang": b"!?", "pipe": b"|", "comma": b",", "period": b".", "colon": b":;", "quote": b"\"'`", "slash": b"/\\",
    "other_control": [*range(0, 9), *range(14, 32), 127],
}
_WEIGHTS = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS.values()):
    _WEIGHTS[list(_g), _i] = 1
_MARK = np.zeros(256, bool)
_MARK[list(_GROUPS["hash_like"]) + [33, 124]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def _repeats(codes: np.ndarray) -> tuple[float, float]:
    """Share of values seen before, and share of the most frequent value."""
    if not len(codes):
        return 0.0, 0.0
    ordered = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.concatenate((first, [len(codes)])))
    return 1 - len(first) / len(codes), float(sizes.max() / len(codes))


def _word_codes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code for each word: its bytes, each mixed with its place, summed up.

    Words are gone through some at a time, and longer ones piece by piece: texts can be long.
    """
    out = np.zeros(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + _PIECE, "right")))
        first = starts[k:j] - starts[k]
        for at in range(int(starts[k]), int(ends[j - 1]), _PIECE * 2):
            part = b[at : min(at + _PIECE * 2, int(ends[j - 1]))]
            place = np.arange(len(part)) + (at - starts[k])
            if j > k + 1:  # several words, in one piece
                place -= np.repeat(first, np.diff(np.append(first, len(part))))
            mixed = (part.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _P
            mixed ^= mixed >> np.uint64(29)
            if j > k + 1:
                mixed[_BLANK[part]] = 0
                out[k:j] = np.add.reduceat(mixed, first)
            else:
                out[k : k + 1] += mixed.sum(dtype=np.uint64)
        k = j
    return out


def statistics(text: str) -> np.ndarray:
    """The statistics :data:`NAMES` of one whole text; zeros for an empty one."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return np.zeros(len(NAMES))
    b = np.frombuffer(raw, np.uint8)
    counts = np.bincount(b, minlength=256)
    p = counts[counts > 0] / n
    blank = _BLANK[b]
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = ends - starts
    if len(size):
        word = _word_codes(b, starts, ends)
        repeat, top = _repeats(word)
        pair = word[:-1] * _P + word[1:]
        pair_repeat = _repeats(pair)[0]
        last, head = b[ends - 1], b[starts]
        words = [
            size.mean(), size.std(), min(200, size.max()), (size <= 2).mean(), (size > 20).mean(),
        ]
        tail = [repeat, top, float((word[1:] == word[:-1]).mean()) if len(word) > 1 else 0.0, pair_repeat]
        caps = [((head >= 65) & (head <= 90) & (last < 97)).mean(), np.isin(last, (46, 63, 58, 59, 44)).mean(), (_MARK[last] | _MARK[head]).mean()]
    else:
        words, tail, caps = [0.0] * 5, [0.0] * 4, [0.0] * 3
    cuts = np.flatnonzero(b == 10)
    lines = np.diff(np.concatenate(([-1], cuts, [n]))) - 1
    pieces = raw.split(b"\n")
    filled = [x for x in pieces if x]
    line = [min(5000.0, lines.mean()), min(5000.0, lines.std()), 1 - len(filled) / len(pieces), 1 - len(set(filled)) / len(filled) if filled else 0.0]
    packed = len(zlib.compress(raw, 1)) / n
    return np.array(
        [np.log1p(n), np.log1p(len(size)), *(counts @ _WEIGHTS / n), *words, *line, *tail, *caps, float(-(p * np.log2(p)).sum()), packed]
    )


def statistics_of(texts: Iterator[str] | pd.Series) -> np.ndarray:
    rows = [statistics(t) for t in texts]
    return np.stack(rows) if rows else np.zeros((0, len(NAMES)))


@dataclass
class Trees:
    """A boosted ensemble as arrays; row ``t`` of each is tree ``t`` in heap order."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        for k in range(0, len(x), 4096):
            part = x[k : k + 4096]
            at = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[rows[: len(part)], self.feature[trees, at]] > self.cut[trees, at])
            total[k : k + 4096] += self.leaf[trees, at - (2**self.depth - 1)].sum(axis=1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Gradient-boosted trees by logistic loss on binned columns.

    With one class only, or no rows, every score is that class's smoothed share.
    """
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), base, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width)[None, :] * bins
    margin = np.full(n, base)
    feature, cut, leaf = [], [], []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = (flat + (node * width * bins)[:, None]).ravel()
            g = np.bincount(key, np.repeat(grad, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(key, np.repeat(hess, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            go = np.zeros(count, np.int64)
            for i in range(count):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + i], c[first + i], go[i] = j, cuts[j][b], b
                else:
                    go[i] = bins
            node = 2 * node + (binned[np.arange(n), f[first + node]] > go[node])
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        value = -rate * g / (h + ridge)
        margin += value[node]
        feature.append(f)
        cut.append(c)
        leaf.append(value)
    return Trees(np.array(feature), np.array(cut), np.array(leaf), base, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_remainder: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most ``most`` labelled rows outside the held-out fold.

    Rows whose id or label is null are left out, and of an id that is labelled more than
    once its largest label counts. Of more rows than ``most`` those with the smallest id
    hashes are taken, so that the choice is the same on every run. Their ids are the only
    thing that is broadcast.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_bucket(id_col, modulus) != held_remainder))
    ids = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    taken = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("text"))
    return rows.join(F.broadcast(taken), "_id").select("text", "label")


_SAMPLE_STATISTICS = "label int, x binary"


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, held_remainder: int = 0, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on the labelled rows outside the fold; only their statistics reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [statistics(t).astype(np.float32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "x": x})

    sample = labelled_sample(docs, labels, label_col, modulus, held_remainder, most, id_col, text_col)
    rows = sample.mapInPandas(run, _SAMPLE_STATISTICS).collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["label"]))  # whatever order tasks ended in
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, len(NAMES)).astype(np.float64)
    return fit_trees(x, np.array([float(r["label"]) for r in rows]))


def score_documents(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row.

    Null texts count as empty and are scored too; texts of any length are measured whole.
    Ids pass through as they are, null and repeated ones too; an empty table gives an empty
    result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # its size is fixed by rounds and depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = statistics_of(batch["text"]).astype(np.float32).astype(np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": shared.value.score(x)})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, score double")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Each row goes by its own text, whatever its id; null texts count as empty, rows that
    repeat stay or go together, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = statistics_of(texts).astype(np.float32).astype(np.float64)
        return pd.Series(shared.value.score(x))

    return docs.where(score(text_or_empty(text_col)) >= threshold)
