"""A hashed maximum-entropy language model with class-factored softmax.

``log10 p(w | h) = log10 p(group(w) | h) + log10 p(class(w) | group(w), h) + log10 p(w | class(w))``.
The group of the next token's class, and the class within its group, are softmaxes over
hashed n-gram and skip features of the tokens before it. Feature and softmax are hashed
together into one table of weights. Within a class a token has its word bias alone, whose
maximum-entropy solution is closed: the counts of the training tokens, with one added to
each and one more for all unknown tokens of the class. Frequent tokens of a group are
classes of their own, the others are classed by how they end; groups and classes are
clusters by what comes before a token.

Training goes through every training text once. A hash of the row says which of the
updates its gradient belongs to. An update sums the gradient, observed less expected
counts, over all partitions and adds it to the weights as ``log(1 + g / (expected + s))``
times a rate: the gradient scaled by the curvature, as in iterative scaling. Expectations
are summed as whole multiples of :data:`UNIT`, so that neither the number nor the order of
partitions changes a sum.

Token counts cover all training texts; the most frequent tokens are broadcast up to
:data:`HEAD`, and rarer ones reach their texts by a join, in which none can be hot because
each is rarer than all of the head. The table of weights grows with the number of training
tokens up to ``2 ** MOST_BITS`` rows of eight: it is broadcast, and that is its bound, which
callers whose executors have more memory can raise.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import crc_bucket, text_or_empty
from girder.session import discard, materialize

GROUPS, PER_GROUP = 8, 8
CLASSES = GROUPS * PER_GROUP
#: Tokens that may be classes of their own, and whose place before a token tells what class it has.
SINGLES = 32
FEATURES = 3
LEAST_BITS, MOST_BITS = 16, 20
#: Tokens whose counts are broadcast.
HEAD = 200_000
#: Sixteenths of the training texts, and the rate, of each update.
UPDATES = ((4, 0.6), (4, 0.5), (8, 0.5))
SMOOTHING = 2.0
#: Probabilities are summed as multiples of this.
UNIT = 1 / 4096
#: Training tokens that one task of an update takes at most, where there are more tasks than cores.
TASK_TOKENS = 32_000_000
BATCH = 1 << 17
_SLICE = 256
_KNOWN_WORDS = 300_000
_PENDING = 300_000
_ENDINGS = 1 << 16
_BLOCK = 4096
END = b""
_START = -(1 << 40)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xC2B2AE3D27D4EB4F)
_GROUP = np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, then the end of the text, which is the empty word."""
    out = text.encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def ending(token: bytes) -> int:
    """The last two bytes of a token as a number."""
    return int.from_bytes(token[-2:], "big")


class Codes(dict):
    """Token to a 32-bit code; holds a bounded number of tokens.

    A token of the head has its place, which counts from 1; another has a negative code of
    its ending and 15 bits of its hash.
    """

    def __init__(self, head: dict[bytes, int]) -> None:
        super().__init__()
        self.head = head

    def __missing__(self, token: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        code = self.head.get(token) or -1 - (ending(token) << 15 | zlib.crc32(token) & 0x7FFF)
        self[token] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), _SLICE):
            yield batch.iloc[k : k + _SLICE]


def _before(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[starts] = _START
    return out


def features(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token a 64-bit key of each feature; ``starts`` are where texts begin.

    They are the token before, the two before together, and the one before the last alone.
    """
    before = _before(codes.astype(np.int64), starts)
    one, two = before.view(np.uint64), _before(before, starts).view(np.uint64)
    a = one * _MIX
    return np.stack((a, ((a ^ (a >> np.uint64(31))) + two) * _MIX + np.uint64(1), (two + np.uint64(7919)) * _MIX * _MIX + np.uint64(2)))


class Classes:
    """The class of every token: by its place for the most frequent, else by its ending."""

    def __init__(self, by_item: np.ndarray, endings_of_head: np.ndarray) -> None:
        self.by_item = by_item  # endings, then singles from place 1 on
        place = np.arange(len(endings_of_head))
        self.by_place = np.where(place <= SINGLES, by_item[_ENDINGS + np.minimum(place, SINGLES)], by_item[endings_of_head]).astype(np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.by_place[np.maximum(codes, 0)]
        rare = np.flatnonzero(codes <= 0)
        out[rare] = self.by_item[(-1 - codes[rare]) >> 15]
        return out.astype(np.int64)


def _cluster(x: np.ndarray, weight: np.ndarray, k: int, steps: int = 25) -> np.ndarray:
    """Weighted k-means; the first centres are far from one another, heavy ones first."""
    centres = x[[int(np.argmax(((x - np.average(x, axis=0, weights=weight)) ** 2).sum(axis=1) * weight))]]
    while len(centres) < k:
        far = ((x[:, None, :] - centres[None, -1:, :]) ** 2).sum(axis=2)[:, 0]
        near = far if len(centres) == 1 else np.minimum(near, far)
        if near.max() <= 1e-12:
            break
        centres = np.concatenate((centres, x[[int(np.argmax(near * weight))]]))
    at = np.zeros(len(x), np.int64)
    for _ in range(steps):
        at = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for j in range(len(centres)):
            mine = at == j
            if mine.any():
                centres[j] = np.average(x[mine], axis=0, weights=weight[mine])
    return at


def cluster_classes(profile: np.ndarray) -> np.ndarray:
    """Groups and classes from ``profile``: for each ending and single, how often each single came before it.

    The heaviest half of a group's classes are one item each, the others are clusters.
    Items that were never met have the last class.
    """
    by_item = np.full(len(profile), CLASSES - 1)
    weight = profile.sum(axis=1).astype(float)
    items = np.flatnonzero(weight)
    if not len(items):
        return by_item
    items = items[np.argsort(-weight[items], kind="stable")]
    prior = (profile.sum(axis=0) + 1.0) / (weight.sum() + profile.shape[1])
    x, weight = np.sqrt((profile[items] + 50 * prior) / (weight[items][:, None] + 50)), weight[items]
    group, alone = _cluster(x, weight, GROUPS), PER_GROUP // 2
    for g in range(GROUPS):
        mine = np.flatnonzero(group == g)
        by_item[items[mine[:alone]]] = g * PER_GROUP + np.arange(len(mine[:alone]))
        rest = mine[alone:]
        if len(rest):
            by_item[items[rest]] = g * PER_GROUP + alone + _cluster(x[rest], weight[rest], PER_GROUP - alone)
    return by_item


class Weights:
    """The table: rows of hashed feature and softmax, then the biases of groups and of each group's classes."""

    def __init__(self, bits: int, class_counts: np.ndarray) -> None:
        self.bits = bits
        self.w = np.zeros(((1 << bits) + GROUPS + 1, PER_GROUP), np.float32)
        held = class_counts.reshape(GROUPS, PER_GROUP) + 1.0
        self.w[1 << bits] = np.log(held.sum(axis=1) / held.sum())
        self.w[(1 << bits) + 1 :] = np.log(held / held.sum(axis=1, keepdims=True))

    def rows(self, keys: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The rows that each token's group softmax takes, then those of its class softmax; biases last."""

        def hashed(x: np.ndarray) -> np.ndarray:
            return (((x ^ (x >> np.uint64(32))) * _NODE) >> np.uint64(64 - self.bits)).astype(np.int64)

        n = keys.shape[1]
        out = np.empty((FEATURES + 1, 2 * n), np.int64)
        out[:FEATURES, :n] = hashed(keys)
        out[:FEATURES, n:] = hashed(keys + (group.astype(np.uint64) + np.uint64(1)) * _GROUP)
        out[FEATURES, :n] = 1 << self.bits
        out[FEATURES, n:] = (1 << self.bits) + 1 + group
        return out

    def log_softmax(self, rows: np.ndarray) -> np.ndarray:
        """Log-probabilities with the outcomes first: ``(PER_GROUP, 2 n)``."""
        logits = self.w.take(rows[0], axis=0)
        for r in rows[1:]:
            logits += self.w.take(r, axis=0)
        logits = np.ascontiguousarray(logits.T)
        logits -= logits.max(axis=0)
        logits -= np.log(np.exp(logits).sum(axis=0))
        return logits

    def log_probs(self, keys: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's class probability."""
        out = np.empty(len(kind))
        for k in range(0, len(kind), BATCH):
            own = kind[k : k + BATCH]
            group, n = own // PER_GROUP, np.arange(len(own))
            logs = self.log_softmax(self.rows(keys[:, k : k + BATCH], group))
            out[k : k + BATCH] = logs[group, n].astype(np.float64) + logs[own % PER_GROUP, n + len(own)]
        return out


class Gradient:
    """Observed and expected counts of each row of weights but the biases, the latter in multiples of UNIT."""

    def __init__(self, weights: Weights) -> None:
        self.weights, self.size = weights, 1 << weights.bits
        self.observed = np.zeros((PER_GROUP, self.size), np.int32)  # a task takes fewer tokens than that counts to
        self.expected = np.zeros((PER_GROUP, self.size))

    def add(self, keys: np.ndarray, kind: np.ndarray) -> None:
        group = kind // PER_GROUP
        rows = self.weights.rows(keys, group)
        p = np.rint(np.exp(self.weights.log_softmax(rows)) * (1 / UNIT))
        flat = rows[:FEATURES].ravel()
        for o in range(PER_GROUP):
            self.expected[o] += np.bincount(flat, np.tile(p[o], FEATURES), self.size)
        outcome = np.concatenate((group, kind % PER_GROUP))
        np.add.at(self.observed.reshape(-1), flat + np.tile(outcome * self.size, FEATURES), np.int32(1))

    def frames(self) -> Iterator[pd.DataFrame]:
        touched = np.flatnonzero(self.observed.any(axis=0))
        for block in np.unique(touched // _BLOCK):
            rows = touched[np.searchsorted(touched, block * _BLOCK) : np.searchsorted(touched, (block + 1) * _BLOCK)]
            sums = np.stack((self.observed[:, rows].astype(np.int64), self.expected[:, rows].astype(np.int64)))
            yield pd.DataFrame({"block": [np.int32(block)], "rows": [_packed((rows - block * _BLOCK).astype(np.int16))], "sums": [_packed(sums)]})


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first, which compress best."""
    planes = np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_SUMS = "block int, rows binary, sums binary"


def _add_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of each block's frames; a task holds those blocks that were dealt to it."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, rows, sums in batch.itertuples(index=False):
            total = held.setdefault(block, np.zeros((2, PER_GROUP, _BLOCK), np.int64))
            total[:, :, _unpacked(rows, np.int16)] += _unpacked(sums, np.int64).reshape(2, PER_GROUP, -1)
    for block, total in held.items():
        at = np.flatnonzero(total[0].any(axis=0))
        yield pd.DataFrame({"block": [np.int32(block)], "rows": [_packed(at.astype(np.int16))], "sums": [_packed(total[:, :, at])]})


def count_tokens(texts: DataFrame) -> DataFrame:
    """``token, ending, n`` over a column ``text``; each partition adds up before it sends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            words = list(held)
            return pd.DataFrame({"token": [w.decode("utf-8") for w in words], "ending": np.fromiter(map(ending, words), np.int32, len(words)), "n": np.fromiter(held.values(), np.int64, len(words))})

        for part in _slices(batches):
            for text in part["text"]:
                held.update(tokens(text))
            if len(held) > _PENDING:
                yield out()
                held.clear()
        if held:
            yield out()

    counted = texts.mapInPandas(run, "token string, ending int, n long")
    return counted.groupBy("token").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def frequent_tokens(vocabulary: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent tokens, by falling count: all above the least level that leaves at most ``most``.

    Levels are the counts up to 4096, then eighths of a power of two. Counting tokens by level
    takes no sort and sends a few thousand numbers, however many tokens there are.
    """
    level = F.when(F.col("n") <= 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 8)).cast("long")
    left, least = most, None
    for r in sorted(vocabulary.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        least = r["level"]
    if least is None:
        return []
    got = vocabulary.where(level >= least).select("token", "n").toArrow()
    pairs = zip((t.encode("utf-8") for t in got["token"].to_pylist()), got["n"].to_pylist(), strict=True)
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


_ENCODED = "doc_id string, held_out boolean, update int, n_tokens long, codes binary, n_head long, head_log double, rare array<string>"


def encode(rows: DataFrame, head: list[tuple[bytes, int]]) -> DataFrame:
    """Token codes of each text, what of its base score the head gives, and its rare tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(({w: i for i, (w, _) in enumerate(head, 1)}, np.log10(np.array([0] + [n for _, n in head]) + 1.0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, logs = shared.value
        known = Codes(places)
        for part in _slices(batches):
            if not len(part):
                continue
            docs = [tokens(t) for t in part["text"]]
            sizes = np.array([len(d) for d in docs])
            words = [x for d in docs for x in d]
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            codes = known.of(words)
            place = np.maximum(codes, 0)
            rare = np.flatnonzero(place == 0)
            spelt = [words[i].decode("utf-8") for i in rare.tolist()]
            at = np.searchsorted(rare, cuts).tolist()
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].array,
                    "held_out": part["held_out"].array,
                    "update": part["update"].array,
                    "n_tokens": sizes,
                    "codes": [codes[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
                    "n_head": np.add.reduceat((place > 0).astype(np.int64), cuts[:-1]),
                    "head_log": np.add.reduceat(logs[place], cuts[:-1]),
                    "rare": [spelt[a:b] for a, b in zip(at[:-1], at[1:], strict=True)],
                }
            )

    return rows.mapInPandas(run, _ENCODED)


def _codes_of(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sizes = part["n_tokens"].to_numpy()
    return np.frombuffer(b"".join(part["codes"]), np.int32), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and starts of texts, enough of them at a time to fill a batch."""
    for part in _slices(batches):
        if len(part):
            yield _codes_of(part)


def profiles(encoded: DataFrame, endings_of_head: np.ndarray) -> np.ndarray:
    """For each ending and each single, how often each single, or another token, came before it.

    At most ``(65,536 + 33) * 33`` counts, whatever the number of texts.
    """
    wide = SINGLES + 1
    shared = encoded.sparkSession.sparkContext.broadcast(endings_of_head)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((_ENDINGS + wide) * wide, np.int64)
        for codes, starts in _gathered(batches):
            item = np.where(codes > 0, shared.value[np.maximum(codes, 0)], (-1 - codes) >> 15)
            item = np.where((codes > 0) & (codes <= SINGLES), _ENDINGS + codes, item).astype(np.int64)
            before = _before(codes.astype(np.int64), starts)
            key, n = np.unique(item * wide + np.where((before > 0) & (before <= SINGLES), before, 0), return_counts=True)
            total[key] += n
        at = np.flatnonzero(total)
        for k in range(0, len(at), 65_536):
            yield pd.DataFrame({"key": at[k : k + 65_536].astype(np.int32), "n": total[at[k : k + 65_536]]})

    counted = encoded.select("codes", "n_tokens").mapInPandas(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((_ENDINGS + wide) * wide, np.int64)
    out[counted["key"].to_numpy()] = counted["n"].to_numpy()
    return out.reshape(-1, wide)


def update_weights(encoded: DataFrame, weights: Weights, classes: Classes, rate: float, tasks: int) -> Weights:
    """One gradient update, from the texts of ``encoded``."""
    shared = encoded.sparkSession.sparkContext.broadcast((weights, classes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, kinds = shared.value
        gradient, keys, kind, n = Gradient(w), [], [], 0
        for codes, starts in _gathered(batches):
            keys.append(features(codes, starts))
            kind.append(kinds.of(codes))
            n += len(codes)
            if n >= BATCH:
                _flush(gradient, keys, kind)
                keys, kind, n = [], [], 0
        if n:
            _flush(gradient, keys, kind)
        yield from gradient.frames()

    made = encoded.select("codes", "n_tokens").coalesce(tasks).mapInPandas(run, _SUMS)
    got = made.repartition("block").mapInPandas(_add_frames, _SUMS).toArrow()  # a block for each 4096 rows of weights
    out = Weights.__new__(Weights)
    out.bits, out.w = weights.bits, weights.w.copy()
    for block, rows, sums in zip(*(got[c].to_pylist() for c in ("block", "rows", "sums")), strict=True):
        observed, expected = _unpacked(sums, np.int64).reshape(2, PER_GROUP, -1).astype(np.float64)
        out.w[block * _BLOCK + _unpacked(rows, np.int16).astype(np.int64)] += (rate * np.log((observed + SMOOTHING) / (expected * UNIT + SMOOTHING))).T.astype(np.float32)
    return out


def _flush(gradient: Gradient, keys: list[np.ndarray], kind: list[np.ndarray]) -> None:
    all_keys, all_kinds = np.concatenate(keys, axis=1), np.concatenate(kind)
    for k in range(0, len(all_kinds), BATCH):
        gradient.add(all_keys[:, k : k + BATCH], all_kinds[k : k + BATCH])


class Model:
    """Weights, classes and class sizes: all that scoring broadcasts, of bounded size."""

    def __init__(self, weights: Weights, classes: Classes, class_log: np.ndarray) -> None:
        self.weights, self.classes, self.class_log = weights, classes, class_log

    def log10_of(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each token log10 of its class probability less that of its class's size."""
        kind = self.classes.of(codes)
        return self.weights.log_probs(features(codes, starts), kind) / np.log(10) - self.class_log[kind]


def fit(vocabulary: DataFrame, encoded: DataFrame, head: list[tuple[bytes, int]], n_tokens: int, most_bits: int = MOST_BITS) -> Model:
    """Train on the rows of ``encoded`` that are not held out; ``n_tokens`` is how many tokens they have.

    A row of weights takes 32 bytes in each executor and 96 in each training task.
    """
    endings_of_head = np.array([0] + [ending(w) for w, _ in head], np.int64)
    train = encoded.where("not held_out")
    by_item = cluster_classes(profiles(train, endings_of_head))
    classes = Classes(by_item, endings_of_head)
    # the sizes of classes: by ending (65,536 at most), the singles taken from theirs
    sums, kinds = np.zeros(CLASSES), np.zeros(CLASSES, np.int64)
    for r in vocabulary.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sums[by_item[r["ending"]]] += r["n"]
        kinds[by_item[r["ending"]]] += r["v"]
    for place, (word, n) in enumerate(head[:SINGLES], 1):
        for kind, sign in ((by_item[ending(word)], -1), (by_item[_ENDINGS + place], 1)):
            sums[kind] += sign * n
            kinds[kind] += sign
    bits = min(most_bits, max(LEAST_BITS, n_tokens.bit_length() - 6))
    weights = Weights(bits, sums)
    tasks = max(2 * encoded.sparkSession.sparkContext.defaultParallelism, -(-n_tokens // TASK_TOKENS))
    first = 0
    for share, rate in UPDATES:
        mine = F.col("update").between(first, first + share - 1)
        weights = update_weights(train.where(mine), weights, classes, rate, tasks)
        first += share
    return Model(weights, classes, np.log10(sums + kinds + 1))


_MEASURED = "doc_id string, held_out boolean, n_tokens long, n_head long, head_log double, model_log double, rare array<string>"


def _update_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(sum(share for share, _ in UPDATES))).cast("int")


def score_documents(docs: DataFrame, modulus: int = 7, held_remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Learn from the texts outside the fold and score all texts.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for
    each row. ``base_score`` is the add-one unigram model, ``score`` this one, both as
    log10 of the whole text's probability; neither depends on how the rows are partitioned.
    Null texts count as empty and have the end token alone. Texts of any length are scored
    whole. Rows without an id are learned from and never held out; rows that repeat come
    out as often as they came in; other columns are ignored. Without any training text
    every token is unknown and the base score is 0. An empty table gives an empty result.
    The table of weights grows with the training tokens up to ``2 ** most_bits`` rows, which
    is to be as large as the executors' memory allows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("held_out", crc_bucket("doc_id", modulus) == held_remainder)
    vocabulary, _ = materialize(count_tokens(rows.where("not held_out").select("text")), "vocabulary")
    size = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    v, n = int(size[0]), int(size[1])
    head = frequent_tokens(vocabulary, HEAD)
    given = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", _update_of(F.col("doc_id"), F.col("text")).alias("update"), "text")
    encoded, encoded_path = materialize(encode(given, head), "token-codes", codec="zstd")
    shared = spark.sparkContext.broadcast(fit(vocabulary, encoded, head, n, most_bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            if len(part):
                codes, starts = _codes_of(part)
                own = part[["doc_id", "held_out", "n_tokens", "n_head", "head_log", "rare"]]
                yield own.assign(model_log=np.add.reduceat(shared.value.log10_of(codes, starts), starts))

    measured = encoded.select("doc_id", "held_out", "n_tokens", "codes", "n_head", "head_log", "rare").mapInPandas(run, _MEASURED)
    measured, _ = materialize(measured.withColumn("row", F.monotonically_increasing_id()), "measured")
    discard(spark, encoded_path)
    rare = measured.select("row", F.explode("rare").alias("token"))
    logs = rare.join(vocabulary.select("token", "n"), "token").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count(F.lit(1)).alias("n_rare"))
    both = measured.drop("rare").join(logs, "row", "left")
    count_log = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (count_log - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (count_log + F.col("model_log")).alias("score"),
    )
