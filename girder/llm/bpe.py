"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens. It starts as one state
with an arc for every base symbol and takes one merge gadget after another: the gadget of
the merge ``(u, v) -> uv`` finds each state ``p`` with an arc ``u`` to a state ``q`` that has
an arc ``v``, gives ``p`` an arc ``uv`` to where ``v`` led, and leads ``u`` from ``p`` to a
copy of ``q`` without its arc ``v``. What the automaton then spells is exactly what applying
the merges in order produces, one token sequence for every string.

All arcs of one token lead to one state, so a gadget makes one copy at most, and a state
is known by the arcs that it lost: losing ``v`` by gadget ``k``, it also never gets an arc
for a token that a gadget from ``k`` on makes of ``v`` and something after it. Arcs are
numbered so that those which are lost together lie side by side: a token, then the tokens
made of it with something after it, the latest first. After the last gadget each state is
a list of runs of arc numbers that it lacks, equal states become one, and the runs of all
states lie in one sorted table, in which one search tells whether a state has an arc.

Words are encoded together, by table lookups alone: from each place of a word, in order,
a trie reads the characters on, and every token that it spells and that the place's state
has an arc for leads to a state at the place where the token ends. Each place is reached by
one path at most. Nothing is tried twice or taken back; the arcs on the path to the word's
end are its tokens. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import give_back, text_or_empty

CACHE_WORDS = 250_000
#: Words that are encoded together at most.
WORDS_AT_ONCE = 50_000


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level tokenizers use for each byte."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


# The split of lower-cased text, for text of Latin-1 characters alone: contractions, runs of
# letters, single digits, runs of other characters without white space (fixed values).
_LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_OTHER = rf"[^\t-\r\x20\x85\xa0{_LATIN}{_DIGITS}]"
_SHORT = "'(?:[stmd]|re|ve|ll)"
_LATIN_PIECES = re.compile(rf"[{_LATIN}]+|{_SHORT}|[{_DIGITS}]|(?!{_SHORT}){_OTHER}+")
_LATIN_ONLY = re.compile("[\x00-\xff]*")


# The rules that the pieces above state (fixed values).
_KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


class Splitter:
    """Pre-splits a text into the words that are encoded one by one.

    Text is normalised and split by the rules of the tokenizer file. Where those are the
    rules that :data:`_LATIN_PIECES` states, Latin-1 text, which is its own NFC, takes a
    quick path.
    """

    def __init__(self, spec: str) -> None:
        self.spec = spec
        parts = json.loads(spec)
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [p["type"] for p in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError("only files that split by one pattern, then map bytes, can be compiled")
        self.quick = parts["normalizer"] == _KNOWN_NORMALIZER and steps[0] == _KNOWN_SPLIT
        self._rules = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rules": None}

    def __call__(self, text: str) -> list[str]:
        if self.quick and _LATIN_ONLY.fullmatch(text):
            return _LATIN_PIECES.findall(text.lower())
        if self._rules is None:
            self._rules = _file_rules(self.spec)
        normalize, split = self._rules
        return [p for p, _ in split(normalize(text))]


def _file_rules(spec: str):
    """Normaliser and splitter as the file states them, without its byte mapping."""
    from tokenizers import Tokenizer, models

    parts = json.loads(spec)
    blank = json.loads(Tokenizer(models.BPE()).to_str())
    blank["normalizer"] = parts["normalizer"]
    blank["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]}
    made = Tokenizer.from_str(json.dumps(blank))
    normalizer = made.normalizer
    return (normalizer.normalize_str if normalizer else str), made.pre_tokenizer.pre_tokenize_str


class Gadgets:
    """The automaton while it is built: the arcs that the state after each token lost, and by which gadget."""

    def __init__(self, bases: list[int]) -> None:
        self.made = dict.fromkeys(bases, 0)
        self.left: dict[int, int] = {}
        self.kids: dict[int, list[int]] = {}
        self.lost: dict[int, dict[int, int]] = {}

    def has(self, u: int, v: int) -> bool:
        """Does the state after ``u`` have an arc ``v`` by now?"""
        lost = self.lost.get(u)
        if not lost:
            return True
        born = 1 << 60
        while v is not None:
            if lost.get(v, born + 1) <= born:
                return False
            born, v = self.made[v], self.left.get(v)
        return True

    def add(self, k: int, u: int, v: int, uv: int) -> bool:
        """Gadget ``k``, of the merge ``(u, v) -> uv``; False if no state has the arcs one after the other."""
        if u not in self.made or v not in self.made or not self.has(u, v):
            return False
        self.lost[uv] = dict(self.lost.get(v, ()))  # where v led before this gadget
        self.lost.setdefault(u, {})[v] = k
        self.made[uv], self.left[uv] = k, u
        self.kids.setdefault(u, []).append(uv)
        return True

    def numbers(self) -> tuple[dict[int, int], dict[int, int]]:
        """The number of each token's arc, and the number after those of all tokens that begin with it."""
        number: dict[int, int] = {}
        after: dict[int, int] = {}
        for base in sorted(t for t, k in self.made.items() if k == 0):
            stack = [(base, False)]
            while stack:
                t, done = stack.pop()
                if done:
                    after[t] = len(number)
                    continue
                number[t] = len(number)
                stack.append((t, True))
                stack += [(c, False) for c in self.kids.get(t, ())]  # the latest is taken first
        return number, after

    def runs(self, token: int, number: dict[int, int], after: dict[int, int]) -> tuple[int, ...]:
        """Where the runs of arcs that the state after ``token`` lacks start and end, in order."""
        found = []
        for v, k in self.lost.get(token, {}).items():
            kids = self.kids.get(v, ())  # in the order of their gadgets
            early = bisect_left(kids, k, key=self.made.__getitem__)
            found.append((number[v], number[kids[early - 1]] if early else after[v]))
        out: list[int] = []
        for a, b in sorted(found):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return tuple(out)


class Automaton:
    """The compiled tokenizer.

    ``vocab`` maps token to id, ``merges`` lists pairs in order, ``specials`` maps the
    literal strings that stand for single ids, ``split`` pre-splits a text. Tokens that end a
    word carry ``end``. All tables are numpy arrays.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int], split: Callable[[str], list[str]], end: str = "</w>") -> None:
        self.specials, self.split = specials, split
        self.labels = {i: t for t, i in vocab.items()} | {i: t for t, i in specials.items()}
        byte_of = {c: b for b, c in byte_symbols().items()}
        gadgets = Gadgets([vocab[t] for c in byte_of for t in (c, c + end) if t in vocab])
        for k, (left, right) in enumerate(merges, 1):
            if vocab[left + right] in gadgets.made:
                raise ValueError(f"two merges make {left + right!r}")
            gadgets.add(k, vocab[left], vocab[right], vocab[left + right])
        number, after = gadgets.numbers()
        size = max(self.labels, default=0) + 1
        #: Of each token: its arc's number, the state that it leads to, its length in bytes.
        self.number, self.target, self.length = (np.zeros(size, np.int32) for _ in range(3))
        states: dict[tuple[int, ...], int] = {(): 0}
        edges: list[np.ndarray] = []
        trie = _Trie()
        for t, n in sorted(number.items()):
            label = self.labels[t]
            final = label.endswith(end)
            spelt = [byte_of[c] for c in (label.removesuffix(end) if final else label)]
            trie.add(spelt, t, final)
            self.number[t], self.length[t] = n, len(spelt)
            if not final:
                lacks = gadgets.runs(t, number, after)
                if lacks not in states:
                    states[lacks] = len(states)
                    edges.append(np.array(lacks, np.int64) + (states[lacks] << 32))
                self.target[t] = states[lacks]
        self.n_states = len(states)
        #: Starts and ends of the runs of missing arcs: ``state << 32 | arc number``, ascending.
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.trie_key, self.trie_child, self.ends = trie.tables()
        self._words: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": {}}

    def has_arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """For each pair, does the state have an arc for the token?"""
        key = states.astype(np.int64) << 32 | self.number[tokens]
        return np.searchsorted(self.edges, key, "right") & 1 == 0

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each pre-split word, which is one run without white space and not empty."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        stops = np.cumsum(sizes)
        text = np.frombuffer(b"".join(raw), np.uint8)
        # one place before each character of each word, and one after its last
        arrived = np.full(len(text) + len(words), -1, np.int32)
        base = stops - sizes + np.arange(len(words))
        shift = np.arange(len(words))
        long_first = np.argsort(-sizes, kind="stable")
        ordered = -sizes[long_first]
        state = np.zeros(len(arrived), np.int32)
        for i in range(int(sizes.max())):
            live = long_first[: np.searchsorted(ordered, -i, "left")]
            if i:
                live = live[arrived[base[live] + i] >= 0]
            node = np.zeros(len(live), np.int32)
            j = i
            while len(live):
                key = node << 8 | text[base[live] - shift[live] + j]
                at = np.searchsorted(self.trie_key, key)
                at[at == len(self.trie_key)] = 0
                on = self.trie_key[at] == key
                live, node = live[on], self.trie_child[at[on]]
                j += 1
                last = sizes[live] == j
                token = self.ends[last.astype(np.int8), node]
                spelt = np.flatnonzero(token >= 0)
                if len(spelt):
                    who, token = live[spelt], token[spelt]
                    good = self.has_arcs(state[base[who] + i], token)
                    place = base[who[good]] + j
                    arrived[place], state[place] = token[good], self.target[token[good]]
                live, node = live[~last], node[~last]
        # the places on the path to each word's end
        marked = np.zeros(len(arrived), bool)
        place, first = base + sizes, base
        while len(place):
            token = arrived[place]
            if (token < 0).any():
                raise ValueError(f"the vocabulary can't spell {words[int(np.searchsorted(base, place[token < 0][0], 'right')) - 1]!r}")
            marked[place] = True
            place = place - self.length[token]
            on = place > first
            place, first = place[on], first[on]
        ids = arrived[marked].astype("<u4")
        cuts = np.concatenate(([0], np.cumsum(marked)))[np.concatenate((base, [len(arrived)]))]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers; words new to the cache are encoded together."""
        if len(self._words) >= CACHE_WORDS:
            self._words.clear()
        known, special = self._words, re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        pieces = []
        for text in texts:
            own: list[str] = []
            for k, part in enumerate(special.split(text) if special else [text]):
                own += [part] if k % 2 else self.split(part)
            pieces.append(own)
        fresh = [w for w in dict.fromkeys(w for own in pieces for w in own if w not in known) if w not in self.specials]
        fresh.sort(key=len)
        for k in range(0, len(fresh), WORDS_AT_ONCE):
            some = fresh[k : k + WORDS_AT_ONCE]
            known.update(zip(some, (ids.tobytes() for ids in self.encode_words(some)), strict=True))
        known.update((s, struct.pack("<I", i)) for s, i in self.specials.items())
        out = [b"".join(map(known.__getitem__, own)) for own in pieces]
        for w in reversed(fresh):
            if len(w) <= 64:
                break
            del known[w]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one whole text; see :meth:`encode_many`."""
        return self.encode_many([text])[0]

    def decode(self, packed: bytes) -> str:
        """The labels of the arcs, joined by a space as the tokenizer file's own decoder does."""
        return " ".join(map(self.labels.__getitem__, memoryview(packed).cast("I").tolist()))


class _Trie:
    """Tokens by their bytes; a node has the token that ends there within a word, and the one that ends a word there."""

    def __init__(self) -> None:
        self.child: dict[int, int] = {}
        self.ends: list[list[int]] = [[-1, -1]]

    def add(self, spelt: list[int], token: int, final: bool) -> None:
        node = 0
        for b in spelt:
            key = node << 8 | b
            node = self.child.get(key, -1)
            if node < 0:
                node = self.child[key] = len(self.ends)
                self.ends.append([-1, -1])
        self.ends[node][final] = token

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted ``node << 8 | byte``, the child of each, and by node the two tokens."""
        key = np.array(sorted(self.child), np.int32)
        child = np.array([self.child[k] for k in key.tolist()], np.int32)
        return (key, child, np.array(self.ends, np.int32).T.copy()) if len(key) else (np.zeros(1, np.int32) - 1, np.zeros(1, np.int32), np.array(self.ends, np.int32).T.copy())


def load_automaton(path: str) -> Automaton:
    """Compile the tokenizer file at ``path``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}, Splitter(json.dumps({k: spec[k] for k in ("normalizer", "pre_tokenizer")})), model["end_of_word_suffix"])


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: ``doc_id, ids, decoded``.

    ``ids`` has little-endian unsigned 32-bit integers; ``decoded`` is the text that the ids
    spell. Null texts count as empty and give no ids; texts of any length are encoded whole.
    Ids of documents pass through as they are, null and repeated ones too; an empty table
    gives an empty result; other columns are ignored. The automaton is broadcast: its size
    is that of the tokenizer file, whatever the documents.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(load_automaton(tokenizer_path))
    give_back()  # compiling takes ten times the memory of what it makes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton.value
        for batch in batches:
            # a slice at a time, for texts can be long
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                ids = a.encode_many(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "ids": ids, "decoded": list(map(a.decode, ids))})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, ids binary, decoded string")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", "decoded")
