from __future__ import annotations

import hashlib
import json
import random
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from girder.llm import bpe, queries

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def automaton():
    return bpe.load_automaton(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(a, t, text):
    want = t.encode(text, add_special_tokens=False).ids
    got = a.encode(text)
    assert list(memoryview(got).cast("I")) == want
    assert a.decode(got) == t.decode(want, skip_special_tokens=False)


def test_documents(automaton, library, documents):
    for _, text in documents:
        same(automaton, library, text or "")


def test_every_block_of_code_points(automaton, library):
    for lo in range(0, 0x30000, 512):
        same(automaton, library, "".join(chr(c) for c in range(lo, lo + 512) if not 0xD800 <= c <= 0xDFFF))


def test_random_texts(automaton, library):
    rng = random.Random(5)
    alphabet = "abcdefgh  ''sStTrRvVlLdDmMéÉß½²ΣςİK\n\t<|startoftext|>.,0129"
    for _ in range(400):
        tail = rng.choice(["", "<|endoftext|>a", "it's he'll 'S", "<|startoftext|>"])
        same(automaton, library, "".join(rng.choice(alphabet) for _ in range(60)) + tail)


@pytest.mark.parametrize("text", ["", " ", "aaaa" * 50, "x" * 3000, "\x1c\x85 ", "école"])
def test_odd_texts(automaton, library, text):
    same(automaton, library, text)


def merge_in_order(word, merges):
    """The definition: the first merge that applies, everywhere, until none does."""
    parts = [*word[:-1], word[-1] + "</w>"]
    while pairs := [merges[p] for p in zip(parts, parts[1:], strict=False) if p in merges]:
        at = min(pairs)
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and merges.get((parts[i], parts[i + 1])) == at:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_automata_of_random_merges():
    rng = random.Random(2)
    for _ in range(150):
        known = ["a", "b", "a</w>", "b</w>"]
        merges = []
        for _ in range(rng.randint(0, 12)):
            left, right = rng.choice([k for k in known if not k.endswith("</w>")]), rng.choice(known)
            if left + right not in known:
                merges.append((left, right))
                known.append(left + right)
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*bpe.byte_symbols().values(), *(c + "</w>" for c in bpe.byte_symbols().values()), *known]))}
        a = bpe.Automaton(vocab, merges, {}, str.split)
        order = {m: i for i, m in enumerate(merges)}
        for _ in range(40):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
            (ids,) = a.encode_words([word])
            assert [a.labels[i] for i in ids.tolist()] == merge_in_order(word, order), (merges, word)


def test_arcs_of_states_are_the_pairs_that_can_follow(automaton):
    """A state's arcs, checked on pairs of tokens: they follow each other where encoding both as one word gives just them."""
    rng = random.Random(4)
    middle = [i for i, t in automaton.labels.items() if i < 49406 and not t.endswith("</w>")]
    final = [i for i, t in automaton.labels.items() if i < 49406 and t.endswith("</w>")]
    symbols = {c: b for b, c in bpe.byte_symbols().items()}
    tried = 0
    for _ in range(3000):
        u, v = rng.choice(middle), rng.choice(final)
        try:
            word = bytes(symbols[c] for c in automaton.labels[u] + automaton.labels[v].removesuffix("</w>")).decode()
        except UnicodeDecodeError:
            continue
        tried += 1
        (ids,) = automaton.encode_words([word])
        assert bool(automaton.has_arcs(automaton.target[[u]], np.array([v]))[0]) == (ids.tolist() == [u, v]), word
    assert tried > 1000 and automaton.n_states > 1000


def test_rules_come_from_the_file(tmp_path, library):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own, theirs = bpe.load_automaton(str(path)), Tokenizer.from_file(str(path))
    assert not own.split.quick
    same(own, theirs, "Ab cD, it's  ÀÉ 12")
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="split by one pattern"):
        bpe.load_automaton(str(path))


def test_two_merges_to_one_token_are_refused():
    vocab = {t: i for i, t in enumerate([*bpe.byte_symbols().values(), *(c + "</w>" for c in bpe.byte_symbols().values()), "ab", "bc", "abc"])}
    with pytest.raises(ValueError, match="two merges"):
        bpe.Automaton(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], {}, str.split)


def test_query(spark, library):
    rows = {r.doc_id: r for r in queries.op8_bpe(spark, SF).collect()}
    for doc_id, text in [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = rows[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows_and_empty_table(awkward, nothing, library):
    rows = bpe.encode_documents(awkward, PATH).collect()
    assert len(rows) == awkward.count() and sum(r.doc_id is None for r in rows) == 2
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id}
    for r in rows:
        if r.doc_id:
            assert list(memoryview(bytes(r.ids)).cast("I")) == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert bpe.encode_documents(nothing, PATH).count() == 0


def test_file_has_no_decoder():
    with open(PATH, encoding="utf-8") as f:
        assert json.load(f)["decoder"] is None


def test_a_driver_does_not_hold_what_compiling_took():
    """In a process of its own: what stays after the automaton was broadcast is a part of what compiling took."""
    code = f"""
import re
from types import SimpleNamespace as N
from girder.llm import bpe
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
class Docs:
    sparkSession = N(sparkContext=N(broadcast=lambda made: peak.append(held())))
    def select(self, *_): raise StopIteration
peak, bpe.F, bpe.text_or_empty, before = [], N(col=lambda _: N(cast=lambda _: N(cast=lambda _: N(alias=lambda _: 0)))), lambda _: N(alias=lambda _: 0), held()
try: bpe.encode_documents(Docs(), {PATH!r})
except StopIteration: print(peak[0] - before, held() - before)
"""
    took, kept = map(float, subprocess.run([sys.executable, "-c", code], cwd=Path(bpe.__file__).parents[2], capture_output=True, text=True, check=True).stdout.split())
    assert took > 60 and kept < 0.4 * took
