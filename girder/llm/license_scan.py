"""License scans by conditional compression.

A template of which a copy may differ in ``k`` words is cut into ``k + 1`` pieces, so that
every copy holds one of them unchanged. Where a piece is found, the words around it, as far
as the template reaches, are a candidate. Templates of which it lacks more words than a copy
may differ in can't be there; with each other template of that length as zstandard raw
dictionary, and alone, it is compressed, and what a template saves, as a share of its own
compressed size, ranks it. In that order all of them are confirmed by the exact differences
of wording, the fewest edits of words, between the template and the place where it fits best,
and again before and after that place. Of confirmed ones that overlap the one with the most
equal words stays, then that with the fewest differences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import text_or_empty

#: Words that differ, as a share of the template's, at most.
DIFFERENCES = 0.1

# Names and texts of well-known licences (fixed values).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = _BSD2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GNU = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
_NAMED = {"MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License", "MPL-2.0": "Mozilla Public License, Version 2.0"}
_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")

_WORD = re.compile(r"[^\W_]+")


def default_templates() -> list[tuple[str, str]]:
    """``(licence, text)``: full texts, and the short notices made from the licences' names."""
    out = [("MIT", _MIT), ("ISC", _ISC), ("BSD-2-Clause", _BSD2), ("BSD-3-Clause", _BSD3), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE)]
    names = list(_NAMED.items())
    for short, (name, version) in _GNU.items():
        out.append((short, _GPL.format(name=name, version=version)))
        names += [(short, f"GNU {name}, version {version}"), (short, f"GNU {name} v{version}")]
    names += [(f"CC-{kind}-{v}", f"CC {kind} {v}") for kind in _CC for v in _CC_VERSIONS]
    for short, name in names:
        out += [(short, f"{start} {name}") for start in ("Licensed under", "Licensed under the", "Released under the", "This work is licensed under the", "This project is licensed under the")]
    return out + [(short, f"SPDX-License-Identifier: {short}") for short in dict.fromkeys(s for s, _ in out + names)]


@dataclass
class Template:
    licence: str
    words: list[str]
    size: int
    counts: dict[str, int]
    most: int
    packer: zstandard.ZstdCompressor


def _packer(content: bytes | None = None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(compression_level=3, write_content_size=0, write_checksum=0, write_dict_id=0)
    if not content:
        return zstandard.ZstdCompressor(compression_params=params)
    given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    given.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=given, compression_params=params)


def _body(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "replace")


def pieces(words: list[str], most: int) -> list[str]:
    """A template's words in ``most + 1`` parts, of which as many differences leave one as it is."""
    cut = [len(words) * k // (most + 1) for k in range(most + 2)]
    return [" ".join(words[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _edit_rows(t: np.ndarray, w: np.ndarray) -> Iterator[np.ndarray]:
    """For each number of words of ``t`` the fewest edits that make them of what ends at each place of ``w``."""
    step = np.arange(len(w) + 1, dtype=np.int32)
    row = np.zeros_like(step)
    yield row
    for i, x in enumerate(t, 1):
        made = np.empty_like(step)
        made[0] = i
        np.minimum(row[:-1] + (w != x), row[1:] + 1, out=made[1:])
        row = np.minimum.accumulate(made - step) + step
        yield row


def differences(template: list[str], words: list[str], most: int) -> tuple[int, int, int, list[tuple[list[str], list[str]]]] | None:
    """The fewest edits of words that make the template of some part of ``words``: how many, where it is, what they change.

    None if there are more than ``most``. Of several such parts it is the first that ends; it
    begins and ends with words that are equal. Memory grows with the square of the template's words.
    """
    ids: dict[str, int] = {}
    t, w = (np.array([ids.setdefault(x, len(ids)) for x in part], np.int32) for part in (template, words))
    *_, last = _edit_rows(t, w)
    n, end = int(last.min()), int(last.argmin())
    if n > most:
        return None
    skipped = max(0, end - len(t) - n)
    words, w = words[skipped:end], w[skipped:end]
    table = np.stack(list(_edit_rows(t, w)))
    i, j = len(t), len(w)
    start = j
    changes: list[tuple[list[str], list[str]]] = []
    joined = False  # is the change before this one beside it?
    while i:
        x, y = [], []
        if j and table[i, j] == table[i - 1, j - 1] + (t[i - 1] != w[j - 1]):
            i, j = i - 1, j - 1
            if t[i] == w[j]:
                joined, start = False, j
                continue
            x, y = [template[i]], [words[j]]
        elif table[i, j] == table[i - 1, j] + 1:
            i -= 1
            x = [template[i]]
        else:
            j -= 1
            y = [words[j]]
        if joined:
            x, y = x + changes[-1][0], y + changes[-1][1]
            changes.pop()
        changes.append((x, y))
        joined = True
    if changes and joined:
        # what comes before the first equal word is no part of the place
        changes[-1] = (changes[-1][0], [])
    return n, skipped + start, end, changes[::-1]


class Scanner:
    """Templates ready to weigh candidates; each must hold a word."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.given = templates
        self.plain: zstandard.ZstdCompressor | None = None
        for licence, text in templates:
            if not _WORD.search(text):
                raise ValueError(f"the template of {licence} holds no word")

    def __getstate__(self) -> dict:
        return {"given": self.given, "plain": None}

    def _load(self) -> None:
        self.plain = _packer()
        empty = len(self.plain.compress(b""))
        self.templates, reach_of = [], {}
        for licence, text in self.given:
            words = _WORD.findall(text.lower())
            most = int(DIFFERENCES * len(words))
            self.templates.append(Template(licence, words, max(1, len(self.plain.compress(_body(words))) - empty), Counter(words), most, _packer(b" " * 8 + _body(words))))
            for piece in pieces(words, most):
                reach_of.setdefault(piece, set()).add(len(words))
        self.pieces = ahocorasick.Automaton()
        for piece, reaches in reach_of.items():
            self.pieces.add_word(f" {piece} ", (len(piece.split()), sorted(reaches)))
        self.pieces.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int, float, str]]:
        """Licence, start, end, differing words, share saved, and the differences in wording."""
        if self.plain is None:
            self._load()
        body = " ".join(_WORD.findall(text)).lower()
        hits = list(self.pieces.iter(f" {body} "))
        if not hits:
            return []
        words = body.split(" ")
        ends = list(accumulate(len(w) + 1 for w in words))  # of each word with the blank after it
        seeds: dict[int, list[int]] = {}
        for end, (length, reaches) in hits:
            for reach in reaches:
                seeds.setdefault(reach, []).append(bisect_left(ends, end) - length + 1)
        found = []
        for reach, places in sorted(seeds.items()):
            same = [t for t in self.templates if len(t.words) == reach]
            most, last = same[0].most, None
            for seed in sorted(places):
                # the window of the piece before reaches over all copies that hold this one
                if last is not None and seed - last <= reach // 4:
                    continue
                last = seed
                lo, hi = max(0, seed - reach - most), min(len(words), seed + reach + reach // 4 + most + 1)
                found += self._confirm(words, lo, hi, self._rank(words[lo:hi], same))
        spans = [m.span() for m in _WORD.finditer(text)] if found else []
        taken: list[tuple] = []
        for f in sorted(found, key=lambda f: (f[3] - f[5], f[3], f[1], f[0])):
            at = bisect_left(taken, f[1], key=lambda o: o[1])
            if (at == 0 or taken[at - 1][2] <= f[1]) and (at == len(taken) or f[2] <= taken[at][1]):
                taken.insert(at, f)
        return [(licence, spans[a][0], spans[b - 1][1], n, saved, said) for licence, a, b, n, saved, _, said in taken]

    def _rank(self, window: list[str], templates: list[Template]) -> list[tuple[float, Template]]:
        held = Counter(window)
        able = [t for t in templates if sum(max(0, n - held[w]) for w, n in t.counts.items()) <= t.most]
        if not able:
            return []
        body = _body(window)
        alone = len(self.plain.compress(body))
        return sorted((((alone - len(t.packer.compress(body))) / t.size, t) for t in able), key=lambda s: -s[0])

    def _confirm(self, words: list[str], lo: int, hi: int, ranked: list[tuple[float, Template]]) -> Iterator[tuple]:
        for saved, t in ranked:
            parts = [(lo, hi)]
            while parts:
                first, last = parts.pop()
                if last - first < len(t.words) - t.most:
                    continue
                for f in self._place(words, first, last, saved, t):
                    yield f
                    parts += [(first, f[1]), (f[2], last)]

    def _place(self, words: list[str], lo: int, hi: int, saved: float, t: Template) -> Iterator[tuple]:
        fit = differences(t.words, words[lo:hi], t.most)
        if fit:
            n, a, b, changes = fit
            said = "; ".join(f"{' '.join(x) or '-'} > {' '.join(y) or '-'}" for x, y in changes)
            yield t.licence, lo + a, lo + b, n, round(saved, 6), len(t.words), said


_FOUND = "doc_id string, license string, start long, end long, differences int, saved double, wording string"


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence text found: ``doc_id, license, start, end, differences, saved, wording``.

    ``start`` and ``end`` are code points of the whole text; ``wording`` lists how its words
    differ from the template's, and ``differences`` counts them. Every copy within the
    differences is found, unless an overlapping one of more equal words or fewer differences
    is told in its place. Null and empty texts hold none, texts of any length are scanned
    whole, and an empty table gives an empty result. Rows that repeat are each reported, null
    ids pass through, other columns are ignored. Of templates with one text the first by name
    is reported.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(default_templates() if templates is None else templates))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *f) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for f in shared.value.scan(t)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")]).astype({"doc_id": object, "license": object, "wording": object, "start": "int64", "end": "int64", "differences": "int32", "saved": float})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, _FOUND).withColumn("doc_id", F.col("doc_id").cast("long"))
