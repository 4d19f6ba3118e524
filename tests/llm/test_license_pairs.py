from __future__ import annotations

import random

from girder.llm import license_scan

PROSE = "the quick brown fox jumps over a lazy dog and then it sleeps near some old river until morning comes".split()


def test_neighbouring_notices_are_both_found():
    s = license_scan.Scanner(license_scan.default_templates())
    one, two = "Released under the GNU Lesser General Public License v2.1", "Licensed under CC BY-NC-ND 3.0"
    text = f"Some words. {one}. {two}. More words."
    found = [(f[0], text[f[1] : f[2]], f[3]) for f in s.scan(text)]
    assert found == [("LGPL-2.1", one, 0), ("CC-BY-NC-ND-3.0", two, 0)]


def test_random_pairs():
    rng = random.Random(7)
    templates = license_scan.default_templates()
    s = license_scan.Scanner(templates)
    for _ in range(300):
        (a, x), (b, y) = rng.sample(templates, 2)
        text = f"{' '.join(rng.choices(PROSE, k=20))}. {x}. {y}. {' '.join(rng.choices(PROSE, k=20))}"
        exact = {f[0] for f in s.scan(text) if f[3] == 0}
        assert {a, b} <= exact, (x, y, s.scan(text))


def test_repeated_notice_is_found_each_time():
    s = license_scan.Scanner(license_scan.default_templates())
    assert [f[0] for f in s.scan("SPDX-License-Identifier: MIT\n" * 5)] == ["MIT"] * 5


def _fewest_edits(template, words):
    """Of the template against any part of the words, in plain Python."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(template, 1):
        made = [i]
        for j, y in enumerate(words, 1):
            made.append(min(row[j] + 1, made[-1] + 1, row[j - 1] + (x != y)))
        row = made
    return min(row)


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, how = rng.randrange(len(words)), rng.choice("sid")
        words[at : at + (how != "i")] = [rng.choice(PROSE)] if how != "d" else []
    return words


def test_every_copy_within_the_differences_is_found():
    rng = random.Random(11)
    s = license_scan.Scanner(license_scan.default_templates())
    s._load()
    able = [t for t in s.templates if t.most]
    for _ in range(600):
        t = rng.choice(able)
        body = _edited(rng, t.words, rng.randint(1, t.most + 1))
        text = " ".join([*rng.choices(PROSE, k=rng.randint(0, 60)), *body, *rng.choices(PROSE, k=rng.randint(0, 60))])
        least, found = _fewest_edits(t.words, text.split()), s.scan(text)
        # a copy may be as close to another template, which is then told in its place
        assert least > t.most or any(f[0] == t.licence or f[3] <= least for f in found), (t.licence, least, text)
        for licence, a, b, n, _, said in found:
            words = text[a:b].split()
            assert any(u.licence == licence and n == _fewest_edits(u.words, words) <= u.most for u in s.templates)
            assert sum(max(len([w for w in part.split() if w != "-"]) for part in change.split(" > ")) for change in said.split("; ") if said) == n


def test_differences_tell_place_and_wording():
    words = "x a b q d e y".split()
    assert license_scan.differences("a b c d e".split(), words, 1) == (1, 1, 6, [(["c"], ["q"])])
    assert license_scan.differences("a b c d e".split(), words, 0) is None
    assert license_scan.differences("z a b".split(), words, 1) == (1, 1, 3, [(["z"], [])])
    assert license_scan.differences("d e z".split(), words, 1) == (1, 4, 6, [(["z"], [])])
    assert license_scan.pieces("a b c d e".split(), 1) == ["a b", "c d e"]


def test_long_text_and_one_word_templates(spark):
    s = license_scan.Scanner([("ONE", "Unlicense"), ("TWO", "Public Domain")])
    text = "prose " * 200_000 + "PUBLIC-domain. " + "prose " * 200_000 + "unlicense"
    assert [(f[0], text[f[1] : f[2]]) for f in s.scan(text)] == [("TWO", "PUBLIC-domain"), ("ONE", "unlicense")]
