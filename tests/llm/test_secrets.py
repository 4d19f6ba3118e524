from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest

from girder.llm import queries, secrets

from .conftest import SF


def plain(text):
    """The contract's patterns, word for word."""
    assign = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({assign})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_finds_of_random_texts():
    rng = random.Random(1)
    parts = ["password", "token=", 'api_key: "', "'", "=", ":", " ", "secret", "AKIA", "AB12CD34EF56", "abcdef0123", "ff", "é", "K", ".x-", "TOKEN", "ſecret=", "\n", "passwd"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        got = [(k, a, b) for k, a, b, how, _ in secrets.scan(text) if not how]
        assert got == plain(text), text


SECRET = 'x é password="hunter2hunter2" y'
WRAPS = {
    "url": quote,
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib": lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
    "bz2": lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    "xz": lambda s: base64.b64encode(lzma.compress(s.encode())).decode(),
    "twice": lambda s: base64.b64encode(gzip.compress(zlib.compress(s.encode()))).decode(),
}


@pytest.mark.parametrize("outer", [None, *WRAPS])
@pytest.mark.parametrize("inner", WRAPS)
def test_nested_layers(inner, outer):
    wrapped = WRAPS[inner](SECRET)
    wrapped = WRAPS[outer](wrapped) if outer else wrapped
    text = f"préfix ünd {wrapped} end"
    found = [f for f in secrets.scan(text) if f[0] == "assign"]
    assert found and all(11 <= a < b <= 11 + len(wrapped) for _, a, b, _, _ in found)
    assert any("hunter2hunter2" in f[4] for f in found)


def test_spans_of_url_and_base64_are_narrow():
    text = "aa " + quote(SECRET) + " bb"
    ((_, a, b, how, value),) = secrets.scan(text)
    assert how == "url" and text[a:b] == quote('password="hunter2hunter2', safe="=")[: b - a].replace("=", "%3D")[: b - a] and value.startswith("password")
    inner = "0123456789 token=abcdefgh 0123456789"
    text = "aa " + base64.b64encode(inner.encode()).decode() + " bb"
    spans = [(a, b) for k, a, b, _, _ in secrets.scan(text) if k == "assign"]
    assert spans == [(3 + inner.index("token") * 4 // 3, 3 + -(-(inner.index("token") + 14) * 4 // 3))]


def test_cycles_and_bombs_end():
    bomb = base64.b64encode(gzip.compress(b"z" * 10_000_000)).decode()
    assert secrets.scan("x " + bomb) == []
    deep = "token=abcdefgh"
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert [f[0] for f in secrets.scan(deep)] == ["assign"]
    for text in ("%", "%25" * 2000, "\\u", "\\ud83d", "\\ud83d\\ude00", "=" * 50, "A" * 100_000, "\\u{110000}", "%ff%fe"):
        secrets.scan(text)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_secrets(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in want) for kind in secrets.KINDS]
        assert {*said.split(",")} - {""} <= {*r.spans.split(",")}


def test_awkward_rows_and_empty_table(awkward, nothing):
    rows = secrets.find_secrets(awkward).collect()
    assert len(rows) == awkward.count()
    assert [[f.kind for f in r.finds] for r in rows if r.doc_id == 10] == [["assign"]]
    assert secrets.find_secrets(nothing).count() == 0
