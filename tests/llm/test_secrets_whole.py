from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import zlib
from urllib.parse import quote, quote_from_bytes

import pytest
import zstandard

from girder.llm import secrets

PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


def b64(raw):
    return base64.b64encode(raw).decode()


def values(text, kind="assign"):
    return [f[4] for f in secrets.scan(text) if f[0] == kind]


@pytest.mark.parametrize("how", PACKERS)
def test_layers_are_read_to_their_end(how):
    for raw in (b" " * 3_000_000 + b"token=abcdefgh1234", b"lorem ipsum dolor. " * 200_000 + "é token=abcdefgh1234 é".encode()):
        assert values("x " + b64(PACKERS[how](raw)) + " y") == ["token=abcdefgh1234"]


def test_windows_part_no_find():
    rng = random.Random(3)
    words = [f"token=v{i:06d}xyz" for i in range(90_000)]
    text = "".join(w + rng.choice([" ", ", ", "\n", " and ", ".\n"]) for w in words)
    assert len(text) > 1_200_000
    assert [v.rstrip(".") for v in values(b64(gzip.compress(text.encode())))] == words


@pytest.mark.parametrize("how", PACKERS)
def test_every_secret_of_a_compressed_layer(how):
    config = "".join(f'password = "value{i:03d}" # 100%25\n' for i in range(20)) + "password = \"value003\"\n"
    want = [f'password = "value{i:03d}' for i in range(20)] + ['password = "value003']
    assert sorted(values("cfg: " + b64(PACKERS[how](config.encode())) + " end")) == sorted(want)
    nested = "inner " + b64(PACKERS[how](config.encode())) + " token=outer12345"
    assert len(values(b64(gzip.compress(nested.encode())))) == 22


@pytest.mark.parametrize("how", PACKERS)
def test_members_escapes_and_wrapped_lines(how):
    rng = random.Random(5)
    noise = "".join(rng.choice("ghijklmnop qrstuv\n") for _ in range(600))
    one, two = PACKERS[how](noise.encode()), PACKERS[how](b"token=abcdefgh1234")
    want = ["token=abcdefgh1234"]
    assert values(b64(one + two)) == want
    for width in (64, 76):
        whole = b64(PACKERS[how]((noise + "token=abcdefgh1234").encode()))
        lines = [whole[k : k + width] for k in range(0, len(whole), width)]
        assert len(lines) > 4
        for end in ("\n", "\r\n", "\n  ", "\\n"):
            assert values("key: " + end.join(lines) + "\nEnd of it") == want, end
    # what is packed as it is can also be read past the packing
    assert want[0] in values("q=" + quote_from_bytes(two) + " end")
    assert want[0] in values("q=" + "".join(f"%{b:02X}" for b in two))
    assert want[0] in values("x = '" + "".join(f"\\x{b:02x}" for b in two) + "'")
    assert want[0] in values(f"x = {two!r}")


def test_bytes_that_are_not_utf8():
    raw = b"\xff\xfe caf\xe9 token=abcdefgh1234 \x80"
    assert values(b64(raw)) == ["token=abcdefgh1234"]
    assert values(b64(gzip.compress(raw))) == ["token=abcdefgh1234"]
    assert values("%FF" + "".join(f"%{b:02X}" for b in raw)) == ["token=abcdefgh1234"]
    assert values(quote(b64(b"x " + raw))) == ["token=abcdefgh1234"]
