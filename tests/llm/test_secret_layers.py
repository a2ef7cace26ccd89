"""Layers of encoded text that hold a secret behind members, line breaks, odd bytes or the size bound."""

import base64
import gzip
import os
import textwrap
import zlib

import pytest

from relcast.llm import secrets

KEY = "password=abcdefgh1234"
B64 = lambda b: base64.b64encode(b).decode()


def kinds(text, **more):
    return {f[2] for f in secrets.scan_text(text, **more)[1]}


@pytest.mark.parametrize("data", [
    gzip.compress(b"plain first member") + gzip.compress(KEY.encode()),
    zlib.compress(b"plain") + zlib.compress(b"more") + zlib.compress(KEY.encode()),
    gzip.compress(gzip.compress(b"a") + gzip.compress(KEY.encode())),
    gzip.compress(os.urandom(200_000) + KEY.encode()),
    gzip.compress(b"first") + KEY.encode(),
    gzip.compress(b"x" * 300_000 + KEY.encode())[:-6],
    b"\x00" * 900 + KEY.encode() + b"\x00" * 900,
    KEY.encode() + b" caf\xe9",
    b"\x1f\x8b but no gzip " + KEY.encode()], ids=range(9))
def test_base64_layers(data):
    text = f"see {B64(data)} end"
    assert kinds(text) == {"assign"}
    assert (4, len(text) - 4, "assign") in secrets.scan_text(text)[1]


@pytest.mark.parametrize("sep", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_base64(sep, width):
    for data in (gzip.compress(os.urandom(400) + KEY.encode()), b"some words before it, so that the line breaks in the " + KEY.encode() + b" and more of it"):
        block = sep.join(textwrap.wrap(B64(data), width))
        for before, after in (("see\n", "\nend of it"), ("ALongLineOfHeaderWords\n", ""), ("", "\n\nend")):
            got = secrets.scan_text(before + block + after)[1]
            assert any(k == "assign" and s >= len(before) - 23 and s <= len(before) for s, e, k in got), (before, after)


def test_percent_run_with_one_bad_byte():
    text = "a " + "".join(f"%{b:02x}" for b in KEY.encode() + b" \xff") + " b"
    assert kinds(text) == {"assign"}


def test_layers_beyond_the_bound_are_scanned_whole():
    for at in (3990, 4090, 7100, 50_000):
        data = b"- " * (at // 2) + KEY.encode() + b" -" * 3000
        base, found, _, cut = secrets.scan_text("see " + B64(gzip.compress(data)), max_layer=4096)
        assert {f[2] for f in found} == {"assign"} and cut == 1
    assert secrets.scan_text(B64(gzip.compress(KEY.encode())))[3] == 0


def test_data_that_inflates_many_times_ends():
    data = KEY.encode()
    for _ in range(40):
        data = gzip.compress(data)
    assert kinds(B64(data)) == {"assign"}
