"""Secrets behind every kind and any nesting of layers; memory on long texts."""

import base64
import gzip
import random
import tracemalloc
import zlib

import pytest

from relcast.llm import secrets

KEY = "password=abcdefgh1234"
B64 = lambda b: base64.b64encode(b).decode()
PCT = lambda b: "".join(f"%{x:02X}" for x in b)
HEX = lambda b: "".join(f"\\x{x:02x}" for x in b)


@pytest.mark.parametrize("make", [
    lambda: PCT(gzip.compress(KEY.encode())), lambda: HEX(gzip.compress(KEY.encode())), lambda: PCT(zlib.compress(KEY.encode())),
    lambda: B64(KEY.encode("utf-16-le")), lambda: B64(KEY.encode("utf-16-be")), lambda: B64(KEY.encode("utf-16")),
    lambda: "\\n".join(B64(f"{KEY} {KEY}".encode())[i:i + 20] for i in range(0, 60, 20)),
    lambda: PCT(B64(gzip.compress(KEY.encode())).encode())], ids=range(8))
def test_byte_layers(make):
    text = make()
    got = secrets.scan_text(f"see {text} end")[1]
    assert (4, 4 + len(text), "assign") in got and {k for _, _, k in got} == {"assign"}


@pytest.mark.parametrize("front", ["v1_", "abc", "q", "ab", "abcd", "Bearer_"])
def test_letters_glued_to_the_front(front):
    text = front + B64(KEY.encode())
    got = secrets.scan_text(f"see {text} end")[1]
    assert any(s <= 4 + len(front) and e == 4 + len(text) and k == "assign" for s, e, k in got)


ENCODERS = {
    "base64": lambda t: B64(t.encode()), "gzip": lambda t: B64(gzip.compress(t.encode())), "zlib": lambda t: PCT(zlib.compress(t.encode())),
    "percent": lambda t: PCT(t.encode()), "bytes": lambda t: HEX(t.encode()), "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "html": lambda t: "".join(f"&#{ord(c)};" for c in t), "utf16": lambda t: B64(t.encode("utf-16-le")), "url64": lambda t: base64.urlsafe_b64encode(t.encode()).decode()}


def test_generated_nestings():
    rng = random.Random(11)
    for _ in range(150):
        text, names = KEY, [rng.choice(list(ENCODERS)) for _ in range(rng.choice([1, 2, 2, 3]))]
        for n in names:
            text = ENCODERS[n](f"a {text} z" if rng.random() < 0.5 else text)
        before = rng.choice(["", "see ", "x = '"])
        got = secrets.scan_text(before + text + rng.choice(["", " end", "'"]))[1]
        own = [(s, e) for s, e, k in got if k == "assign"]
        assert own and all(len(before) <= s < e <= len(before) + len(text) for s, e in own), names


def test_spans_inside_partly_escaped_text():
    text = "go %70assword%3Dabcdefgh1234 on &#65;KIA" + "B2" * 9
    got = secrets.scan_text(text)[1]
    a = text.index("%70")
    assert (a, text.index(" on"), "assign") in got and (text.index("&#65;"), len(text), "access") in got


def test_memory_follows_the_text_not_its_escapes():
    text = "lorem ipsum " * 700_000 + "%41"
    tracemalloc.start()
    secrets.scan_text(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text)  # 20 MB of text stay below 500 MB


def test_deeply_nested_escapes_end_soon():
    text = "lorem ipsum dolor " * 500 + "%" + "25" * 300 + "41"
    assert secrets.scan_text(text)[2] > 300
