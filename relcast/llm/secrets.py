"""Operator 1: secret scans with recursive decoding.

A worklist starts with the text itself.  Every layer is scanned for the three base
kinds; then each encoded stretch in it (percent escapes, Unicode, HTML and control character
escapes, base64 at any of its four alignments, gzip or zlib data in any run of bytes) is decoded into a new
layer, until no new layer appears.  A layer already seen for the same document (same content at
the same place) is not queued again, so cycles end.  Every layer keeps runs of characters with
the stretch of the original text they came from (one entry per changed stretch, not per character): a
finding inside nested layers is reported at its stretch of the original text.

Offsets are code points, ends exclusive.  Base findings (in the text itself) are the
leftmost non-overlapping matches of each kind that are long enough.

Defined cases: a null or empty text has no findings (counts 0, the SHA-256 of the empty
string, spans ''); repeated rows give repeated results; an empty table gives no rows;
extra columns are ignored.  Bytes that look like UTF-16 are read so; other bytes that are not UTF-8 are read as Latin-1.  All members of
compressed data are inflated, and bytes after them are kept; damaged data gives what comes
before the damage, then its bytes as they are.  Base64 is decoded line by line and also joined over line breaks.  A layer
whose decompressed form exceeds ``max_layer`` bytes is scanned whole, but in stretches of that
size that overlap by ``OVERLAP``, and the row says so in ``cut_layers``: a guard against the
memory of decompression bombs, never applied to the text itself.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
OVERLAP = 1 << 20  # at most a quarter of the stretch
CHUNK = 1 << 16

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|\\[nrt]")
HEX_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+")
CONTROL = {"n": "\n", "r": "\r", "t": "\t"}
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")

Finding = tuple[int, int, str]  # start, end, kind


def find_base(text: str) -> list[Finding]:
    """Base findings of one string, ordered by start, then kind as listed."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return [(s, e, KINDS[k]) for s, k, e in out]


class Layer:
    """A decoded string and where its characters come from.

    ``starts[i]`` is the first character of run i, ``runs[i]`` its original stretch (start, end, whether character by
    character); runs are in order, and so are their stretches."""

    __slots__ = ("text", "starts", "runs")

    def __init__(self, text: str, starts: list[int], runs: list[tuple[int, int, bool]]):
        self.text, self.starts, self.runs = text, starts, runs

    @classmethod
    def whole(cls, text: str, start: int, end: int) -> Layer:
        """All of ``text`` from one original stretch."""
        return cls(text, [0], [(start, end, False)])

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect.bisect_right(self.starts, start) - 1, bisect.bisect_right(self.starts, end - 1) - 1
        a, _, each = self.runs[i]
        c, d, last_each = self.runs[j]
        return a + start - self.starts[i] if each else a, c + end - self.starts[j] if last_each else d

    def copy_runs(self, start: int, end: int, to: int, starts: list[int], runs: list[tuple[int, int, bool]]) -> None:
        """Append the runs of [start, end) as runs from ``to`` on."""
        i = bisect.bisect_right(self.starts, start) - 1
        while start < end:
            stop = min(end, self.starts[i + 1] if i + 1 < len(self.starts) else end)
            a, b, each = self.runs[i]
            starts.append(to)
            runs.append((a + start - self.starts[i], a + stop - self.starts[i], True) if each else (a, b, False))
            to += stop - start
            start, i = stop, i + 1


def _replace(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every stretch that ``decode`` can read replaced by its characters."""
    text, out, starts, runs, last, size = layer.text, [], [], [], 0, 0
    for m in pattern.finditer(text):
        got = decode(m[0])
        if not got:
            continue
        layer.copy_runs(last, m.start(), size, starts, runs)
        size += m.start() - last
        starts.append(size)
        runs.append((*layer.span(m.start(), m.end()), False))
        out += [text[last:m.start()], got]
        size += len(got)
        last = m.end()
    if not out:
        return None
    layer.copy_runs(last, len(text), size, starts, runs)
    out.append(text[last:])
    return Layer("".join(out), starts, runs)


def _read(data: bytes) -> str:
    head = data[:256]
    if len(head) >= 8:  # Latin letters in UTF-16 have a zero byte each
        odd, even = head[1::2].count(0), head[::2].count(0)
        if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return data.decode("utf-16", "replace")
        if max(odd, even) * 10 >= 4 * len(head) and min(odd, even) * 20 <= len(head):
            return data.decode("utf-16-le" if odd > even else "utf-16-be", "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _percent(s: str) -> str:
    return _read(bytes.fromhex(s.replace("%", "")))


def _escape(s: str) -> str | None:
    if s[0] == "&":
        code = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
    elif s[1] in CONTROL:
        return CONTROL[s[1]]
    else:
        code = int(s[2:].strip("{}"), 16)
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated chunks of all gzip or zlib members in a row, then the bytes after them as they are."""
    unzip, data = zlib.decompressobj(47), b""
    for more in chunks:
        data += more
        while data:
            if unzip is None:  # between members
                if len(data) < 3 and (more := next(chunks, b"")):
                    data += more
                    continue
                if not _packed(data):
                    yield data
                    yield from chunks
                    return
                unzip = zlib.decompressobj(47)
            try:
                out = unzip.decompress(data, CHUNK)
            except zlib.error:
                yield data
                yield from chunks
                return
            if out:
                yield out
            if unzip.eof:
                data, unzip = unzip.unused_data, None
            else:
                data = unzip.unconsumed_tail
                while not data and len(out) == CHUNK:  # output held back
                    if out := unzip.decompress(b"", CHUNK):
                        yield out
                    if unzip.eof:
                        data, unzip = unzip.unused_data, None
                        break


def _unpacked(data: bytes) -> Iterator[bytes]:
    """``data`` in chunks, inflated as long as it is compressed (compressed data may hold compressed data)."""
    chunks = iter([data])
    for _ in range(64):
        head = b""
        while len(head) < 3 and (more := next(chunks, b"")):
            head += more
        if not _packed(head):
            return itertools.chain([head], chunks)
        inner = _members(itertools.chain([head], chunks))
        first = next(inner, b"")
        chunks = itertools.chain([first], inner)
        if first[:64] == head[:64]:  # neither gzip nor zlib after all, or data that inflates to itself
            break
    return chunks


def _stretches(data: bytes, most: int) -> Iterator[tuple[str, bool]]:
    """The inflated text in stretches of at most ``most`` bytes; True with those beyond the first."""
    held, again = bytearray(), False
    overlap = min(OVERLAP, most // 4)
    for chunk in _unpacked(data):
        held += chunk
        while len(held) > most:
            yield _read(bytes(held[:most])), again
            again = True
            del held[:most - overlap]
    if held:
        yield _read(bytes(held)), again


def _base64(s: str) -> Iterator[tuple[int, bytes]]:
    """(characters left out in front, bytes) at each alignment: what stands before the data may be of its alphabet."""
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = body[skip:]
        if len(part) % 4 == 1:
            part = part[:-1]  # no byte in it
        if len(part) >= 2:
            yield skip, base64.b64decode(part + "=" * (-len(part) % 4))


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, base64 characters) of every run, and of lines that go on in the next: lines of one
    length with the shorter one after them, and all lines that follow each other."""
    for m in BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
    if "\n" not in text:
        return
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end(), x[0]) for x in LINE.finditer(text, m.start(), m.end())]
        groups, group = [], []
        for x in lines:
            if group and len(x[2]) > len(group[0][2]):
                groups.append(group)
                group = []
            group.append(x)
            if len(x[2]) < len(group[0][2]):
                groups.append(group)
                group = []
        groups.append(group)
        if len(groups) > 1:
            groups.append(lines)
        for g in groups:
            if len(g) > 1:
                yield g[0][0], g[-1][1], "".join(x[2] for x in g)


def scan_text(text: str | None, max_layer: int = MAX_LAYER) -> tuple[list[Finding], list[Finding], int, int]:
    """(base findings, all findings, layers decoded, layers cut) of one text."""
    text = text or ""
    base = find_base(text)
    found, work, layers, cut = set(base), [Layer(text, [0], [(0, len(text), True)])], 0, 0
    seen = {(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest(), (0, len(text)))}

    def queue(new: Layer | None) -> None:
        nonlocal layers
        if new is None or not new.text:
            return
        key = (hashlib.blake2b(new.text.encode("utf-8", "replace"), digest_size=16).digest(), new.span(0, len(new.text)))
        if key not in seen:
            seen.add(key)
            layers += 1
            found.update((*new.span(s, e), k) for s, e, k in find_base(new.text))
            work.append(new)

    def queue_bytes(data: bytes, start: int, end: int) -> None:
        nonlocal cut
        again = 0
        for part, more in _stretches(data, max_layer):
            again |= more
            queue(Layer.whole(part, start, end))
        cut += again

    while work:
        layer = work.pop()
        if "%" in layer.text:
            queue(_replace(layer, PERCENT, _percent))
        if "\\" in layer.text or "&#" in layer.text:
            queue(_replace(layer, ESCAPE, _escape))
        for pattern, mark in ((PERCENT, "%"), (HEX_BYTES, "\\x")):  # escaped bytes may be compressed data
            for m in pattern.finditer(layer.text) if mark in layer.text else ():
                if _packed(data := bytes.fromhex(m[0].replace(mark, ""))):
                    queue_bytes(data, *layer.span(m.start(), m.end()))
        for start, end, run in _runs(layer.text):
            for skip, data in _base64(run):
                queue_bytes(data, *layer.span(start + skip, end))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(found, key=lambda f: (f[0], order[f[2]], f[1])), layers, cut


def _join(found: list[Finding]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, "
          "n_layers long, cut_layers long")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """One row per document with its findings (``SCHEMA``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                base, every, layers, cut = scan_text(t, max_layer)
                n = [sum(f[2] == k for f in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(every) - len(base), layers, cut))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")][1:])
            out.insert(0, "doc_id", b["i"].astype("Int64").array)
            yield out

    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as i", f"`{text_col}` as t")
    return picked.mapInPandas(run, SCHEMA)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document."""
    prepare(spark)
    return scan_secrets(table(spark, sf_dir, "documents"))
