"""Operator 2: WARC archives, written record by record and read back in splits.

Writing.  Every page becomes one gzip member holding one WARC/1.1 record.  Of the pages with equal payloads
(same SHA-256 and length) of at least ``min_dedup`` bytes, the smallest id is the response and the others
are revisits that refer to it; rows that repeat the smallest id are responses too.  Duplicates are found on
(digest, id) rows only, combined before the shuffle; page bodies meet the short revisit list by a join that
Spark broadcasts only if the list is small.  Files are written by Spark's text sink, so its commit protocol covers
lost tasks.  That sink ends each row with a separator; here the separator is the zero byte, which is also the last byte
of a member (the top byte of its length field).  A member of 16 MB and more would end otherwise: an empty member follows it.

Reading.  The text source splits files into byte ranges at any place and cuts at a separator, here the gzip magic
(1f 8b 08): a task gets the stretches that begin inside its range.  A stretch is a record's start if it,
with those after it where needed, inflates to a WARC header; the magic also occurs by chance inside compressed data, and such
a stretch is fed to the record before it until that one ends.  What a range cannot finish itself (a record broken by chance
magic at the range's end, and the pieces after it) is put together per file from those pieces only; a piece that fits no
record is an error.

Defined cases: a null html is an empty payload; a null id is written as an empty id, and such a page is always a
response; a null url is read back as null; repeated rows give repeated records; an empty table gives no records;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_path, shared_table, table

MAGIC = b"\x1f\x8b\x08"
MIN_DEDUP = 100
DATE = "2024-01-01T00:00:00Z"
URN = "urn:relcast:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(data) + pack.flush()
    return out if out[-1] == 0 else out + member(b"")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: the response with its payload, or a revisit without it."""
    own = "" if page_id is None else page_id
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{own}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def revisits(pages: DataFrame, min_dedup: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat an earlier page's payload."""
    big = pages.where(F.octet_length("payload") >= min_dedup).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = big.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    return big.join(first.drop("last"), "digest").where("page_id > refers_to").distinct()


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_dedup: int = MIN_DEDUP) -> None:
    """Write one record per row into the folder ``path``."""
    body = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    again = shared_table(revisits(body, min_dedup), "revisits").withColumnRenamed("page_id", "__id").withColumnRenamed("digest", "__digest")
    body = body.withColumn("digest", F.sha2("payload", 256))
    typed = body.join(again, (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, refs = b["page_id"].astype("Int64"), b["refers_to"].astype("Int64")
            rows = [member(record(None if pd.isna(i) else int(i), u, bytes(p), d, None if pd.isna(r) else int(r)))[:-1]
                    for i, u, p, d, r in zip(ids, b["url"], b["payload"], b["digest"], refs)]
            yield pd.DataFrame({"value": rows})

    packed = typed.select("page_id", "url", "payload", "digest", "refers_to").mapInPandas(pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


HEADER = re.compile(rb"(?m)^([A-Za-z-]+): ?([^\r\n]*)\r$")
COLUMNS = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"
PIECES = "file string, start long, seq long, piece binary"


def parse(data: bytes) -> tuple:
    """A record's fields in the order of COLUMNS."""
    end = data.index(b"\r\n\r\n")
    head = {k.decode().lower(): v.decode() for k, v in HEADER.findall(data[:end + 2])}
    block = data[end + 4:end + 4 + int(head["content-length"])]
    kind = head["warc-type"]
    number = lambda h: int(head[h].strip("<>")[len(URN):]) if len(head.get(h, "").strip("<>")) > len(URN) else None
    url = unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None
    payload = block[block.index(b"\r\n\r\n") + 4:] if kind == "response" else None
    return (number("warc-record-id"), url, kind, number("warc-refers-to"), head["warc-payload-digest"].removeprefix("sha256:"),
            int(head["x-payload-length"]), payload)


START = b"WARC/"


class Assembler:
    """Puts stretches (without their magic), fed in file order, together to records.

    A stretch opens a record as long as what it and the stretches after it inflate to can still begin with ``START``:
    the first block's Huffman tables come before any output, and chance magic may lie in them.  When that fails, the first
    stretch held is given back as of no use and the others are tried again, as any of them may be a record's start."""

    def __init__(self) -> None:
        self.open: list[tuple] | None = None  # (tag, stretch) of the record being read
        self.unzip, self.data = None, b""

    def _fits(self, stretch: bytes) -> bool:
        data = MAGIC + stretch
        try:
            if len(self.data) < len(START):  # most stretches that are no start fail here
                self.data += self.unzip.decompress(data, 64)
                data = self.unzip.unconsumed_tail
            if self.data[:len(START)] != START[:len(self.data)]:
                return False
            self.data += self.unzip.decompress(data)
        except zlib.error:
            return False
        return self.data[:len(START)] == START[:len(self.data)] and (len(self.data) >= len(START) or not self.unzip.eof)

    def take(self, stretch: bytes, tag: object = None) -> tuple[list[bytes], list[tuple]]:
        """(finished records, (tag, stretch) of the stretches that belong to none of this reader's records)."""
        done, unused, queue = [], [], [(tag, stretch)]
        while queue:
            tag, stretch = queue.pop()
            if self.open is None:
                self.open, self.unzip, self.data = [], zlib.decompressobj(31), b""
            self.open.append((tag, stretch))
            if not self._fits(stretch):
                unused.append(self.open[0])
                queue += reversed(self.open[1:])
                self.open = None
            elif self.unzip.eof:
                done.append(self.data)
                self.open = None
        return done, unused

    def feed(self, stretch: bytes) -> tuple[bytes | None, bool]:
        """(a finished record or None, whether all stretches were of use)."""
        done, unused = self.take(stretch)
        return (done[0] if done else None), not unused


def _filler(stretch: bytes) -> bool:
    """An empty member, or nothing (before a file's first magic)."""
    if not stretch:
        return True
    try:
        unzip = zlib.decompressobj(31)
        return unzip.decompress(MAGIC + stretch) == b"" and unzip.eof
    except zlib.error:
        return False


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files in ``path`` (COLUMNS); the payload is null for revisits."""
    lines = (spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
             .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("start")))
    names = [c.split()[0] for c in f"{COLUMNS}, {PIECES}".split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes", "start", "seq")})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none, own, at, seq, asm = (None,) * 7, (None,) * 4, None, 0, Assembler()

        def left() -> list[tuple]:
            return [none + (*at, i, p) for i, p in asm.open or []]

        for b in batches:
            rows = []
            for value, file, start in zip(b["value"], b["file"], b["start"]):
                if (file, start) != at:
                    rows += left()
                    at, seq, asm = (file, start), 0, Assembler()
                done, unused = asm.take(bytes(value), seq)
                rows += [parse(d) + own for d in done]
                rows += [none + (*at, i, p) for i, p in unused if not _filler(p)]
                seq += 1
            if rows:
                yield frame(rows)
        if rest := left():
            yield frame(rest)

    def join_pieces(pieces: pd.DataFrame) -> pd.DataFrame:
        asm, rows, lost = Assembler(), [], []
        for p in pieces.sort_values(["start", "seq"])["piece"]:
            done, unused = asm.take(bytes(p))
            rows += [parse(d) + (None,) * 4 for d in done]
            lost += [p for _, p in unused if not _filler(p)]
        lost += [p for _, p in asm.open or []]
        if lost:
            raise ValueError(f"{pieces['file'].iloc[0]}: {len(lost)} stretches ({sum(map(len, lost))} bytes) belong to no whole record")
        return frame(rows)[[c.split()[0] for c in COLUMNS.split(", ")]]

    scanned = lines.mapInPandas(scan, f"{COLUMNS}, {PIECES}")
    whole = scanned.where("piece is null").drop("file", "start", "seq", "piece")
    broken = scanned.where("piece is not null").select("file", "start", "seq", "piece").groupBy("file").applyInPandas(join_pieces, COLUMNS)
    return whole.unionByName(broken)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    prepare(spark)
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path)
    response = F.col("record_type") == "response"
    return back.select("page_id", F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                       F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
                       "record_type", "refers_to")


ORACLE_OP2 = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
