"""WARC members with gzip magic by chance before their first block shows any output."""

import random
import zlib

import pytest

from relcast.llm import warc
from relcast.llm.common import prepare


def early_magic():
    """A level-6 member whose gzip header (a file name, as other writers add) or tables hold the magic within 70 bytes, and its record."""
    data = warc.record(7, "http://x/7", b"<p>" + bytes(random.Random(1).choices(b"abcdefgh <>/p", k=900)), "0" * 64, None)
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    head = warc.MAGIC + b"\x08" + bytes(6) + b"name" + warc.MAGIC + b"x" * 30 + b"\0"
    return head + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little"), data


def test_magic_in_the_first_70_bytes_of_a_compressed_member():
    packed, data = early_magic()
    assert packed.index(warc.MAGIC, 3) < 70
    after = warc.record(8, None, b"later", "1" * 64, None)
    asm = warc.Assembler()
    got = [asm.take(p) for p in (packed + warc.member(after)).split(warc.MAGIC)[1:]]
    assert [d for done, _ in got for d in done] == [data, after] and not any(u for _, u in got)


def test_undecided_stretch_does_not_swallow_the_record_after_it():
    packed, data = early_magic()
    stray = b"\x08" + bytes(6) + b"never ended"  # a header that is still open at the next magic
    asm = warc.Assembler()
    got = [asm.take(p, i) for i, p in enumerate([stray, *packed.split(warc.MAGIC)[1:]])]
    assert [d for done, _ in got for d in done] == [data]
    assert [t for _, unused in got for t, _ in unused] == [0]


def test_reader_joins_early_magic_over_ranges_and_reports_lost_pieces(spark, tmp_path):
    sp = prepare(spark)
    packed, data = early_magic()
    more = [warc.member(warc.record(i, None, b"q" * i, "2" * 64, None)) for i in range(100, 130)]
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.warc").write_bytes(b"".join(more[:15]) + packed + b"".join(more[15:]))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(b"".join(more) + packed[:-200])
    old = sp.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1k", "1m"):
            sp.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.page_id: r for r in warc.read_archive(sp, str(tmp_path / "ok")).collect()}
            assert set(got) == {7, *range(100, 130)}
            assert bytes(got[7].payload) == data[-904 - 3:-4]
        with pytest.raises(Exception, match="belong to no whole record"):
            warc.read_archive(sp, str(tmp_path / "bad")).collect()
    finally:
        sp.conf.set("spark.sql.files.maxPartitionBytes", old)
