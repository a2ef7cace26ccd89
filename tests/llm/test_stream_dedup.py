"""Streaming deduplication against brute force, over several runs, and with a digest that collides."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from relcast.llm import stream_dedup as sd
from relcast.llm.common import prepare, shared_path

DDL = "doc_id long, text string, digest string, place string, rows int, batch int, content string, file string"


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def put(sp, rows, path, parts=3):
    df = sp.createDataFrame([(i, t, "d", "p", 1, 2, "c", "f") for i, t in rows], DDL)
    df.repartition(parts).write.mode("append").parquet(path)


def check(sp, rows, path, state, **how):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sd.resolve(sp, path, state, **how).collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for ids in groups.values():
        best = max((i for i in ids if i is not None), default=None)
        left = [best]  # one row that has the greatest id stays
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            stays = i in left
            if stays:
                left.remove(i)
            want.append((i, best, len(ids), stays))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def some_rows(rng, n=200):
    texts = ["", None, " ", "a", "A", "a ", "é", "é", "z" * 300_000, "z" * 300_000 + "!"]
    return [(rng.choice([None, i, i, i, 7]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(60)}") for i in range(n)]


def test_matches_brute_force_over_runs(sp):
    rng = random.Random(3)
    path, state = shared_path(sp, "docs"), shared_path(sp, "state")
    rows = some_rows(rng)
    put(sp, rows, path, parts=4)
    sd.absorb(sp, path, state, files=1)  # four micro-batches, one state
    check(sp, rows, path, state)
    more = some_rows(rng, 80) + [(10**6, "text 1")]
    put(sp, more, path, parts=2)
    sd.absorb(sp, path, state)  # only the new files; copies meet the state of the first run
    check(sp, rows + more, path, state)
    sd.absorb(sp, path, state)
    check(sp, rows + more, path, state)
    texts = {r.doc_id: r.digest for r in sd.resolve(sp, path, state).collect()}
    assert texts[10**6] == hashlib.sha256(b"text 1").hexdigest()


def test_collisions_are_told_apart_by_all_bytes(sp):
    weak = lambda t: F.format_string("%d", F.pmod(F.crc32(t.cast("binary")), F.lit(5)))
    path, state = shared_path(sp, "docs"), shared_path(sp, "state")
    rows = some_rows(random.Random(5))
    put(sp, rows, path)
    sd.absorb(sp, path, state, digest=weak)
    assert sd.retained(sp, state).count() <= 5
    check(sp, rows, path, state, digest=weak)


def test_empty_and_single_file(sp):
    path, state = shared_path(sp, "docs"), shared_path(sp, "state")
    put(sp, [], path)
    sd.absorb(sp, path, state)
    assert sd.resolve(sp, path, state).count() == 0
    path, state = shared_path(sp, "docs"), shared_path(sp, "state")
    rows = [(1, "x"), (2, "x"), (3, "y")]
    put(sp, rows, path, parts=1)
    one = sp.read.parquet(path).inputFiles()[0]
    sd.absorb(sp, one, state)
    check(sp, rows, one, state)
