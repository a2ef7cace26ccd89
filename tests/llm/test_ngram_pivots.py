"""The join's work must not depend on which member of a group has the smallest id."""

import random

import numpy as np
import pytest

from relcast.llm import bloom, ngram_join
from relcast.llm.common import prepare, shared_path


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def copies(n, seed=1):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(n):
        w = base[:]
        for k in rng.sample(range(120), rng.randint(1, 4)):
            w[k] = "z" + str(rng.randrange(10**9))
        texts.append(" ".join(w))
    return texts


def grams(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def joined(sp, monkeypatch, ids, texts):
    """Components as sets of texts, and the rows of all pair tables but the first star."""
    made = []
    write = ngram_join.shared_table

    def counted(df, name):
        out = write(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "shared_table", counted)
    rows = ngram_join.near_components(sp.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    monkeypatch.setattr(ngram_join, "shared_table", write)
    of = dict(zip(ids, texts))
    groups = {}
    for r in rows:
        groups.setdefault(r.component_id, set()).add(of[r.doc_id])
        assert r.component_id <= r.doc_id
    return sorted(map(sorted, groups.values())), sum(made)


def test_pairs_stay_linear_under_any_order_of_ids(sp, monkeypatch):
    texts = copies(160)
    n = len(texts)
    sets = [grams(t) for t in texts]
    at = list(range(n))
    for i in range(n):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                at = [at[j] if x == at[i] else x for x in at]
    want = sorted(sorted(texts[k] for k in range(n) if at[k] == c) for c in set(at))
    orders = {"original first": list(range(n)), "original last": [n + 5] + list(range(n - 1))}
    for ids in orders.values():
        got, pairs = joined(sp, monkeypatch, ids, texts)
        assert got == want
        assert pairs <= 4 * n  # all pairs would be 80 times that


def test_scratch_tables_are_deleted(sp):
    import os
    root = os.path.dirname(shared_path(sp, "x"))
    before = set(os.listdir(root.removeprefix("file:")))
    out = ngram_join.near_components(sp.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string"))
    left = set(os.listdir(root.removeprefix("file:"))) - before
    assert len(left) == 1 and out.count() == 2


def test_filter_follows_its_keys(sp):
    keys = np.random.default_rng(0).integers(-2**62, 2**62, 3000)
    df = sp.createDataFrame([(int(k),) for k in keys], "k long")
    words = bloom.build(df, "k", 3000)
    assert len(words) * 64 <= 64 * 3000 and bloom.contains(words, keys.view(np.uint64)).all()
    other = np.random.default_rng(1).integers(-2**62, 2**62, 20_000).view(np.uint64)
    assert bloom.contains(words, other).mean() < 0.02
    with pytest.raises(ValueError):
        bloom.build(df, "k", bloom.MOST_KEYS + 1)


def test_cells_hold_only_node_and_shingle(spark, monkeypatch):
    """A text makes a row per shingle of its prefix; its size and signature stay in the table of nodes."""
    tables = {}
    keep = ngram_join.shared_table
    monkeypatch.setattr(ngram_join, "shared_table", lambda df, name: tables.setdefault(name, df.columns) and keep(df, name))
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert set(tables["cells"]) == {"node", "region", "others"}
