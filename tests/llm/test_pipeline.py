"""The stages of the corpus pipeline, on rows with null and repeated ids."""

import random

import pytest

import corpus_pipeline
from relcast.llm import decontam, mixing, quality
from relcast.llm.common import prepare, shared_table

DOC = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def sourced(n=900):
    rng = random.Random(4)
    return [(i if i % 5 else None, f"text {i}", rng.choice(["a", "a", "a", "a", "b", None])) for i in range(n)]


def manifest(sp, rows, weights=None, mix=True):
    docs = shared_table(sp.createDataFrame(rows, DOC).repartition(5), "test-docs")
    if mix:
        docs = shared_table(mixing.mix_documents(docs, weights), "test-mixed")
    out = corpus_pipeline.sharding(sp, docs, "").toPandas()
    return out, docs


def test_mixing_decides_the_shards(sp):
    rows = sourced()
    places = {}
    for name, weights in (("default", None), ("even", {"a": 1, "b": 1}), ("b", {"a": 1, "b": 9})):
        got, docs = manifest(sp, rows, weights)
        order = mixing.pfair_order(mixing._rows(docs, 7), weights).orderBy("slot", "nth").toPandas()
        assert got.sort_values("position").text_crc32.tolist() == order.text_crc32.tolist()
        assert got.position.min() == 0 and sorted(got.position) == list(range(len(rows)))
        n = got.groupby("shard").size()
        assert len(n) == 16 and n.max() - n.min() <= 1
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
        of_source = got.assign(source=got.source.fillna("none")).groupby(["source", "shard"]).size().unstack(fill_value=0)
        assert (of_source.max(axis=1) - of_source.min(axis=1) <= 2).all()  # every shard matches the mixture
        places[name] = dict(zip(got.text_crc32, zip(got.shard, got.slot)))
    unmixed, _ = manifest(sp, rows, mix=False)
    places["unmixed"] = dict(zip(unmixed.text_crc32, zip(unmixed.shard, unmixed.slot)))
    names = list(places)
    assert all(places[x] != places[y] for x in names for y in names if x < y)


def test_shards_are_equal_cuts_of_the_fractional_ranks(sp):
    """Against the method itself: row k of a source's n rows, in the stream's order, has the rank (k - 1/2) / n; shards are
    equal cuts of all rows by that rank, and a shard's slots keep the order of the stream."""
    for weights in (None, {"a": 1, "b": 9}):
        got, _ = manifest(sp, sourced(), weights)
        rows = got.sort_values("position").assign(source=lambda d: d.source.fillna("none")).reset_index(drop=True)
        of = rows.groupby("source")
        rows["f"] = (of.cumcount() + 0.5) / of["position"].transform("size")
        cuts = [rows[rows.shard == s].f for s in range(16)]
        assert all(x.max() <= y.min() for x, y in zip(cuts, cuts[1:]))
        for _, g in rows.groupby("shard"):
            assert g.sort_values("slot").position.is_monotonic_increasing


def test_sharding_of_rows_without_files(sp):
    got = corpus_pipeline.sharding(sp, sp.createDataFrame(sourced(50), DOC), "").toPandas()
    assert sorted(got.position) == list(range(50))
    assert corpus_pipeline.sharding(sp, shared_table(sp.createDataFrame([], DOC), "none"), "").count() == 0


LABELS = "doc_id long, quality int, toxic int"


def word_text(rng, n=40):
    return " ".join(rng.choice(["al", "be", "ce", "da", "ep"]) + str(rng.randrange(90)) for _ in range(n))


def test_null_and_repeated_ids_are_judged_row_by_row(sp, monkeypatch):
    rng = random.Random(8)
    junk = lambda: word_text(rng, 8) + " *** $$$ %%% ###" * 20
    rows = [(i, junk() if i % 5 == 1 else word_text(rng), "a") for i in range(150)]
    ids = [None] * 10 + [7] * 5
    rows += [(i, word_text(rng), "b") for i in ids] + [(i, junk(), "b") for i in ids]
    docs = shared_table(sp.createDataFrame(rows, DOC), "docs")
    labels = sp.createDataFrame([(i, int(i % 5 != 1), 0) for i in range(150) if i != 7], LABELS)
    got = sorted((r.doc_id or -1, r.text) for r in quality.drop_rejected(docs, labels).collect())
    assert got == sorted((i or -1, t) for i, t, _ in rows if "$$$" not in t)

    item = word_text(rng, 12)
    rows = [(i, word_text(rng) + (" " + item if k % 4 == 0 else ""), "a") for k, i in enumerate([None] * 12 + [3] * 12 + [50, 51])] + [(None, None, "a"), (4, "", "a")]
    docs = shared_table(sp.createDataFrame(rows, DOC), "docs")
    items = sp.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted((i or -1, t or "") for i, t, _ in rows if item not in (t or ""))
    for most in (decontam.MAX_BROADCAST, 0):
        monkeypatch.setattr(decontam.find_contaminated, "__defaults__", (*decontam.find_contaminated.__defaults__[:-1], most))
        assert sorted((r.doc_id or -1, r.text or "") for r in decontam.drop_contaminated(docs, items).collect()) == want


def test_near_duplicates_keep_one_row_of_a_group(sp):
    rng = random.Random(6)
    base, other, nulls, same = (word_text(rng, 80) for _ in range(4))
    near = base.rsplit(" ", 1)[0] + " end"
    rows = ([(5, near, "a"), (3, base, "a"), (None, base, "b"), (3, base, "a"), (9, base, "a")]
            + [(3, other, "a"), (None, nulls, "a"), (None, nulls, "a"), (None, nulls + " x", "a"), (8, same, "a"), (8, same, "b")]
            + [(20, "", "a"), (20, "", "a"), (21, "", "a"), (None, None, "a"), (None, None, "a"), (22, None, "a")])
    docs = shared_table(sp.createDataFrame(rows, DOC), "docs")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(sp, docs, "").collect()]
    kept_null = [x for x in got if x[0] is None and x[1]]
    assert len(kept_null) == 1 and kept_null[0][1] in (nulls, nulls + " x")
    rest = sorted((x for x in got if x not in kept_null), key=str)
    assert rest == sorted([(3, base), (3, other), (8, same), (20, ""), (21, ""), (None, None), (22, None)], key=str)
