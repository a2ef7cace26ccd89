"""Small fixtures for the training-data operators: brute force, round trips, defined edge cases."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relcast.llm import ann, html_text, mixing, ngram_join, quality, secrets, sharding, toxicity, warc
from relcast.llm.common import prepare, shared_path
from relcast.llm.decontam import find_contaminated

DOC = "doc_id long, text string, lang string, source string, n_chars long, label string"


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def words(rng, n):
    return " ".join(rng.choice(["al", "be", "ce", "Da", "ep", "fo", "gu", "hi", "jo", "ka"]) + str(rng.randrange(50)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([3, 8, 60, 200])), "en", "a" if i % 3 else "b", 0, "x") for i in range(60)]
    base = rows[2][1] + " " + words(rng, 80)
    for i in range(60, 100):  # near copies of one text, exact copies, shared passage
        w = base.split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = "z" + str(rng.randrange(999))
        rows.append((i, " ".join(w), "en", "a", 0, "x"))
    rows += [(100, None, None, None, None, None), (101, "", "en", "a", 0, "x"), (102, " \t\n", "en", None, 0, "x"), (103, "One two", "en", "b", 0, "x"),
             (104, "one  TWO", "en", "b", 0, "x"), (105, words(rng, 30) + " " + base, "en", "b", 0, "x"), (61, rows[61][1], "en", "a", 0, "x")]
    return rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    at = {i: i for i in sets}
    def root(i):
        while at[i] != i:
            i = at[i]
        return i
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                at[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_join_matches_brute_force(sp, monkeypatch):
    rows = corpus()
    df = sp.createDataFrame(rows, DOC)
    want = brute_components(rows)
    for large, cut in ((128, 4096), (2, 3)):  # small limits: regions are merged and cut again
        monkeypatch.setattr(ngram_join, "LARGE", large)
        monkeypatch.setattr(ngram_join, "CUT", cut)
        got = ngram_join.near_components(df).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.near_components(df.limit(0)).count() == 0


def test_decontamination_matches_brute_force(sp):
    rows = corpus()
    items = [(1, rows[2][1]), (2, rows[3][1][:200]), (3, "one two"), (4, None), (5, ""), (6, rows[70][1] + " tail of five more words here")]
    df, it = sp.createDataFrame(rows, DOC), sp.createDataFrame(items, "item_id long, text string")
    want = sorted({(d, i, len(shingles(q)), len(shingles(q) & shingles(t))) for d, t, *_ in rows for i, q in items
                   if shingles(q) and len(shingles(q) & shingles(t)) >= 0.8 * len(shingles(q)) - 1e-9})
    for bound in (10**6, 0):  # one pass, and the way beyond the broadcast bound
        got = find_contaminated(df, it, max_broadcast=bound).collect()
        assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == want
    assert find_contaminated(df, it.limit(0)).count() == 0 == find_contaminated(df.limit(0), it).count()


def test_secrets_layers_and_base(sp):
    key = "password=abcdefgh1234"
    inner = base64.b64encode(gzip.compress(key.encode())).decode()
    nested = "see " + "".join(f"%{b:02X}" for b in base64.b64encode(key.encode())) + " end"
    rows = [(1, f"x {key} AKIA{'A1' * 8} {'0f' * 9}"), (2, f"go {inner} on"), (3, nested), (4, None), (5, ""), (6, "token=token:abcdefghijklmn"),
            (7, "".join(f"\\u{ord(c):04x}" for c in key)), (8, "ſecret=abcdefghijklmn K")]
    got = {r.doc_id: r for r in secrets.scan_secrets(sp.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(b"assign:2:23,access:24:44,hex:45:63").hexdigest()
    assert got[2].spans == f"assign:3:{3 + len(inner)}" and got[2].n_assign == 0
    assert got[3].spans == f"assign:4:{len(nested) - 4}" and got[7].spans == f"assign:0:{6 * len(key)}"
    for i in (4, 5, 6, 8):
        assert got[i].spans == "" and got[i].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_warc_round_trip_over_split_boundaries(sp):
    rng = random.Random(3)
    body = lambda: "".join(chr(rng.randrange(1, 0x3000)) for _ in range(rng.choice([0, 99, 900, 4000])))
    rows = [(i, f"http://x/é\r\n{i}", body()) for i in range(120)]
    rows += [(1000 + i, None, rows[i][2]) for i in range(30)] + [(5000, "u", None), (None, "v", "q" * 300)]
    old = sp.conf.get("spark.sql.files.maxPartitionBytes")
    sp.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        path = shared_path(sp, "warc-test")
        warc.write_archive(sp.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
        got = {r.page_id: r for r in warc.read_archive(sp, path).collect()}
    finally:
        sp.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(rows)
    for i, u, h in rows:
        data, first = (h or "").encode(), min((p for p, _, x in rows if p is not None and x == h), default=None)
        again = len(data) >= 100 and i is not None and i > first
        assert (got[i].url, got[i].record_type, got[i].refers_to) == (u, "revisit" if again else "response", first if again else None)
        assert got[i].digest == hashlib.sha256(data).hexdigest() and (again or bytes(got[i].payload) == data)


def test_warc_chance_magic():
    data = b"WARC/1.1\r\n" + warc.MAGIC + b"a" * 50 + warc.MAGIC + b"WARC/ no member"
    import zlib
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = pack.compress(data) + pack.flush()
    pieces, asm = stored.split(warc.MAGIC)[1:], warc.Assembler()
    assert len(pieces) == 3 and [asm.feed(p)[0] for p in pieces] == [None, None, data]


def test_sharding_and_mixing(sp):
    rows = corpus()
    df = sp.createDataFrame(rows, DOC)
    got = sharding.shard_manifest(df, 16).toPandas()
    n = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert len(got) == len(rows) and n.max() - n.min() <= 1 and got["size"].min() == 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    mixed = mixing.pfair_order(mixing._rows(df, 7), weights={"a": 5, "b": 2}, block_rows=4).toPandas()
    assert len(mixed) == len(rows)
    blocks = mixed.groupby(["slot", "source", "no_source"]).agg(w=("w", "first"), size=("nth", "size")).reset_index().sort_values("slot")
    assert blocks["slot"].tolist() == list(range(len(blocks))) and blocks["size"].max() <= 4
    done = np.zeros(3)  # less than one block from the share while every source has blocks
    keys = blocks[["source", "no_source", "w"]].drop_duplicates()
    total = mixed.groupby(["source", "no_source"]).block.max() + 1
    for t, b in enumerate(blocks.itertuples(), 1):
        k = [(x.source, x.no_source) for x in keys.itertuples()].index((b.source, b.no_source))
        done[k] += 1
        if any(done[j] >= total[(x.source, x.no_source)] for j, x in enumerate(keys.itertuples())):
            break
        assert all(abs(done[j] - t * x.w / keys["w"].sum()) < 1 for j, x in enumerate(keys.itertuples()))
    order = [r.doc_id for r in mixing.mix_documents(df).collect()]
    assert sorted(order) == sorted(r[0] for r in rows) and mixing.mix_documents(df).columns == df.columns
    assert sharding.shard_manifest(df.limit(0)).count() == 0 == mixing.mix_documents(df.limit(0)).count()


def test_ann_small_is_exact_and_skips_bad_vectors(sp):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(i, [1.0] * 8) for i in range(200, 260)]
    bad = [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0, None] + [1.0] * 6), (380, [1.0] * 3), (None, [1.0] * 8)]
    got = ann.search(sp.createDataFrame(v + bad, "vec_id long, embedding array<double>"), group=64).toPandas()
    x = {i: np.array(a) for i, a in v}
    for q in range(0, 260, 20):
        want = sorted((-ann.inner(x[q][None], a[None])[0], i) for i, a in x.items() if i != q)[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == [i for _, i in want] and np.allclose(mine.score, [-s for s, _ in want], atol=0)
    assert set(got.query_id) == set(range(0, 260, 20))


def test_classifiers_edge_cases(sp):
    rng = random.Random(9)
    rows = [(i, words(rng, 60) + (" vile scum" if i % 4 == 0 else "") + ("*** $$$ %%% ###" * 20 if i % 5 == 1 else "")) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "abc"), (3, rows[3][1])]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    lab = sp.createDataFrame([(i, int(i % 5 != 1), int(i % 4 == 0)) for i in range(300)] + [(7, None, None), (8, 5, 5)], "doc_id long, quality int, toxic int")
    for fn, truth, cut in ((quality.score_quality, lambda i: int(i % 5 != 1), 0.3), (toxicity.score_toxicity, lambda i: int(i % 4 == 0), 0.5)):
        got = fn(df, lab).toPandas()
        assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= cut) == (got.predicted == 1)).all()
        held = got[got.held_out & got.doc_id.lt(300)]
        assert np.mean([truth(int(i)) == p for i, p in zip(held.doc_id, held.predicted)]) > 0.95
        assert fn(df, lab.limit(0)).toPandas().score.nunique() == 1 and fn(df.limit(0), lab).count() == 0


@pytest.fixture(scope="module")
def chain():
    return html_text.fit(html_text.labelled_pages(html_text.DEFAULT_WORDS, 200), rounds=80)


def test_html_extraction(sp, chain):
    article = "<article><h1>A &amp; B</h1><p>First <b>bold</b>ly,\n said\tit.<br>Then<p>Be.</article>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><!-- <p>no</p> --><div class='ad'>Buy this now.</div>{article}<footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (4, "u", "<script>var t='</p>'"), (None, "u", "<div"), (1, "u", page)]
    got = html_text.extract_text(sp.createDataFrame(rows, "page_id long, url string, html string"), chain).toPandas()
    assert got.text.tolist()[:2] == ["A & B First boldly, said it. Then Be.", ""] and got.n_chars.tolist()[0] == 37
    assert len(got) == 6 and (got.text.str.len() == got.n_chars).all()


def test_html_held_out_layouts(chain):
    right = total = 0
    for page in html_text.labelled_pages(["zeta", "eta", "iota", "kappa", "mu"], 100, seed=77):
        blocks = html_text.leaf_blocks(page, chain.paths)
        right += sum(k == int(b[3] == "1") for b, k in zip(blocks, chain.viterbi(chain.emissions(blocks))))
        total += len(blocks)
    assert right / total > 0.97


def test_viterbi_is_the_best_path(chain):
    import itertools
    rng = np.random.default_rng(0)
    for _ in range(20):
        s = [tuple(x) for x in rng.normal(size=(6, 2))]
        value = lambda y: chain.start[y[0]] + sum(s[i][k] for i, k in enumerate(y)) + sum(chain.moves[a, b] for a, b in zip(y, y[1:]))
        assert np.isclose(value(chain.viterbi(s)), max(map(value, itertools.product((0, 1), repeat=6))))
