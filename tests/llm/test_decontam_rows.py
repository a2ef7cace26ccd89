"""Both ways of the containment search on rows without ids, repeated rows and items without ids."""

import random

import pytest

from relcast.llm.common import prepare
from relcast.llm.decontam import find_contaminated


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def grams(text):
    w = (text or "").lower().split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("most", [10**6, 0])
def test_null_ids_on_both_ways(sp, most):
    rng = random.Random(2)
    item = [words(rng, n) for n in (6, 12, 40, 3)]
    docs = []
    for k, i in enumerate([None, None, None, 1, 1, 2, 0, 0, None, 5]):
        w = words(rng, 60)
        part = item[k % 3][: len(item[k % 3]) - (k % 4 == 3) * 3]
        docs.append((i, " ".join(w[:30] + part + w[30:]), "x", 1, 2, True))
    docs += [docs[0], (None, " ".join(item[3]), "x", 1, 2, True), (9, None, "x", 1, 2, True), (9, "", "x", 1, 2, True)]
    items = [(10, " ".join(item[0]), 1), (11, " ".join(item[1]), 1), (None, " ".join(item[2]), 1), (12, " ".join(item[2]), 1), (13, " ".join(item[3]), 1),
             (None, " ".join(item[0]), 1), (14, None, 1)]
    df = sp.createDataFrame(docs, "doc_id long, text string, item_id string, h int, of int, none boolean")
    it = sp.createDataFrame(items, "item_id long, text string, h int")
    want = {}
    for d, t, *_ in docs:
        for i, q, _ in items:
            n, k = len(grams(q)), len(grams(q) & grams(t))
            if i is not None and n and k >= 0.8 * n - 1e-9:
                want[d, i] = max(want.get((d, i), (0, 0)), (n, k))
    got = find_contaminated(df, it, max_broadcast=most).collect()
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in got} == want and len(got) == len(want)
    assert any(d is None for d, _ in want)
