"""Every n-gram seen in training has a weight, however rare; the compact training matrix."""

import random

import numpy as np
import pytest

from relcast.llm import toxicity
from relcast.llm.common import prepare


def test_rare_terms_have_weights(spark):
    sp = prepare(spark)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    # every toxic text has a term that two training texts share, and nothing else in common
    rows = [(" ".join(word() for _ in range(30)) + (f" Zq{i // 12}xj" if i % 6 == 0 else ""), int(i % 6 == 0)) for i in range(600)]
    weights, squares, _ = toxicity.fit(sp.createDataFrame(rows, "t string, y int"))
    seen = np.unique(np.concatenate([toxicity.grams(t) for t, _ in rows]))
    assert len(seen) > 10_000 and (squares[seen] > 0).all() and np.count_nonzero(weights) == len(seen)
    assert weights[toxicity.grams("zq7xj")].sum() > 0 and np.isin(toxicity.grams("zq7xj"), seen).sum() >= 6


@pytest.mark.parametrize("entries", [1, 50, 1 << 20])
def test_matrix_and_fit(monkeypatch, entries):
    monkeypatch.setattr(toxicity, "ENTRIES", entries)
    rng = np.random.default_rng(3)
    at = np.sort(rng.choice(1 << toxicity.BITS, 80, replace=False))
    dense = rng.random((40, 80)) < 0.2
    dense[0], dense[1] = False, True
    packed = [toxicity.pack(at[x]) for x in dense]
    assert all((toxicity.unpack(p) == at[x]).all() for p, x in zip(packed, dense))
    place = np.zeros(1 << toxicity.BITS, np.int32)
    place[at] = np.arange(80)
    x = toxicity.Matrix(packed, place, dense.sum(0))
    u, e = rng.normal(size=80), rng.normal(size=40)
    assert np.allclose(x.by_row(u), dense @ u) and np.allclose(x.by_feature(e), e @ dense)
    y, r = (rng.random(40) < 0.4).astype(float), rng.normal(size=80)
    w, b = toxicity._fit_weights(y, x, r)
    scale = 1 / np.sqrt(np.maximum(1, dense @ r ** 2))
    z = (dense @ w) * scale + b
    err = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / 40 * (toxicity.sigmoid(z) - y)
    grad = (err * scale) @ dense * r + toxicity.PENALTY * w / r
    assert np.abs(grad).max() < 1e-4 and abs(err.sum()) < 1e-4
