"""Hard negatives against brute force, the curve's steps, and how few blocks clustered vectors need."""

import math

import numpy as np
import pytest

from relcast.llm import hard_negatives as hn
from relcast.llm.common import prepare

DDL = "vec_id long, label int, embedding array<double>, id string, q string, no int, ids int, page int"


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def small(monkeypatch):
    for name, value in {"PAGE": 16, "BLOCK": 4, "BLOCKS": 4, "GROUP": 3, "CHUNK": 2, "TASK_PAGES": 2}.items():
        monkeypatch.setattr(hn, name, value)


def frame(sp, rows):
    return sp.createDataFrame([(i, k, v, "x", "y", 1, 2, 3) for i, k, v in rows], DDL)


def brute(rows, every, length):
    ok = {}
    for i, k, v in rows:
        if i is None or k is None or v is None or len(v) != length or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) for x in v])
        ok[i] = min(ok.get(i, row), row)
    out = set()
    for a in (i for i in ok if i % every == 0):
        score = {i: sum(x * y for x, y in zip(ok[a][1], q)) for i, (_, q) in ok.items() if i != a}
        like = sorted((i for i in score if ok[i][0] == ok[a][0]), key=lambda i: (-score[i], i))[:5]
        for p in like:
            far = sorted((i for i in score if ok[i][0] != ok[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]), key=lambda i: (-score[i], i))[:10]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(far, 1)}
    return out


def found(df, every):
    rows = hn.mine(df, every).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    return got


def test_matches_brute_force(sp, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 5))
    rows = [(i, int(i % 4), [float(x) for x in centre[i % 6] + 0.4 * rng.normal(size=5)]) for i in range(330)]
    rows += [(400 + i, int(i % 3), [0.5, -0.25, 0.0, 0.125, 1.0]) for i in range(60)]  # ties
    rows += [(500, 1, None), (510, None, [1.0] * 5), (520, 1, [float("nan")] * 5), (530, 1, [1.0, None, 1.0, 1.0, 1.0]), (540, 2, [1.0] * 4),
             (None, 1, [1.0] * 5), (550, 2, [float("inf")] + [0.0] * 4), (560, 1, [0.0] * 5), (20, 3, [1.0] * 5), (20, 3, [1.0] * 5), (570, 9, [-0.3] * 5), (-10, 2, [0.7] * 5)]
    assert found(frame(sp, rows), 10) == brute(rows, 10, 5)
    assert found(frame(sp, []), 10) == set() == found(frame(sp, rows[-8:-7]), 10)


def test_large_components_stay_exact(sp, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 2), [float(x) for x in rng.integers(-2**20, 2**20, size=3)]) for i in range(60)]
    assert found(frame(sp, rows), 10) == brute(rows, 10, 3)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = hn.hilbert_keys(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(1)
    points, anchors = rng.integers(-99, 99, size=(40, 6)), rng.integers(-99, 99, size=(9, 6))
    least, most = hn.bounds(anchors, points.min(0)[None], points.max(0)[None])
    score = anchors @ points.T
    assert (least <= score).all() and (score <= most).all()
    one = hn.bounds(anchors, points[:1], points[:1])
    assert (one[0] == score[:, :1]).all() and (one[1] == score[:, :1]).all()


def test_clustered_vectors_need_few_blocks(sp, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 8)) * 3
    rows = [(i, int(i % 5), [float(x) for x in centre[i % 40] + 0.01 * rng.normal(size=8)]) for i in range(2000)]
    wanted = []
    look = hn.Blocks._look

    def counted(self, visits, groups, same, k):
        got = visits.select("wants").collect()
        wanted.append(sum(bin(int.from_bytes(r.wants, "big")).count("1") for r in got))
        return look(self, visits, groups, same, k)

    monkeypatch.setattr(hn.Blocks, "_look", counted)
    assert found(frame(sp, rows), 100) == brute(rows, 100, 8)
    everything = 20 * 2000 / 4  # anchors times blocks
    assert wanted[1] < 0.25 * everything and wanted[3] < 0.6 * everything, wanted  # boxes that straddle two clusters are wide
