"""Operator 8: approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised with its own codebook, so a vector lies in
one of k * k cells (i, j).  Nearness is the inner product, which is the sum over the halves.  For a query,
a heap walks centroid pairs in order of the summed distance (here minus the inner product, the nearer the
smaller) until the cells hold the candidate budget; the candidates are then ranked by the exact inner
product of the original vectors in double precision.

The codebooks come from a hash sample of at most about ``sample`` rows; every row is indexed.  Search
work is grouped by runs of the first half's centroids: rows and query visits of one run meet in one group,
and large groups are split by hash on both sides, so no group grows with the data.  The budget is a share of
the rows: on vectors without clusters (64 dimensions, nearest products near 0.4) recall 0.9 needs about a third
of them, at every size; lower it for clustered vectors.  With no more rows than ``least`` all candidates are looked at.

Defined cases: vectors null, zero, of another length than most, or holding null or non-finite components
take no part, nor do null ids.  Ties go to the smaller vec_id.  Rows that share the query's id are not its
candidates.  Fewer than k candidates are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, shared_table, table

SAMPLE = 20_000
LEAST = 2_000
CELLS = 128  # centroids of a half
SHARE = 0.42  # candidate budget as a share of the rows
GROUPS = 16  # search groups before splitting: runs of first-half centroids
GROUP = 8_192  # rows, and query visits, of one search group


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; v in double precision."""
    v = F.col("v")
    ok = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    good = ok.where(v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0)
                    & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    lengths = good.groupBy(F.size(v).alias("d")).count()
    return good.where(F.size(v) == lengths.agg(F.max(F.struct("count", "d"))["d"]).scalar())


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Lloyd's codebook of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.argmin((c ** 2).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.integers(0, len(x), len(empty))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c ** 2).sum(1)[None, :] - 2 * x @ c.T, axis=1).astype(np.int32)


def traverse(left: np.ndarray, right: np.ndarray, counts: np.ndarray, budget: int) -> dict[int, list[int]]:
    """Cells {i: [j, ...]} in order of left[i] + right[j], by a heap, until they hold ``budget`` rows."""
    lo, ro = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, cells, rows = [(left[lo[0]] + right[ro[0]], 0, 0)], {(0, 0)}, {}, 0
    while heap and rows < budget:
        _, a, b = heapq.heappop(heap)
        i, j = int(lo[a]), int(ro[b])
        if counts[i, j]:
            cells.setdefault(i, []).append(j)
            rows += int(counts[i, j])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(lo) and y < len(ro) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[lo[x]] + right[ro[y]], x, y))
    return cells


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and v, each summed component by component."""
    out = np.zeros(len(v))
    for d in range(v.shape[1]):
        out += q[:, d] * v[:, d]
    return out


def _search_group(vecs: pd.DataFrame, visits: pd.DataFrame, k: int, cells: int) -> pd.DataFrame:
    """Each visit's k nearest among the group's rows in the cells that it visits."""
    out: list[pd.DataFrame] = []
    if len(vecs) and len(visits):
        v, ids, cell = np.stack(vecs["v"].to_numpy()), vecs["id"].to_numpy(np.int64), vecs["cell"].to_numpy()
        for at in range(0, len(visits), 128):
            part = visits.iloc[at:at + 128]
            queries, q = part["query_id"].to_numpy(np.int64), np.stack(part["q"].to_numpy())
            visited = np.zeros((len(part), cells), bool)
            for r, seen in enumerate(part["cells"]):
                visited[r, seen] = True
            rough = np.where(visited[:, cell] & (ids[None, :] != queries[:, None]), q @ v.T, -np.inf)
            last = max(0, len(v) - k)
            cut = np.partition(rough, last, axis=1)[:, last]
            low = np.where(cut > -np.inf, cut - 1e-9 * (1 + np.abs(cut)), -np.inf)
            rr, pp = np.nonzero((rough >= low[:, None]) & (rough > -np.inf))
            score = inner(q[rr], v[pp])
            order = np.lexsort((ids[pp], -score, rr))
            rr, pp, score = rr[order], pp[order], score[order]
            nth = np.arange(len(rr)) - np.searchsorted(rr, rr, "left")
            best = nth < k
            out.append(pd.DataFrame({"query_id": queries[rr[best]], "vec_id": ids[pp[best]], "score": score[best]}))
    if out:
        return pd.concat(out, ignore_index=True)
    return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           share: float = SHARE, cells: int | None = None, sample: int = SAMPLE, least: int = LEAST,
           group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every id divisible by ``every``."""
    spark = vectors.sparkSession
    rows = shared_table(usable(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    budget = max(least, math.ceil(share * n))
    size = cells or max(4, min(CELLS, round(math.sqrt(n))))
    span = -(-size // GROUPS)
    part = min(1 << 20, math.ceil(sample / n * (1 << 20)))
    fit = np.stack(rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part).select("v").toPandas()["v"].to_numpy())
    half = fit.shape[1] // 2
    books = spark.sparkContext.broadcast((kmeans(fit[:, :half], size), kmeans(fit[:, half:], size)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = books.value
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                yield b.assign(i=_nearest(x[:, :half], left), j=_nearest(x[:, half:], right))

    index = shared_table(rows.mapInPandas(assign, "id long, v array<double>, i int, j int"), "multi-index")
    held = index.groupBy("i", "j").count().collect()  # at most size * size rows
    counts = np.zeros((size, size), np.int64)
    for r in held:
        counts[r["i"], r["j"]] = r["count"]
    table_ = spark.sparkContext.broadcast(counts)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = books.value
        for b in batches:
            got = []
            for query, q in zip(b["id"], b["v"]):
                path: dict[int, list[int]] = {}
                for i, js in traverse(-(left @ q[:half]), -(right @ q[half:]), table_.value, budget).items():
                    path.setdefault(i // span, []).extend(i % span * size + j for j in js)
                got += [(query, q, g, seen) for g, seen in path.items()]
            yield pd.DataFrame(got, columns=["query_id", "q", "g", "cells"])

    # few bytes but much work: as many tasks as cores at least, which a size-based choice would not give
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n // group))
    visits = shared_table(rows.where(F.pmod("id", F.lit(every)) == 0).repartition(tasks, "id")
                          .mapInPandas(visit, "query_id long, q array<double>, g int, cells array<int>"), "visits")
    held = np.add.reduceat(counts.sum(1), np.arange(0, size, span))
    seen = {r["g"]: r["count"] for r in visits.groupBy("g").count().collect()}  # at most GROUPS rows
    parts = F.create_map(*[F.lit(int(x)) for g, c in enumerate(held) for x in (g, -(-int(c) // group) or 1)])
    chunks = F.create_map(*[F.lit(int(x)) for g in range(len(held)) for x in (g, -(-seen.get(g, 0) // group) or 1)])
    of, to = F.element_at(parts, F.col("g")), F.element_at(chunks, F.col("g"))
    a = (index.select("id", "v", F.expr(f"i div {span}").cast("int").alias("g"), F.expr(f"i % {span} * {size} + j").alias("cell"))
         .withColumn("p", F.pmod(F.xxhash64("id"), of).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), to - 1))))
    b = (visits.withColumn("c", F.pmod(F.xxhash64("query_id"), to).cast("int"))
         .withColumn("p", F.explode(F.sequence(F.lit(0), of - 1))))
    key = ["g", "p", "c"]
    a, b = a.repartition(tasks, *key), b.repartition(tasks, *key)
    found = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(
        lambda x, y: _search_group(x, y, k, span * size), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vec_id divisible by 20."""
    prepare(spark)
    return search(table(spark, sf_dir, "embeddings"))
