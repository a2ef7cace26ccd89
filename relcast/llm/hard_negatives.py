"""Operator 11: hard-negative mining over Hilbert-ordered blocks with zone maps.

Components become whole numbers (floor of 256 x), so every score and every bound is exact.

1. Rows are ordered along a Hilbert curve through the dimensions that vary most and written as Parquet: a page is one
   Parquet row of up to PAGE candidates, made of blocks of BLOCK candidates, each with a zone map (per dimension the
   least and the greatest component).  Anchors are packed in the same order, GROUP at a time, so that the anchors of a
   group want much the same blocks.
2. A search wants, for each anchor and each of its score windows, the first k candidates.  Interval arithmetic over a
   block's zone map bounds the scores that an anchor can have in it; a block is read for an anchor only if these
   bounds meet one of the anchor's windows.  Each anchor first looks through the page that it lies in itself; the
   k-th score found there raises the lower end of the window before the other blocks are tested.
3. The search runs twice: for the positives (same label, one open window, k = 5), then for the negatives (other labels, one
   window per positive, from 30 to 90 hundredths of its score, k = 10).

Zone maps are tested in chunks of pages against groups of anchors, and visits (group, page, which anchor wants
which block) are joined to both sides by their keys, so no task holds more than a group, a page and their scores.  Best
candidates are cut to k per anchor and window in each task before they meet.  On vectors without clusters the zone maps of
many dimensions exclude little; the work is then anchors x candidates.

Defined cases: rows with a null id or label, a null vector, a null or non-finite component or another vector length than
most take no part; of rows that share an id the least (label, components) stands; an anchor without positives, or
a positive without negatives in its window, gives no rows; a negative positive_score has an empty window;
other columns are ignored; an empty table gives no rows.  Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare_packed, shared_table, table

PAGE, BLOCK = 1024, 64  # candidates of a page, and of a block with a zone map of its own
GROUP = 256  # anchors tested and scored together
CHUNK = 64  # pages whose zone maps are tested together
TASK_PAGES = 16  # pages written by one task
CURVE_DIMS, CURVE_BITS = 12, 5
BLOCKS = PAGE // BLOCK
LOWEST, HIGHEST = -(1 << 62), 1 << 62
EXACT = float(1 << 53)


def usable(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, moved: int) -> DataFrame:
    """id, label, q of the rows that take part; every ``moved``-th id has the next label."""
    raw, v = F.col(f"`{vec_col}`"), F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                          raw.cast("array<double>").alias("v"))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
                      & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    lengths = good.groupBy(F.size(v).alias("d")).count()
    good = good.where(F.size(v) == lengths.agg(F.max(F.struct("count", "d"))["d"]).scalar())
    label = F.when(F.col("id") % moved == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = good.select("id", label.alias("label"), F.transform(v, lambda x: F.floor(x * 256)).alias("q"))
    return whole.groupBy("id").agg(F.min(F.struct("label", "q")).alias("x")).select("id", "x.label", "x.q")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def spread(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of rows, and per dimension least and greatest component and variance (one number per dimension reaches the driver)."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column("q"))
                f = q.astype(np.float64)
                own = [f.sum(0), (f * f).sum(0), q.min(0), q.max(0)]
                total = own if not n else [total[0] + own[0], total[1] + own[1], np.minimum(total[2], own[2]), np.maximum(total[3], own[3])]
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_pylist([{"dim": i, "n": n, "s": float(total[0][i]), "ss": float(total[1][i]), "lo": int(total[2][i]),
                                               "hi": int(total[3][i])} for i in range(len(total[0]))])

    parts = rows.select("q").mapInArrow(part, "dim long, n long, s double, ss double, lo long, hi long")
    dims = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("lo"),
                                    F.max("hi").alias("hi")).orderBy("dim").collect()
    col = lambda c, kind: np.array([r[c] for r in dims], kind)
    n = dims[0]["n"] if dims else 0
    return n, col("lo", np.int64), col("hi", np.int64), col("ss", float) / max(n, 1) - (col("s", float) / max(n, 1)) ** 2


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates below 2**bits (rows of x), as whole numbers."""
    axes = [x[:, i].astype(np.int64) for i in range(x.shape[1])]
    for level in range(bits - 1, 0, -1):  # turn each sub-cube the way the curve enters it
        side, low = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            upper = (axes[i] & side) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0]) ^ swap
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | (a ^ turn) >> level & 1
    return key


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    if len(a) and len(b) and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each anchor with any point of each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _pack(parts: DataFrame, every: int, kind: np.dtype) -> DataFrame:
    """Ordered rows -> pages with their zone maps (anchor false) and groups of anchors (anchor true)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []  # (ids, labels, q, home page) of rows that wait for their page, or group
        wait: list[tuple] = []

        def joined(held: list[tuple], n: int) -> tuple[list[np.ndarray], list[tuple]]:
            both = [np.concatenate([h[i] for h in held]) for i in range(4)]
            rest = [x[n:] for x in both]
            return [x[:n] for x in both], [tuple(rest)] if len(rest[0]) else []

        def out(held: list[np.ndarray], anchor: bool) -> pa.RecordBatch:
            nonlocal seq
            ids, labels, q, home = held
            cuts = np.arange(0, len(ids), BLOCK)
            row = {"anchor": anchor, "no": part + seq, "ids": ids, "labels": labels, "home": home if anchor else None, "vecs": q.astype(kind).tobytes(),
                   "lo": None if anchor else np.minimum.reduceat(q, cuts).astype(kind).tobytes(),
                   "hi": None if anchor else np.maximum.reduceat(q, cuts).astype(kind).tobytes()}
            seq += 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("anchor", pa.bool_()), ("no", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
                 ("home", pa.list_(pa.int64())), ("vecs", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())]))

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal rows, wait
            while (n := sum(len(r[0]) for r in rows)) and n >= least:
                page, rows = joined(rows, PAGE)
                own = np.flatnonzero(page[0] % every == 0)
                if len(own):
                    wait.append((page[0][own], page[1][own], page[2][own], np.full(len(own), part + seq)))
                yield out(page, False)
            while (n := sum(len(r[0]) for r in wait)) and n >= min(least, GROUP):
                group, wait = joined(wait, GROUP)
                yield out(group, True)

        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_numpy(zero_copy_only=False)
                rows.append((ids, b.column("label").to_numpy(zero_copy_only=False), _matrix(b.column("q")), np.zeros(len(ids), np.int64)))
                yield from flush(PAGE)
        yield from flush(1)

    return parts.mapInArrow(run, "anchor boolean, no long, ids array<long>, labels array<long>, home array<long>, vecs binary, lo binary, hi binary")


def _zone_chunks(pages: DataFrame) -> DataFrame:
    """Zone maps of up to CHUNK pages in one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                r = b.slice(at, CHUNK).to_pydict()
                yield pa.RecordBatch.from_pylist([{"pages": r["no"], "lo": b"".join(r["lo"]), "hi": b"".join(r["hi"]),
                                                   "blocks": [-(-n // BLOCK) for n in r["n"]]}],
                                                 schema=pa.schema([("pages", pa.list_(pa.int64())), ("lo", pa.binary()), ("hi", pa.binary()), ("blocks", pa.list_(pa.int32()))]))

    return pages.select("no", "lo", "hi", F.size("ids").alias("n")).mapInArrow(run, "pages array<long>, lo binary, hi binary, blocks array<int>")


class Wanted:
    """A group's anchors with their windows: arrays (anchor, window)."""

    def __init__(self, row: dict, kind: np.dtype):
        n = len(row["ids"])
        self.ids, self.labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
        self.q = np.frombuffer(row["vecs"], kind).astype(np.int64).reshape(n, -1)
        given = row["windows"]
        width = 1 + max((x["w"] for x in given), default=0) if given is not None else 1
        self.lo, self.hi = np.full((n, width), HIGHEST), np.full((n, width), LOWEST)  # nothing
        if given is None:
            self.lo[:], self.hi[:] = LOWEST, HIGHEST  # everything
        for x in given or ():
            self.lo[x["a"], x["w"]], self.hi[x["a"], x["w"]] = x["lo"], x["hi"]
        for x in row["floors"] or ():
            self.lo[x["a"], x["w"]] = max(x["score"], self.lo[x["a"], x["w"]])


def _visits(tested: DataFrame, kind: np.dtype) -> DataFrame:
    """group, page and the (anchor, block) pairs whose bounds meet a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                want = Wanted(r, kind)
                dims = want.q.shape[1]
                lo, hi = (np.frombuffer(r[c], kind).astype(np.int64).reshape(-1, dims) for c in ("lo", "hi"))
                least, most = bounds(want.q, lo, hi)
                meets = np.zeros(least.shape, bool)
                for w in range(want.lo.shape[1]):
                    meets |= (most >= want.lo[:, w, None]) & (least <= want.hi[:, w, None]) & (want.lo <= want.hi)[:, w, None]
                at = 0
                for page, n in zip(r["pages"], r["blocks"]):
                    own = np.zeros((len(want.ids), BLOCKS), bool)
                    own[:, :n] = meets[:, at:at + n]
                    at += n
                    if own.any():
                        out.append({"group": r["group"], "page": page, "wants": np.packbits(own).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("group", pa.int64()), ("page", pa.int64()), ("wants", pa.binary())]))

    return tested.mapInArrow(run, "group long, page long, wants binary")


def _home_visits(groups: DataFrame) -> DataFrame:
    """Each anchor with all blocks of the page that it lies in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for group, home in zip(b.column("no").to_pylist(), b.column("home").to_pylist()):
                at = np.array(home)
                for page in np.unique(at):
                    own = np.repeat((at == page)[:, None], BLOCKS, axis=1)
                    out.append({"group": group, "page": int(page), "wants": np.packbits(own).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("group", pa.int64()), ("page", pa.int64()), ("wants", pa.binary())]))

    return groups.select("no", "home").mapInArrow(run, "group long, page long, wants binary")


def _best(ok: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's first k allowed entries: greatest score, then least id."""
    r, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -score[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
    return r[first], c[first]


def _scored(visits: DataFrame, same: bool, k: int, kind: np.dtype) -> DataFrame:
    """group, a, w, vec_id, score: the best of each visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                want = Wanted(r, kind)
                ids, labels = np.array(r["page_ids"], np.int64), np.array(r["page_labels"], np.int64)
                q = np.frombuffer(r["page_vecs"], kind).astype(np.int64).reshape(len(ids), -1)
                wants = np.unpackbits(np.frombuffer(r["wants"], np.uint8), count=len(want.ids) * BLOCKS).reshape(-1, BLOCKS).astype(bool)
                rows = np.flatnonzero(wants.any(1))
                cols = np.flatnonzero(wants.any(0)[np.arange(len(ids)) // BLOCK])
                score = products(want.q[rows], q[cols])
                ok = wants[rows][:, cols // BLOCK] & ((want.labels[rows, None] == labels[None, cols]) == same) & (want.ids[rows, None] != ids[None, cols])
                for w in range(want.lo.shape[1]):
                    inside = ok & (score >= want.lo[rows, w, None]) & (score <= want.hi[rows, w, None])
                    x, y = _best(inside, score, ids[cols], k)
                    if len(x):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(x), r["group"])), pa.array(rows[x].astype(np.int32)), pa.array(np.full(len(x), w, np.int32)),
                             pa.array(ids[cols][y]), pa.array(score[x, y])], ["group", "a", "w", "vec_id", "score"])

    return visits.mapInArrow(run, "group long, a int, w int, vec_id long, score long")


class Blocks:
    """Pages, zone-map chunks and anchor groups in the shared folder."""

    def __init__(self, rows: DataFrame, every: int):
        self.spark = rows.sparkSession
        self.n, lo, hi, variance = spread(rows)
        if not self.n:
            return
        widest = max(abs(int(lo.min())), abs(int(hi.max())))
        self.kind = np.dtype(np.int16 if widest < 1 << 15 else np.int32 if widest < 1 << 31 else np.int64)
        dims = np.sort(np.argsort(-variance, kind="stable")[:CURVE_DIMS])

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, span = lo[dims].astype(float), np.maximum(1.0, (hi - lo)[dims].astype(float))
            for b in batches:
                if b.num_rows:
                    at = ((_matrix(b.column("q"))[:, dims] - low) / span * ((1 << CURVE_BITS) - 1)).astype(np.int64)
                    yield b.append_column("key", pa.array(hilbert_keys(at, CURVE_BITS)))

        keyed = rows.mapInArrow(key, "id long, label long, q array<long>, key long")
        tasks = -(-self.n // (TASK_PAGES * PAGE))
        ordered = keyed.repartitionByRange(tasks, "key", "id").sortWithinPartitions("key", "id")
        blocks = shared_table(_pack(ordered, every, self.kind), "hilbert-blocks")
        self.pages = blocks.where("not anchor")
        self.groups = blocks.where("anchor").select("no", "ids", "labels", "home", "vecs")
        self.zones = shared_table(_zone_chunks(self.pages), "zone-maps")
        self.chunks = self.zones.count()

    def _tasks(self, rows: int) -> int:
        """Few bytes but much work: tasks by the number of (group, page) pairs, which a size-based choice would not give."""
        return max(1, min(rows, max(4 * self.spark.sparkContext.defaultParallelism, rows // 16)))

    def _look(self, visits: DataFrame, groups: DataFrame, same: bool, k: int) -> DataFrame:
        visits = shared_table(visits, "visits")
        tasks = self._tasks(visits.count())
        page = self.pages.select(F.col("no").alias("page"), F.col("ids").alias("page_ids"), F.col("labels").alias("page_labels"), F.col("vecs").alias("page_vecs"))
        both = visits.join(groups.withColumnRenamed("no", "group").drop("home"), "group").repartition(tasks, "page").join(page, "page")
        best = Window.partitionBy("group", "a", "w").orderBy(F.desc("score"), "vec_id")
        found = _scored(both, same, k, self.kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return shared_table(found, "found")

    def search(self, windows: DataFrame | None, same: bool, k: int) -> DataFrame:
        """group, a, w, vec_id, score, rank: the first k of every anchor's windows."""
        given = "array<struct<a: int, w: int, lo: bigint, hi: bigint>>"
        floors = "array<struct<a: int, w: int, score: bigint>>"
        if windows is None:
            groups = self.groups.withColumn("windows", F.lit(None).cast(given))
        else:
            groups = self.groups.join(windows, F.col("no") == F.col("of")).drop("of")
        home = self._look(_home_visits(groups), groups.withColumn("floors", F.lit(None).cast(floors)), same, k)
        last = (home.where(F.col("rank") == k).groupBy(F.col("group").alias("of"))
                .agg(F.collect_list(F.struct("a", "w", "score")).cast(floors).alias("floors")))  # at most one entry per anchor and window of a group
        raised = shared_table(groups.join(last, F.col("no") == F.col("of"), "left").drop("of"), "groups")
        n = max(1, self.chunks)
        chunks = self.zones.withColumn("chunk", F.pmod(F.xxhash64("pages"), F.lit(n)).cast("int"))
        of = raised.withColumnRenamed("no", "group").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        tested = of.repartition(self._tasks(n * raised.count()), "chunk", "group").join(chunks, "chunk")
        return self._look(_visits(tested.drop("home"), self.kind), raised, same, k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, moved: int = 7,
         id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``low`` and ``high`` are hundredths."""
    rows = shared_table(usable(vectors, id_col, label_col, vec_col, moved), "whole-vectors")
    blocks = Blocks(rows, every)
    if not blocks.n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = blocks.search(None, True, positives).select("group", "a", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"),
                                                       F.col("score").alias("positive_score"))
    window = F.struct("a", "w", F.expr(f"(positive_score * {low} + 99) div 100").alias("lo"), F.expr(f"positive_score * {high} div 100").alias("hi"))
    windows = near.where("positive_score >= 0").groupBy(F.col("group").alias("of")).agg(F.collect_list(window).alias("windows"))
    far = blocks.search(windows, False, negatives)
    anchors = blocks.groups.select(F.col("no").alias("group"), F.posexplode("ids").alias("a", "anchor_id"))
    return (far.join(near, ["group", "a", "w"]).join(anchors, ["group", "a"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives of each of five positives of every vec_id divisible by 100."""
    prepare_packed(spark)
    return mine(table(spark, sf_dir, "embeddings"))


# All anchors against all rows, in DuckDB.
ORACLE_OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
