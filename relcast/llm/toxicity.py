"""Operator 6: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character 3- to 5-grams of the lower-cased whole text, hashed into a table of fixed
size.  r is the log ratio of a feature's smoothed document frequency among toxic and other training texts;
a feature present in a text has value r.  A logistic model with an L2 penalty is fitted on those values.

Learning uses at most about ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id.
Document frequencies are counted in tasks and summed by Spark; the driver gets one row per hashed feature (fixed
table size) and, in two bytes an entry, which training rows have it.  Every feature seen in training has its own
weight.  Scoring reads each text once.

Defined cases: a null or empty text has no features and gets the model's base score; null labels and labels other
than 0 and 1 are ignored; an id labelled twice counts once (toxic if either label says so); repeated rows give
repeated results; with no training row of a class the score is the share of label 1 (0 without labels); an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_table, table
from .labelled import held_out, sigmoid, training_labels

THRESHOLD = 0.5
SAMPLE = 10_000
BITS = 19
SIZES = (3, 4, 5)
SMOOTH = 1.0
PENALTY = 2e-4
TASKS = 16
ENTRIES = 1 << 20  # entries of the training matrix looked at together

_FLAGS: dict[str, np.ndarray] = {}


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of one text."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32) if text else np.zeros(0, np.uint32)
    flags = _FLAGS.setdefault("f", np.zeros(1 << BITS, bool))
    h = np.zeros(len(a), np.uint32)
    for k in range(max(SIZES)):
        if len(a) <= k:
            break
        h = (h[:len(a) - k] + a[k:]) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        if k + 1 in SIZES:
            flags[(h * np.uint32(0x85EBCA77) + np.uint32(k)) >> np.uint32(32 - BITS)] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


def pack(x: np.ndarray) -> bytes:
    """Sorted features in two bytes each: how many have each value of the high bits, then the low 16 bits."""
    ends = np.searchsorted(x, np.arange(1, (1 << BITS >> 16) + 1) << 16)
    return np.diff(ends, prepend=0).astype("<u4").tobytes() + (x & 0xFFFF).astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    high = 1 << BITS >> 16
    counts = np.frombuffer(data, "<u4", high)
    return (np.repeat(np.arange(high, dtype=np.int32) << 16, counts) | np.frombuffer(data, "<u2", offset=4 * high)).astype(np.int32)


class Matrix:
    """Which of ``rows`` texts have each feature: the texts of feature j are ``of[start[j]:start[j + 1]]``."""

    def __init__(self, packed: list[bytes], place: np.ndarray, counts: np.ndarray):
        self.rows, self.counts = len(packed), counts
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.of = np.empty(self.start[-1], np.uint16 if self.rows <= 1 << 16 else np.uint32)
        free, block, held = self.start[:-1].copy(), [], 0
        for i, data in enumerate(packed):
            block.append(place[unpack(data)])
            held += len(block[-1])
            if held >= ENTRIES or i + 1 == self.rows:
                col = np.concatenate(block)
                row = np.repeat(np.arange(i + 1 - len(block), i + 1), [len(x) for x in block])
                order = np.argsort(col, kind="stable")
                col, n = col[order], np.bincount(col, minlength=len(counts))
                self.of[free[col] + np.arange(len(col)) - (np.cumsum(n) - n)[col]] = row[order]
                free += n
                block, held = [], 0
        cuts, self.parts = 0, []  # runs of features with about ENTRIES entries
        while cuts < len(counts):
            stop = max(cuts + 1, int(np.searchsorted(self.start, self.start[cuts] + ENTRIES, "right")) - 1)
            self.parts.append((cuts, stop))
            cuts = stop

    def by_row(self, u: np.ndarray) -> np.ndarray:
        """Per text the sum of its features' values."""
        out = np.zeros(self.rows)
        for a, b in self.parts:
            out += np.bincount(self.of[self.start[a]:self.start[b]], np.repeat(u[a:b], self.counts[a:b]), self.rows)
        return out

    def by_feature(self, e: np.ndarray) -> np.ndarray:
        """Per feature the sum of its texts' values."""
        return np.concatenate([np.add.reduceat(e[self.of[self.start[a]:self.start[b]]], self.start[a:b] - self.start[a]) for a, b in self.parts])


def _fit_weights(y: np.ndarray, x: Matrix, r: np.ndarray, rounds: int = 200, memory: int = 6) -> tuple[np.ndarray, float]:
    """Weights and offset of the penalised logistic model on values r, by limited-memory BFGS."""
    scale = 1 / np.sqrt(np.maximum(1.0, x.by_row(r ** 2)))  # rows of unit length
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / p, 0.5 / (1 - p)) / len(y)  # both classes count the same

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.by_row(at[:-1] * r) * scale + at[-1]
        e = weight * (sigmoid(z) - y)
        g = np.append(x.by_feature(e * scale) * r + PENALTY * at[:-1], e.sum())
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + PENALTY / 2 * (at[:-1] ** 2).sum()), g

    at = np.zeros(len(r) + 1)
    f, g = value(at)
    enough, past = 1e-4 * np.sqrt(g @ g), []
    for _ in range(rounds):
        if np.sqrt(g @ g) <= enough:
            break
        d, used = -g, []
        for s, q in reversed(past):
            k = (s @ d) / (s @ q)
            used.append(k)
            d = d - k * q
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 4.0)
        for (s, q), k in zip(past, reversed(used)):
            d = d + (k - (q @ d) / (s @ q)) * s
        step, slope = 1.0, g @ d
        while True:
            nf, ng = value(at + step * d)
            if nf <= f + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if step * d @ (ng - g) > 0:
            past = [*past, (step * d, ng - g)][-memory:]
        at, f, g = at + step * d, nf, ng
    return at[:-1] * r, float(at[-1])


def fit(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | float:
    """Per hashed feature a weight and the squared value, and the offset; from rows (t, y), a bounded sample."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for t, y in zip(b["t"], b["y"]):
                df[y, grams(t)] += 1
        at = np.flatnonzero(df.any(0))
        yield pd.DataFrame({"at": at, "n0": df[0, at].astype("int64"), "n1": df[1, at].astype("int64")})

    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(n) < 2:
        return float(n.get(1, 0) > 0)
    # every feature of the table at most: 2 ** BITS rows
    df = (texts.repartition(TASKS).mapInPandas(count, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
          .toPandas().sort_values("at"))
    p, q = (df["n1"] + SMOOTH) / (n[1] + 2 * SMOOTH), (df["n0"] + SMOOTH) / (n[0] + 2 * SMOOTH)
    at, r = df["at"].to_numpy(np.int64), np.log(p / q).to_numpy(float)
    place = np.zeros(1 << BITS, np.int32)
    place[at] = np.arange(len(at))

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [pack(grams(t)) for t in b["t"]]})

    rows = texts.mapInPandas(present, "y int, x binary").toPandas()
    y, packed = rows["y"].to_numpy(float), rows.pop("x").tolist()
    w, b = _fit_weights(y, Matrix(packed, place, (df["n0"] + df["n1"]).to_numpy(np.int64)), r)
    weights, squares = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    weights[at], squares[at] = w, r ** 2
    return weights, squares, b


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    every = training_labels(labels, "toxic")
    n = every.count()
    part = min(1 << 20, -(-sample * (1 << 20) // max(1, n)))
    chosen = every.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part)  # about ``sample`` rows
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text as t").join(F.broadcast(chosen), "doc_id").select("t", "y")
    model = fit(shared_table(texts, "labelled"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            if isinstance(model, float):
                s = [model] * len(b)
            else:
                w, sq, off = model
                got = [grams(t) for t in b["t"]]
                s = sigmoid(np.array([w[g].sum() / np.sqrt(max(1.0, sq[g].sum())) for g in got], float) + off)
            yield pd.DataFrame({"doc_id": b["i"].astype("Int64").array, "score": s})

    scored = docs.selectExpr("cast(doc_id as bigint) as i", "text as t").mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    prepare(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
