"""Operator 3: quality classifier by regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics of its whole text (word and line counts on a log scale,
square roots of character-class shares, ratios).  Each class gets a mean and a covariance, shrunk towards
the pooled covariance and a multiple of the identity.  The score comes from the difference of the classes'
Gaussian log densities: Mahalanobis distances by Cholesky factors that are inverted once.  A logistic
curve fitted to the training rows' differences turns them into probabilities.

Only sums over the training rows reach the driver: per class a count, a mean and a matrix of second moments,
then a histogram of differences with fixed bins.  All labelled rows outside the held-out fold are used.

Defined cases: a null or empty text has the statistics of no words and is scored like any other; null labels and
labels other than 0 and 1 are ignored; an id labelled twice counts once; repeated rows give repeated results; with
no training row of a class the score is the share of label 1 (0.5 without labels); an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_table, table
from .labelled import held_out, platt, sigmoid, training_labels

THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.02
BIN = 0.25
FEATURES = 18

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 sentence end, 6 '!', 7 '|', 8 comma, 9 symbol, 10 byte >= 128
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 10
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".?"]] = 5
_CLASS[ord("!")], _CLASS[ord("|")], _CLASS[ord(",")] = 6, 7, 8
_CLASS[[ord(c) for c in "#$%&*+<=>@^_`~\\{}[]/"]] = 9


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    share = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 11) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, m = max(1, len(words)), max(1, len(lines))
    distinct = len(set(words))
    kept = sum(len(x) for x in set(lines))
    caps = sum(x.isupper() and len(x) > 1 for x in words)
    out = np.empty(FEATURES)
    out[:10] = np.sqrt(share[1:])
    out[10] = np.log1p(len(words))
    out[11] = np.log1p(len(raw) / w)
    out[12] = np.log1p(w / m)
    out[13] = distinct / w ** 0.9
    out[14] = np.sqrt(max(0.0, 1 - kept / max(1, sum(len(x) for x in lines))))
    out[15] = np.sqrt(caps / w)
    out[16] = np.log1p(max((len(x) for x in words), default=0))
    out[17] = np.sqrt(share[5] * n / w)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f) for every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["i"].astype("Int64").array, "f": [statistics(t) for t in b["t"]]})

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as i", f"`{text_col}` as t").mapInPandas(run, "doc_id long, f array<double>")


class Discriminant:
    """Class means and inverted Cholesky factors; ``difference`` is log density of class 1 minus that of class 0, with priors."""

    def __init__(self, n: list[float], mean: list[np.ndarray], cov: list[np.ndarray]):
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.scale = 1 / np.sqrt(np.diag(pooled) + 1e-9)
        pooled = pooled * np.outer(self.scale, self.scale)
        self.mean, self.inverse, self.const = [m * self.scale for m in mean], [], []
        for k in (0, 1):
            own = cov[k] * np.outer(self.scale, self.scale)
            own = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * pooled
            own = (1 - SHRINK_IDENTITY) * own + SHRINK_IDENTITY * np.trace(own) / len(own) * np.eye(len(own)) + 1e-9 * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.inverse.append(np.linalg.inv(factor))
            self.const.append(np.log(n[k]) - np.log(np.diag(factor)).sum())
        self.a, self.b = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        d = [c - 0.5 * (((x - m) @ i.T) ** 2).sum(1) for m, i, c in zip(self.mean, self.inverse, self.const)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * squash(self.difference(x)) + self.b)


def squash(d: np.ndarray) -> np.ndarray:
    """Signed square root: log densities of far-off texts differ by thousands."""
    return np.sign(d) * np.sqrt(np.abs(d))


def fit(train: DataFrame) -> Discriminant | float:
    """The classifier of rows (f, y), or the share of label 1 if a class is missing."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + FEATURES + FEATURES ** 2))
        for b in batches:
            for k in (0, 1):
                if len(mine := b.loc[b["y"] == k, "f"]):
                    x = np.stack(mine.to_numpy())
                    total[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"y": np.repeat([0, 1], total.shape[1]).astype("int32"), "at": np.tile(np.arange(total.shape[1]), 2).astype("int32"), "v": total.ravel()})

    rows = train.select("f", "y").mapInPandas(sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + FEATURES + FEATURES ** 2))
    total[rows["y"].to_numpy(int), rows["at"].to_numpy(int)] = rows["v"]
    n = total[:, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    mean = [total[k, 1:1 + FEATURES] / n[k] for k in (0, 1)]
    cov = [total[k, 1 + FEATURES:].reshape(FEATURES, FEATURES) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    model = Discriminant(list(n), mean, cov)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = np.clip(squash(model.difference(np.stack(b["f"].to_numpy()))), -100, 100)
                yield pd.DataFrame({"y": b["y"], "bin": np.floor(z / BIN).astype("int32")})

    hist = train.select("f", "y").mapInPandas(bins, "y int, bin int").groupBy("y", "bin").count().toPandas()
    model.a, model.b = platt((hist["bin"].to_numpy(float) + 0.5) * BIN, hist["y"].to_numpy(float), hist["count"].to_numpy(float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = shared_table(document_statistics(docs), "statistics")
    model = fit(stats.join(training_labels(labels, "quality"), "doc_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.full(len(b), model) if isinstance(model, float) else model.score(np.stack(b["f"].to_numpy())) if len(b) else np.zeros(0)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "score": s})

    scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    prepare(spark)
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows the classifier rejects; every row is judged by its own text, whatever its id."""
    stats = shared_table(document_statistics(docs), "statistics")
    model = fit(stats.join(training_labels(labels, "quality"), "doc_id"))
    at = docs.columns.index("text")

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if isinstance(model, float):
                s = np.full(len(b), model)
            else:
                s = model.score(np.stack([statistics(t) for t in b.column(at).to_pylist()])) if len(b) else np.zeros(0)
            yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(accepted, docs.schema)
