"""Training rows and score calibration shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def training_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, y) of the labelled rows to learn from, one per id (the larger label if an id has several)."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    return rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through counts n of (value z, label y), by Newton's method."""
    a, b = 1.0, 0.0
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        g, w = n * (p - t), n * p * (1 - p) + 1e-12
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * z).sum() + 1e-6 * (a - 1), g.sum()]))
        scale = min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)
