"""Permutation attribution of one prediction (H11) with top-k report.

For an entity row x, M random feature orders and B background rows, every
(background, order, prefix length j) gives one synthetic row whose first j
features (in that order) come from x and the rest from the background row.
All synthetic rows are produced by exploding the background frame (no join),
scored in one ``model.transform``, and the score differences between
consecutive prefixes are the contributions of the feature entering at that
step.  Averaging per feature gives the attribution; for every (background,
order) the contributions sum to f(x) - f(background) exactly.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..sources import schema as S
from .forest import contributions, trees
from .model import FittedModel, _inputs

FOREST_ROWS = 8192  # background rows that go through a forest at once


def _score(fm: FittedModel, df: DataFrame, cls: int | None) -> DataFrame:
    keep = [c for c in df.columns if c.startswith("__")]
    data = fm.pre.transform(df).select(*keep, *_inputs(df, fm.num_cols, fm.cat_cols))
    out = fm.model.transform(data)
    if fm.task == "classification":
        from pyspark.ml.functions import vector_to_array
        k = 1 if cls is None else cls
        return out.select(*keep, vector_to_array("probability").getItem(k).alias("__f"))
    return out.select(*keep, F.col("prediction").alias("__f"))


def explain(fm: FittedModel, entity: DataFrame, background: DataFrame, n_perm: int = 10,
            seed: int = 42, cls: int | None = None) -> DataFrame:
    """Attribution per feature: ``feature, contribution, importance (= |contribution|)``.

    ``entity`` must hold exactly one row (raises otherwise, H13);
    ``background`` is a bounded sample (e.g. ``sampling.cap_rows``).
    """
    feats = fm.feature_names
    q = [F.col(f"`{c}`") for c in feats]
    rows = entity.select(*q).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("explain needs exactly one entity row (no history or duplicate id)")
    x = rows[0]
    k = len(feats)
    rnd = random.Random(seed)
    perms = [rnd.sample(range(k), k) for _ in range(n_perm)]
    # position of each feature in each order: pos[m][f]
    pos = [[p.index(f) for f in range(k)] for p in perms]
    pos_arr = F.array(*[F.array(*[F.lit(v) for v in row]) for row in pos])
    perm_arr = F.array(*[F.array(*[F.lit(v) for v in p]) for p in perms])
    bg = background.select(*q).withColumn("__bg", F.monotonically_increasing_id())
    syn = (bg.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
             .withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(k)))))
    mpos = F.element_at(pos_arr, F.col("__m") + 1)
    repl = {}
    for i, f in enumerate(feats):
        from_x = F.element_at(mpos, i + 1) < F.col("__j")
        dtype = background.schema[f].dataType
        repl[f] = F.when(from_x, F.lit(x[f]).cast(dtype)).otherwise(F.col(f"`{f}`"))
    syn = syn.withColumns(repl)
    scored = _score(fm, syn, cls)
    w = Window.partitionBy("__bg", "__m").orderBy("__j")
    steps = (scored.withColumn("__d", F.lead("__f").over(w) - F.col("__f"))
             .where(F.col("__j") < k)
             .withColumn("__fi", F.element_at(F.element_at(perm_arr, F.col("__m") + 1), F.col("__j") + 1)))
    names = F.array(*[F.lit(f) for f in feats])
    contrib = steps.groupBy("__fi").agg(F.avg("__d").alias("contribution"))
    return contrib.select(F.element_at(names, F.col("__fi") + 1).alias("feature"), "contribution",
                          F.abs(F.col("contribution")).alias("importance"))


def _class_scores(fm: FittedModel, df: DataFrame) -> DataFrame:
    """The ``__`` columns of ``df`` and ``__f``: the probability of every class, or the prediction alone."""
    keep = [c for c in df.columns if c.startswith("__")]
    out = fm.model.transform(fm.pre.transform(df).select(*keep, *_inputs(df, fm.num_cols, fm.cat_cols)))
    if fm.task == "classification":
        from pyspark.ml.functions import vector_to_array
        return out.select(*keep, vector_to_array("probability").alias("__f"))
    return out.select(*keep, F.array("prediction").alias("__f"))


def _synthetic_sums(fm: FittedModel, x, background: DataFrame, bg: DataFrame) -> DataFrame:
    """(class, feature index, sum of its contributions) by scoring every synthetic row, for any model."""
    feats = fm.feature_names
    k = len(feats)
    syn = bg.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(k))))
    syn = syn.withColumns({f: F.when(F.array_position("__order", i) <= F.col("__j"), F.lit(x[f]).cast(background.schema[f].dataType))
                           .otherwise(F.col(f"`{f}`")) for i, f in enumerate(feats)})
    scored = _class_scores(fm, syn).select("__order", "__j", F.posexplode("__f").alias("c", "f"))
    sides = F.array(F.struct(F.get("__order", F.col("__j") - 1).alias("i"), F.col("f").alias("v")),
                    F.struct(F.get("__order", F.col("__j")).alias("i"), (-F.col("f")).alias("v")))
    return scored.select("c", "__j", F.explode(sides).alias("s")).where("s.i is not null").groupBy("c", "s.i").agg(F.sum("s.v").alias("v"))


def _forest_sums(fm: FittedModel, forest: list, entity: DataFrame, background: DataFrame, bg: DataFrame) -> DataFrame:
    """The same for a random forest, whose synthetic rows need not be made (``forest.contributions``)."""
    q = [F.col(f"`{c}`").cast(background.schema[c].dataType).alias(c) for c in fm.feature_names]
    data = lambda df, *more: fm.pre.transform(df).select(F.array(*[c.cast("double") for c in _inputs(df, fm.num_cols, fm.cat_cols)]).alias("x"), *more)
    value = lambda v: np.array([np.nan if e is None else e for e in v], "float64")
    x = value(data(entity.select(*q)).first()["x"])
    k = len(x)

    def part(batches):
        import pyarrow as pa
        total = 0
        for b in batches:
            for at in range(0, b.num_rows, FOREST_ROWS):
                some = b.slice(at, FOREST_ROWS)
                flat = some.column("x").flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
                order = some.column("__order").flatten().to_numpy(zero_copy_only=False).astype("int32")
                total = total + contributions(forest, x, flat.reshape(-1, k), order.reshape(-1, k))
        if not np.isscalar(total):
            i, c = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel().astype("int32")), pa.array(i.ravel().astype("int32")), pa.array(total.ravel())], ["c", "i", "v"])

    return data(bg, "__order").mapInArrow(part, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v"))


def explain_whole(fm: FittedModel, entity: DataFrame, background: DataFrame, seed: int = 42, cls: int = 1) -> DataFrame:
    """Attribution over a background of any size: ``feature, contribution, importance``.

    Every background row takes the features of the entity in an order of its own, fixed by a hash of the row, so the
    work is linear in the rows (one synthetic row per feature and row) and their number takes the place of repeated
    orders.  A synthetic row's score counts for the feature that has just entered and against the one that enters next;
    the sums are combined in the tasks, no row meets another.  For a random forest the same sums are taken leaf by leaf.
    ``contribution`` is that to class ``cls`` (or to the prediction), ``importance`` the mean of its size over all classes.
    For each class the contributions add up to f(x) - mean f(background)."""
    feats = fm.feature_names
    q = [F.col(f"`{c}`") for c in feats]
    rows = entity.select(*q).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("explain needs exactly one entity row (no history or duplicate id)")
    k = len(feats)
    keys = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), *q).alias("h"), F.lit(i).alias("i")) for i in range(k)])
    bg = background.select(*q).withColumn("__order", F.transform(F.array_sort(keys), lambda e: e["i"]))
    forest = trees(fm.model.stages[-1])
    sums = _synthetic_sums(fm, rows[0], background, bg) if forest is None else _forest_sums(fm, forest, entity, background, bg)
    n = background.agg(F.count(F.lit(1))).scalar()
    per = sums.select("c", "i", (F.col("v") / n).alias("v"))
    used = F.lit(cls if fm.task == "classification" else 0)
    out = per.groupBy("i").agg(F.sum(F.when(F.col("c") == used, F.col("v"))).alias("contribution"), F.avg(F.abs("v")).alias("importance"))
    return out.select(F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("i") + 1).alias("feature"), "contribution", "importance")


def additivity_gap(fm: FittedModel, entity: DataFrame, background: DataFrame, attribution: DataFrame,
                   cls: int | None = None) -> float:
    """Built-in check: sum of contributions - (f(x) - mean f(background)) (should be ~0)."""
    q = [F.col(f"`{c}`") for c in fm.feature_names]
    fx = _score(fm, entity.select(*q).withColumn("__x", F.lit(1)), cls).first()["__f"]
    fb = _score(fm, background.select(*q).withColumn("__x", F.lit(1)), cls).agg(
        F.avg("__f")).first()[0]
    total = attribution.agg(F.sum("contribution")).first()[0]
    return total - (fx - fb)


def entity_row(features: DataFrame, entity_id, id_col: str = S.ID) -> DataFrame:
    """The latest feature row of one entity (X12: id compared in the key's type)."""
    t = features.schema[id_col].dataType
    return features.where(F.col(id_col) == F.lit(entity_id).cast(t))
