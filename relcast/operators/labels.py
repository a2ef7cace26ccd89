"""Forward-looking labels (group D).

Every label is keyed by (``__id``, ``__timestamp``) and looks at events in
``(t, t+h]``; eligibility looks back (``(t-h, t]``, ``<= t`` or creation
``<= t``).  All heavy work goes through the slot plans in
``relcast.plans.history`` -- no (entity x anchor x event) join is ever built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import epoch_seconds, typed_part, unit_hash
from ..plans.history import (ANCHOR_IDX, TS, Agg, Win, anchor_ts, cumulative_aggregate,
                             expand_created, expand_to_anchors, window_aggregate)
from ..sources import schema as S
from ..sources.rdb import Rdb
from .anchors import anchors_frame

ID, LABEL = S.ID, S.LABEL


def _past(h: dt.timedelta) -> Win:
    return Win("past", -h, dt.timedelta(0))


def _future(h: dt.timedelta) -> Win:
    return Win("future", dt.timedelta(0), h)


def _semi(df: DataFrame, entities: DataFrame | None, entity_key: str, key: str) -> DataFrame:
    if entities is None:
        return df
    ids = entities.select(F.col(entity_key).alias(key))
    return df.join(ids, key, "left_semi").select(*df.columns)


def window_distinct_count(events: DataFrame, key: str, value: str, time_col: str, anchors,
                          window: Win, name: str = "n") -> DataFrame:
    """Per (key, anchor): number of distinct ``value`` with an event in the window.

    (key, value) pairs are first reduced per slot, so duplicates never travel
    further than the first shuffle.
    """
    per_value = window_aggregate(events.where(F.col(value).isNotNull()), [key, value], time_col,
                                 anchors, [window], [Agg("c", "count")])
    return per_value.groupBy(key, ANCHOR_IDX, TS).agg(F.count(F.lit(1)).alias(name))


def forward_label(events: DataFrame, key: str, time_col: str, anchors, horizon: dt.timedelta,
                  agg: str = "exists", value_col: str | None = None,
                  eligible: str = "active_in_window", lookback: dt.timedelta | None = None,
                  entities: DataFrame | None = None, entity_key: str | None = None,
                  entity_time: str | None = None, fill=0) -> DataFrame:
    """D-11: one builder for the forward labels.

    agg: exists | not_exists | count | count_distinct | sum (of ``value_col``).
    eligible: active_in_window (event in (t-lookback, t]), ever_active (event <= t),
    created (entity time <= t), all (every entity at every anchor), none (only
    pairs with a future event -- inner-join semantics).
    ``fill`` replaces the label of eligible pairs without future events
    (``None`` keeps NULL for sum).
    """
    entity_key = entity_key or key
    fut = _future(horizon)
    if agg == "count_distinct":
        fut_df = window_distinct_count(events, key, value_col, time_col, anchors, fut, "future__n")
        agg_col = "future__n"
        aggs = None
    else:
        aggs = [Agg("n", "count")] + ([Agg("s", "sum", value_col)] if agg == "sum" else [])
        agg_col = "future__s" if agg == "sum" else "future__n"
        fut_df = None

    if eligible == "active_in_window" and agg != "count_distinct":
        both = window_aggregate(events, [key], time_col, anchors, [_past(lookback or horizon), fut], aggs)
        pairs = both.where(F.col("past__n") > 0)
        value = F.col(agg_col)
    else:
        if eligible == "active_in_window":
            pairs = window_aggregate(events, [key], time_col, anchors, [_past(lookback or horizon)],
                                     [Agg("n", "count")]).select(key, ANCHOR_IDX, TS)
        elif eligible == "ever_active":
            pairs = cumulative_aggregate(events, [key], time_col, anchors,
                                         [Agg("n", "count")]).select(key, ANCHOR_IDX, TS)
        elif eligible == "created":
            pairs = expand_created(entities.select(F.col(entity_key).alias(key), entity_time),
                                   entity_time, anchors).select(key, ANCHOR_IDX, TS)
        elif eligible == "all":
            pairs = expand_created(entities.select(F.col(entity_key).alias(key)), None,
                                   anchors).select(key, ANCHOR_IDX, TS)
        elif eligible == "none":
            pairs = None
        else:
            raise ValueError(f"unknown eligibility {eligible!r}")
        if fut_df is None:
            fut_df = window_aggregate(events, [key], time_col, anchors, [fut], aggs)
        fut_df = fut_df.select(key, ANCHOR_IDX, agg_col)
        if pairs is None:
            pairs = fut_df.withColumn(TS, anchor_ts(F.col(ANCHOR_IDX), sorted(set(anchors))))
        else:
            pairs = pairs.join(fut_df, [key, ANCHOR_IDX], "left")
        value = F.col(agg_col)

    if agg == "exists":
        label = F.when(F.coalesce(value, F.lit(0)) > 0, 1).otherwise(0)
    elif agg == "not_exists":
        label = F.when(F.coalesce(value, F.lit(0)) > 0, 0).otherwise(1)
    elif agg in ("count", "count_distinct"):
        label = F.coalesce(value, F.lit(0)).cast("long")
    elif agg == "sum":
        label = value if fill is None else F.coalesce(value, F.lit(fill))
    else:
        raise ValueError(f"unknown label aggregate {agg!r}")
    if agg in ("exists", "not_exists"):
        label = label.cast("int")
    out = pairs.select(F.col(TS), F.col(key).alias(ID), label.alias(LABEL))
    if entities is not None and eligible not in ("created", "all"):
        out = _semi(out, entities, entity_key, ID)
    return out


# ---------------------------------------------------------------- named tasks

def user_churn(shop: Rdb, anchors, horizon: dt.timedelta) -> DataFrame:
    """D-1: customers active in (t-h, t]; label 1 if no review in (t, t+h]."""
    return forward_label(shop["review"], "customer_id", "review_time", anchors, horizon,
                         agg="not_exists", entities=shop["customer"], entity_key="customer_id")


def item_churn(shop: Rdb, anchors, horizon: dt.timedelta, polarity: str = "not_exists") -> DataFrame:
    """D-2: products active in (t-h, t]; label 1 = not bought in (t, t+h] (``polarity`` flips it)."""
    return forward_label(shop["review"], "product_id", "review_time", anchors, horizon,
                         agg=polarity, entities=shop["product"], entity_key="product_id")


def _priced_reviews(shop: Rdb) -> DataFrame:
    # Equi-join on the product key; the planner (AQE) broadcasts the product side
    # only when its measured size is under the broadcast threshold.
    # Reviews of unknown products stay: they are activity, without a price.
    return shop["review"].join(shop["product"].select("product_id", "price"), "product_id", "left")


def user_ltv(shop: Rdb, anchors, horizon: dt.timedelta) -> DataFrame:
    """D-3: active customers; label = sum of product prices bought in (t, t+h], 0 if none.
    Both windows are taken in one pass over the priced reviews."""
    both = window_aggregate(_priced_reviews(shop), ["customer_id"], "review_time", anchors, [_past(horizon), _future(horizon)],
                            [Agg("n", "count"), Agg("s", "sum", "price")])
    out = both.where(F.col("past__n") > 0).select(
        TS, F.col("customer_id").alias(ID), F.coalesce(F.col("future__s"), F.lit(0.0)).alias(LABEL))
    return _semi(out, shop["customer"], "customer_id", ID)


def item_ltv(shop: Rdb, anchors, horizon: dt.timedelta, fill_zero: bool = False) -> DataFrame:
    """D-4: per product the sum of its price over reviews in (t, t+h]; products without
    sales get no row (inner semantics) unless ``fill_zero`` (active products kept)."""
    fut = window_aggregate(shop["review"], ["product_id"], "review_time", anchors, [_future(horizon)],
                           [Agg("n", "count")])
    out = fut.join(shop["product"].select("product_id", "price"), "product_id").select(
        TS, F.col("product_id").alias(ID), (F.col("price") * F.col("future__n")).alias(LABEL))
    if fill_zero:
        act = forward_label(shop["review"], "product_id", "review_time", anchors, horizon, agg="count")
        out = act.select(TS, ID).join(out, [TS, ID], "left").select(
            TS, ID, F.coalesce(F.col(LABEL), F.lit(0.0)).alias(LABEL))
    return out


def _with_empty_anchors(pairs: DataFrame, label_cols: dict, anchors, created: DataFrame) -> DataFrame:
    """Anchors without any eligible entity keep one row with a NULL id (left-join semantics): those before the
    earliest time in ``created`` (one column), a single value combined in the scan."""
    first = created.agg(F.min(F.col(created.columns[0]).cast("timestamp_ntz"))).scalar()
    empty = anchors_frame(pairs.sparkSession, anchors, TS).where(F.coalesce(F.col(TS) < first, F.lit(True)))
    fill = empty.select(TS, F.lit(None).cast(pairs.schema[ID].dataType).alias(ID),
                        *[F.lit(v).cast(pairs.schema[c].dataType).alias(c) for c, v in label_cols.items()])
    return pairs.unionByName(fill)


def post_votes(forum: Rdb, anchors, horizon: dt.timedelta, post_type="O", vote_type="R") -> DataFrame:
    """D-5: posts created <= t with a real owner and the given type; label = number of
    distinct votes of ``vote_type`` in (t, t+h]; zeros kept; empty anchors -> NULL id."""
    posts = forum["posts"].where((F.col("OwnerUserId") != -1) & F.col("OwnerUserId").isNotNull()
                                 & (F.col("PostTypeId") == post_type))
    cand = expand_created(posts.select("Id", "CreationDate"), "CreationDate", anchors)
    votes = forum["votes"].where(F.col("VoteTypeId") == vote_type)
    n = window_distinct_count(votes, "PostId", "Id", "CreationDate", anchors, _future(horizon))
    out = cand.join(n.select(F.col("PostId").alias("Id"), ANCHOR_IDX, "n"), ["Id", ANCHOR_IDX], "left")
    out = out.select(TS, F.col("Id").alias(ID), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias(LABEL))
    return _with_empty_anchors(out, {LABEL: 0}, anchors, posts.select("CreationDate"))


def _created_exists(users: DataFrame, events: DataFrame, user_col: str, time_col: str, anchors,
                    horizon: dt.timedelta) -> DataFrame:
    cand = expand_created(users.select("Id", "CreationDate"), "CreationDate", anchors)
    fut = window_aggregate(events, [user_col], time_col, anchors, [_future(horizon)], [Agg("n", "count")])
    out = cand.join(fut.select(F.col(user_col).alias("Id"), ANCHOR_IDX, "future__n"), ["Id", ANCHOR_IDX], "left")
    return out.select(TS, F.col("Id").alias(ID),
                      F.when(F.coalesce(F.col("future__n"), F.lit(0)) >= 1, 1).otherwise(0).cast("int").alias(LABEL))


def user_badge(forum: Rdb, anchors, horizon: dt.timedelta) -> DataFrame:
    """D-6: users created <= t; label 1 if at least one badge in (t, t+h]."""
    out = _created_exists(forum["users"], forum["badges"], "UserId", "Date", anchors, horizon)
    return _with_empty_anchors(out, {LABEL: 0}, anchors, forum["users"].select("CreationDate"))


def _engagement(forum: Rdb, distinct: bool) -> DataFrame:
    parts = [forum["posts"].select("Id", F.col("OwnerUserId").alias("UserId"), "CreationDate"),
             forum["votes"].select("Id", "UserId", "CreationDate"),
             forum["comments"].select("Id", "UserId", "CreationDate")]
    u = reduce(DataFrame.unionByName, parts)
    return u.distinct() if distinct else u


def user_engagement(forum: Rdb, anchors, horizon: dt.timedelta) -> DataFrame:
    """D-7: users (id != -1) with an engagement (post, vote, comment) <= t; label 1 if any
    engagement in (t, t+h].  Existence does not depend on the UNION's de-duplication,
    so the union is left as UNION ALL (no extra shuffle)."""
    eng = _engagement(forum, distinct=False)
    users = forum["users"].where(F.col("Id") != -1).select("Id")
    first = eng.groupBy("UserId").agg(F.min("CreationDate").alias("first_ts")).join(
        users.withColumnRenamed("Id", "UserId"), "UserId", "left_semi")
    cand = expand_created(first, "first_ts", anchors)
    fut = window_aggregate(eng, ["UserId"], "CreationDate", anchors, [_future(horizon)], [Agg("n", "count")])
    out = cand.join(fut.select("UserId", ANCHOR_IDX, "future__n"), ["UserId", ANCHOR_IDX], "left")
    return out.select(TS, F.col("UserId").alias(ID),
                      F.when(F.coalesce(F.col("future__n"), F.lit(0)) >= 1, 1).otherwise(0).cast("int").alias(LABEL))


def comment_union_all(forum: Rdb, anchors, horizon: dt.timedelta) -> DataFrame:
    """D-8: users created <= t; label 1 if any comment, post or vote (UNION ALL) in (t, t+h]."""
    eng = _engagement(forum, distinct=False)
    return _created_exists(forum["users"], eng, "UserId", "CreationDate", anchors, horizon)


def current_value(table: DataFrame, key: str, time_col: str, value_col: str, anchors) -> DataFrame:
    """D-9: value of an entity column for every entity created <= t (no horizon)."""
    cand = expand_created(table.select(key, time_col, value_col), time_col, anchors)
    return cand.select(TS, F.col(key).alias(ID), F.col(value_col).alias(LABEL))


def link_labels(links: DataFrame, src: str, dst: str, time_col: str, anchors, horizon: dt.timedelta,
                src_entities: DataFrame | None = None, src_time: str | None = None,
                dst_entities: DataFrame | None = None, dst_time: str | None = None) -> DataFrame:
    """D-10: future-link labels for (src, dst) pairs.

    A pair is a candidate at t when both ends exist at t and the pair has not
    linked yet (first link > t).  Pairs that link at some time are emitted
    explicitly with label = first link in (t, t+h]; pairs that never link are
    all-zero and not enumerated (the full src x dst x anchor product is never
    built).  ``link_candidates`` draws candidates without knowing which will link.
    """
    first = links.groupBy(src, dst).agg(F.min(time_col).alias("__first"))
    pairs = first
    if src_entities is not None:
        cols = [F.col(src_entities.columns[0]).alias(src)]
        if src_time:
            cols.append(F.col(src_time).alias("__src_t"))
        pairs = pairs.join(src_entities.select(*cols), src)
    if dst_entities is not None:
        cols = [F.col(dst_entities.columns[0]).alias(dst)]
        if dst_time:
            cols.append(F.col(dst_time).alias("__dst_t"))
        pairs = pairs.join(dst_entities.select(*cols), dst)
    born = [c for c in ("__src_t", "__dst_t") if c in pairs.columns]
    if born:
        pairs = pairs.withColumn("__born", F.greatest(*[F.col(c) for c in born]) if len(born) > 1 else F.col(born[0]))
        cand = expand_created(pairs, "__born", anchors)
    else:
        cand = expand_created(pairs, None, anchors)
    cand = cand.where(F.col("__first") > F.col(TS))
    label = F.when(F.col("__first") <= F.col(TS) + F.lit(horizon), 1).otherwise(0).cast("int")
    return cand.select(TS, F.col(src).alias(ID), F.col(dst).alias(S.TARGET_ID), label.alias(LABEL))


HUB = 1000  # rows that one piece of a hub meets at a time


def _hub_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Equi-join in which a key with many right rows (a hub) is cut into pieces of about ``HUB`` rows: the right rows are
    dealt to the pieces by the hash of ``spread``, the left rows meet every piece.  The rows are those of a plain join."""
    pieces = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB)).cast("int").alias("__pieces"))
    lp = left.join(pieces, keys).withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__pieces")
    rp = right.join(pieces, keys).withColumn("__piece", F.pmod(F.xxhash64(spread), F.col("__pieces")).cast("int")).drop("__pieces")
    return lp.join(rp, [*keys, "__piece"]).drop("__piece")


def link_candidates(links: DataFrame, src: str, dst: str, time_col: str, anchors, recent: dt.timedelta, horizon: dt.timedelta,
                    src_entities: DataFrame, dst_entities: DataFrame, negatives: int = 2, seed: int = 7) -> DataFrame:
    """D-10 with candidates that know nothing of the future: (``__timestamp``, ``__id``, ``__target_id``, ``__label``).

    At each anchor t a source's candidates are (a) the targets of its co-neighbours, i.e. of sources that share a target with
    it, all three links within ``recent`` before t, and (b) targets drawn by a seeded hash, about ``negatives`` per source.
    Both ends exist at t and have not linked up to t; the label is 1 when their first link lies in (t, t + horizon].
    ``src_entities`` and ``dst_entities`` have two columns, id and time of creation.

    The walk over links is two equi-joins per anchor, hubs cut into pieces by their degree; the drawn targets are
    an equi-join on hash buckets, as many as there are targets.  No source x target product is formed."""
    anchors = sorted(set(anchors))
    sid, sborn = src_entities.columns
    did, dborn = dst_entities.columns
    edges = (expand_to_anchors(links.select(src, dst, time_col).where(F.col(src).isNotNull() & F.col(dst).isNotNull()), time_col, anchors,
                               Win("recent", -recent, dt.timedelta(0)))
             .select(ANCHOR_IDX, F.col(src).alias("__u"), F.col(dst).alias("__x")).distinct())
    other = edges.withColumnRenamed("__u", "__v")
    near = _hub_join(edges, other, [ANCHOR_IDX, "__x"], "__v").where("__u != __v").select(ANCHOR_IDX, "__u", "__v").distinct()
    walk = _hub_join(near, other.withColumnRenamed("__x", "__y"), [ANCHOR_IDX, "__v"], "__y").select(ANCHOR_IDX, "__u", "__y").distinct()

    known = expand_created(src_entities.select(F.col(sid).alias("__u"), F.col(sborn).alias("__born")), "__born", anchors)
    n = dst_entities.count()
    draw = known.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1)))) if negatives else known.limit(0).withColumn("__i", F.lit(0))
    draw = draw.select(ANCHOR_IDX, "__u", F.floor(unit_hash(seed, epoch_seconds(F.col(TS)), typed_part(known, "__u"), F.col("__i")) * n).alias("__bucket"))
    targets = dst_entities.select(F.col(did).alias("__y"), F.col(dborn).cast("timestamp_ntz").alias("__yb"))
    drawn = draw.join(targets.select("__y", F.floor(unit_hash(seed + 1, typed_part(targets, "__y")) * n).alias("__bucket")), "__bucket")
    pairs = walk.unionByName(drawn.select(ANCHOR_IDX, "__u", "__y")).distinct()

    pairs = pairs.withColumn(TS, anchor_ts(F.col(ANCHOR_IDX), anchors))
    pairs = pairs.join(known.select(ANCHOR_IDX, "__u"), [ANCHOR_IDX, "__u"], "left_semi").join(targets, "__y").where(F.col("__yb") <= F.col(TS))
    first = links.groupBy(F.col(src).alias("__u"), F.col(dst).alias("__y")).agg(F.min(time_col).cast("timestamp_ntz").alias("__first"))
    found = pairs.join(first, ["__u", "__y"], "left").where(F.col("__first").isNull() | (F.col("__first") > F.col(TS)))
    label = F.coalesce((F.col("__first") <= F.col(TS) + F.lit(horizon)).cast("int"), F.lit(0))
    return found.select(TS, F.col("__u").alias(ID), F.col("__y").alias(S.TARGET_ID), label.alias(LABEL))


# ---------------------------------------------------------------- user code

def run_label_spec(spec, tables: dict, anchors, spark=None) -> DataFrame:
    """D-12: user label code -- a function ``(tables, anchors) -> frame`` receiving the
    table frames by name and the anchor list (a plain driver-side list of
    timestamps), or SQL text over temp views (tables by name,
    anchors as view ``timestamps`` with column ``timestamp``; the SQL runs as
    written, so its joins are the user's).  The result is validated (D-13)."""
    spark = spark or next(iter(tables.values())).sparkSession
    if isinstance(spec, str):
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        anchors_frame(spark, anchors, "timestamp").createOrReplaceTempView("timestamps")
        out = spark.sql(spec)
    elif isinstance(spec, Callable):
        out = spec(tables, sorted(anchors))
    else:
        raise TypeError("label spec must be SQL text or a callable")
    return validate_labels(out)


def validate_labels(df: DataFrame, require_unique: bool = False) -> DataFrame:
    """D-13: the three label columns must be present; the timestamp is parsed to NTZ."""
    missing = [c for c in (ID, S.TS, LABEL) if c not in df.columns]
    if missing:
        raise ValueError(f"label frame lacks columns {missing}")
    if require_unique:
        keys = [c for c in (ID, S.TARGET_ID, S.TS) if c in df.columns]
        twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"label frame has several rows for {twice[0].asDict()}")
    ts_type = df.schema[S.TS].dataType.simpleString()
    if ts_type not in ("timestamp_ntz",):
        df = df.withColumn(S.TS, F.to_timestamp_ntz(F.col(S.TS).cast("string")))
    return df
