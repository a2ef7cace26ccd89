"""Registered queries over the generated tables: name -> (spark, sf_dir) -> DataFrame.

Each query runs over whole tables (no id subsets or row caps).  Anchors are
derived from the data (earliest time column) with the back-off rule.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import anchors as A
from .operators import labels as L
from .sources import adapters as AD
from .operators import attribution as X
from .operators import explore as I
from .operators import features as G
from .operators import model as M
from .operators import predictive as PQ
from .operators import sampling as C
from .operators import tasks as E
from .operators import transforms as T
from .plans.history import Win, window_aggregate
from .plans.history import Agg, cumulative_aggregate, expand_created
from .session import ensure_checkpoint_dir, materialize
from .sources import rdb as R
from .sources import schema as SC

ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
              "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@lru_cache(maxsize=64)
def _anchors_cached(kind: str, sf_dir: str, spark_id: int) -> tuple:
    from pyspark.sql import SparkSession as _S
    spark = _S.getActiveSession()
    rdb = {"shop": AD.shop, "forum_a": AD.forum_a, "forum_b": AD.forum_b}[kind](spark, sf_dir)
    today = AD.FORUM_B_TODAY if kind == "forum_b" else AD.SHOP_TODAY
    return tuple(A.make_anchors(rdb, today))


def anchors_for(spark: SparkSession, sf_dir: str, kind: str) -> list[dt.datetime]:
    """Anchors of an adapted dataset: back-off from its 'today' to its earliest time."""
    return list(_anchors_cached(kind, sf_dir, id(spark)))


H = AD.HORIZON
HB = AD.FORUM_B_HORIZON


def r4(c: str) -> F.Column:
    return F.round(F.col(f"`{c}`"), 4).alias(c)


# ---------------------------------------------------------------- group B

@query("earliest_date")
def q_earliest_date(spark, sf_dir):
    return A.earliest_date(AD.shop(spark, sf_dir))


@query("anchor_list")
def q_anchor_list(spark, sf_dir):
    return A.anchors_plan(AD.shop(spark, sf_dir), AD.SHOP_TODAY)


@query("anchors_lookback")
def q_anchors_lookback(spark, sf_dir):
    return A.anchors_plan(AD.shop(spark, sf_dir), AD.SHOP_TODAY, lookback_days=365)


# ---------------------------------------------------------------- group D

@query("label_user_churn")
def q_user_churn(spark, sf_dir):
    return L.user_churn(AD.shop(spark, sf_dir), anchors_for(spark, sf_dir, "shop"), H)


@query("label_item_churn")
def q_item_churn(spark, sf_dir):
    return L.item_churn(AD.shop(spark, sf_dir), anchors_for(spark, sf_dir, "shop"), H)


@query("label_user_ltv")
def q_user_ltv(spark, sf_dir):
    df = L.user_ltv(AD.shop(spark, sf_dir), anchors_for(spark, sf_dir, "shop"), H)
    return df.select("__timestamp", "__id", r4("__label"))


@query("label_item_ltv")
def q_item_ltv(spark, sf_dir):
    df = L.item_ltv(AD.shop(spark, sf_dir), anchors_for(spark, sf_dir, "shop"), H)
    return df.select("__timestamp", "__id", r4("__label"))


@query("label_post_votes")
def q_post_votes(spark, sf_dir):
    return L.post_votes(AD.forum_a(spark, sf_dir), anchors_for(spark, sf_dir, "forum_a"), H)


@query("label_user_badge")
def q_user_badge(spark, sf_dir):
    return L.user_badge(AD.forum_b(spark, sf_dir), anchors_for(spark, sf_dir, "forum_b"), HB)


@query("label_user_engagement")
def q_user_engagement(spark, sf_dir):
    return L.user_engagement(AD.forum_b(spark, sf_dir), anchors_for(spark, sf_dir, "forum_b"), HB)


@query("label_comment_union_all")
def q_comment_union_all(spark, sf_dir):
    return L.comment_union_all(AD.forum_b(spark, sf_dir), anchors_for(spark, sf_dir, "forum_b"), HB)


@query("label_current_value")
def q_current_value(spark, sf_dir):
    f = AD.forum_a(spark, sf_dir)
    df = L.current_value(f["posts"], "Id", "CreationDate", "Score", anchors_for(spark, sf_dir, "forum_a"))
    return df.select("__timestamp", "__id", r4("__label"))


@query("label_builder_sum_fill")
def q_builder_sum_fill(spark, sf_dir):
    """D-11 builder: active customers, label = sum of review quantity in (t, t+h], 0 filled."""
    shop = AD.shop(spark, sf_dir)
    df = L.forward_label(shop["review"], "customer_id", "review_time", anchors_for(spark, sf_dir, "shop"),
                         H, agg="sum", value_col="rating", entities=shop["customer"],
                         entity_key="customer_id", fill=0.0)
    return df.select("__timestamp", "__id", r4("__label"))


@query("label_link_bounded")
def q_link_bounded(spark, sf_dir):
    """D-10: (voter, post) future-link labels over pairs that ever link."""
    f = AD.forum_a(spark, sf_dir)
    return L.link_labels(f["votes"], "UserId", "PostId", "CreationDate", anchors_for(spark, sf_dir, "forum_a"),
                         dt.timedelta(days=30), dst_entities=f["posts"].select("Id", "CreationDate"),
                         dst_time="CreationDate")


# ---------------------------------------------------------------- group C


@query("candidates_static")
def q_candidates_static(spark, sf_dir):
    return C.static_candidates(AD.shop(spark, sf_dir), "customer")


@query("candidates_creation")
def q_candidates_creation(spark, sf_dir):
    return C.creation_candidates(AD.forum_a(spark, sf_dir), "posts", anchors_for(spark, sf_dir, "forum_a"))


@query("sample_creation")
def q_sample_creation(spark, sf_dir):
    f = AD.forum_a(spark, sf_dir)
    cands = C.creation_candidates(f, "posts", anchors_for(spark, sf_dir, "forum_a"))
    return C.placeholder_label(C.proportional_sample(cands, "Id", 0.3), "Id")


@query("activity_counts")
def q_activity_counts(spark, sf_dir):
    return C.activity_counts(AD.shop(spark, sf_dir), "customer", anchors_for(spark, sf_dir, "shop"))


@query("activity_total")
def q_activity_total(spark, sf_dir):
    return C.activity_total(AD.shop(spark, sf_dir), "product", anchors_for(spark, sf_dir, "shop"))


@query("sample_activity_biased")
def q_sample_activity_biased(spark, sf_dir):
    shop = AD.shop(spark, sf_dir)
    act = C.activity_total(shop, "customer", anchors_for(spark, sf_dir, "shop"))
    ents = shop["customer"].withColumnRenamed("customer_id", "entity_id")
    cands = act.join(ents, "entity_id")
    s = C.activity_biased_sample(cands, "entity_id", "total_activity", 0.3, 2.0)
    return C.placeholder_label(s, "entity_id").select(
        "__timestamp", F.col("entity_id").alias("customer_id"), "customer_name", "segment", "balance",
        "__label__")


@query("sample_cap")
def q_sample_cap(spark, sf_dir):
    labels = L.user_churn(AD.shop(spark, sf_dir), anchors_for(spark, sf_dir, "shop"), H)
    return C.cap_rows(labels, 10_000, ["__id", "__timestamp"])


@query("sample_rows")
def q_sample_rows(spark, sf_dir):
    return C.random_rows(read_table(spark, sf_dir, "customer"), "c_custkey", 5)


@query("sampling_report")
def q_sampling_report(spark, sf_dir):
    f = AD.forum_a(spark, sf_dir)
    cands = C.creation_candidates(f, "posts", anchors_for(spark, sf_dir, "forum_a"))
    return C.sampling_report(cands, C.proportional_sample(cands, "Id", 0.3))


def read_table(spark, sf_dir, name):
    return AD.read(spark, sf_dir, name)


# ---------------------------------------------------------------- group E

def _review_snapshots(spark, sf_dir):
    """Per (customer, anchor): review count and rating sum strictly before the anchor."""
    shop = AD.shop(spark, sf_dir)
    snap = cumulative_aggregate(shop["review"], ["customer_id"], "review_time", anchors_for(spark, sf_dir, "shop"),
                                [Agg("n_reviews", "count"), Agg("sum_rating", "sum", "rating")], strict=True)
    return snap.select(F.col("customer_id").alias("__id"), "__timestamp", "n_reviews", "sum_rating")


@query("train_table")
def q_train_table(spark, sf_dir):
    shop = AD.shop(spark, sf_dir)
    labels = L.user_churn(shop, anchors_for(spark, sf_dir, "shop"), H)
    return E.train_table(shop, "customer", labels, rate=0.3)


@query("test_table")
def q_test_table(spark, sf_dir):
    return E.test_table(AD.shop(spark, sf_dir), "customer", AD.SHOP_TODAY)


@query("label_feature_join")
def q_label_feature_join(spark, sf_dir):
    shop = AD.shop(spark, sf_dir)
    labels = L.user_churn(shop, anchors_for(spark, sf_dir, "shop"), H)
    return E.label_feature_join(_review_snapshots(spark, sf_dir), labels).select(
        "__id", "__timestamp", "n_reviews", r4("sum_rating"), "__label")


@query("latest_snapshot")
def q_latest_snapshot(spark, sf_dir):
    snap = _review_snapshots(spark, sf_dir)
    return E.latest_before(snap, AD.SHOP_TODAY).select("__id", "__timestamp", "n_reviews", r4("sum_rating"))


@query("realign_snapshot")
def q_realign_snapshot(spark, sf_dir):
    from .functions.timeparts import epoch_nanos
    snap = _review_snapshots(spark, sf_dir).withColumnRenamed("__timestamp", "__timestamp__")
    t = F.col("__timestamp__")
    snap = snap.withColumns({"YEAR(__timestamp__)": F.year(t), "MONTH(__timestamp__)": F.month(t),
                             "DAY(__timestamp__)": F.dayofmonth(t), "DAYOFWEEK(__timestamp__)": F.weekday(t),
                             "TIMESTAMP___timestamp__": epoch_nanos(t)})
    latest = E.latest_before(snap, AD.SHOP_TODAY, ts_col="__timestamp__")
    return E.realign(latest, AD.SHOP_TODAY).select(
        "__id", "__timestamp__", "n_reviews", "YEAR(__timestamp__)", "MONTH(__timestamp__)",
        "DAY(__timestamp__)", "DAYOFWEEK(__timestamp__)", "TIMESTAMP___timestamp__")


@query("asof_last_event")
def q_asof_last_event(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    left = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = ev.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"),
        F.col("value").alias("view_value"))
    return E.asof_join(left, right, "user_id", "ts", "view_ts", ["view_id", "view_value"])


@query("entity_filter")
def q_entity_filter(spark, sf_dir):
    """E4 with a data-derived id frame: orders of customers in the BUILDING segment."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("__id"), "o_orderkey",
                                                       "o_totalprice")
    ids = read_table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return E.entity_filter(orders, ids)


# ---------------------------------------------------------------- group G


def _churn_target(spark, sf_dir):
    return L.user_churn(AD.shop(spark, sf_dir), anchors_for(spark, sf_dir, "shop"), H)


def _customer_features(spark, sf_dir, cfg, names=None, target=None, rounded=None):
    rdb = AD.tpch(spark, sf_dir)
    specs = G.enumerate_features(rdb.schema, "customer", cfg)
    if names is not None:
        specs = [s for s in specs if s.name in names]
    tgt = target if target is not None else _churn_target(spark, sf_dir)
    out = G.compute_features(rdb, tgt, "customer", anchors_for(spark, sf_dir, "shop"), cfg, specs, few=True)
    return (rounded or _round_doubles)(out)


def _round_doubles(df):
    return df.select(*[F.round(F.col(f"`{f.name}`"), 4).alias(f.name) if f.dataType.simpleString() in ("double", "float")
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def _cfg(**kw):
    return G.DfsConfig(**{"max_depth": 1, "include_entities": ("orders",), **kw})


def _round_apart(df):
    """Rounding for the comparison with SQL: means of cents over 8 or 16 rows lie exactly between two steps, where the
    order of a sum decides; a shift far above its error and far below a step settles them alike on both sides."""
    return df.select(*[F.round(F.col(f"`{f.name}`") + F.lit(1e-7), 4).alias(f.name) if f.dataType.simpleString() in ("double", "float")
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


@query("dfs_count_sum_mean")
def q_dfs_count_sum_mean(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("count", "sum", "mean")))


@query("dfs_min_max")
def q_dfs_min_max(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("min", "max")))


@query("dfs_std")
def q_dfs_std(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("std",)))


@query("dfs_mode")
def q_dfs_mode(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("mode",)))


@query("dfs_time_since_last")
def q_dfs_time_since_last(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("time_since_last",)))


@query("dfs_where")
def q_dfs_where(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=(), interesting_values={
        "orders.o_orderstatus": ["F", "O", "P"]}))


@query("dfs_lookback")
def q_dfs_lookback(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("count", "sum"),
                                                  lookback=dt.timedelta(days=365)))


@query("dfs_no_cutoff")
def q_dfs_no_cutoff(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("count", "max"), use_cutoff_time=False))


DEPTH2 = ["COUNT(orders)", "MEAN(orders.COUNT(lineitem))", "MAX(orders.COUNT(lineitem))",
          "SUM(orders.SUM(lineitem.l_quantity))", "MEAN(orders.MAX(lineitem.l_extendedprice))"]


@query("dfs_depth2")
def q_dfs_depth2(spark, sf_dir):
    cfg = G.DfsConfig(max_depth=2, include_entities=("orders", "lineitem"),
                      agg_primitives=("count", "sum", "max"))
    return _customer_features(spark, sf_dir, cfg, DEPTH2)


DEPTH3 = ["MEAN(orders.SUM(lineitem.part.p_retailprice))", "MAX(orders.MEAN(lineitem.l_discount))",
          "SUM(orders.COUNT(lineitem))"]


@query("dfs_depth3")
def q_dfs_depth3(spark, sf_dir):
    cfg = G.DfsConfig(max_depth=3, include_entities=("orders", "lineitem", "part"),
                      agg_primitives=("count", "sum", "mean"))
    return _customer_features(spark, sf_dir, cfg, DEPTH3)


@query("dfs_depth2_all")
def q_dfs_depth2_all(spark, sf_dir):
    """Every feature that the enumeration finds at depth 2."""
    cfg = G.DfsConfig(max_depth=2, include_entities=("orders", "lineitem"), agg_primitives=("count", "sum", "max"))
    return _customer_features(spark, sf_dir, cfg, rounded=_round_apart)


@query("dfs_depth3_all")
def q_dfs_depth3_all(spark, sf_dir):
    """Every feature that the enumeration finds at depth 3."""
    cfg = G.DfsConfig(max_depth=3, include_entities=("orders", "lineitem", "part"), agg_primitives=("count", "sum", "mean"))
    return _customer_features(spark, sf_dir, cfg, rounded=_round_apart)


@query("dfs_where_values")
def q_dfs_where_values(spark, sf_dir):
    """Conditional sums, means and maxima beside the conditional counts."""
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=(), where_primitives=("count", "sum", "mean", "max"),
                                                  interesting_values={"orders.o_orderstatus": ["F", "O"]}), rounded=_round_apart)


@query("dfs_row_cutoffs")
def q_dfs_row_cutoffs(spark, sf_dir):
    """Every event with its own time as cutoff (an external frame, no shared anchors): what its user did before."""
    rdb = AD.forum_b(spark, sf_dir)
    ev = read_table(spark, sf_dir, "events")
    tgt = ev.select("event_id", F.col("user_id").alias("__id"), F.col("ts").cast("timestamp_ntz").alias("__timestamp"))
    cfg = G.DfsConfig(max_depth=1, agg_primitives=("count", "sum", "mean", "min", "max", "std", "time_since_last"))
    return _round_apart(G.compute_features(rdb, tgt, "users", None, cfg))


def _order_targets(rdb):
    return rdb["orders"].select("o_orderkey", F.col("o_custkey").alias("__id"), F.col("o_orderdate").cast("timestamp_ntz").alias("__timestamp"))


@query("dfs_row_lookback")
def q_dfs_row_lookback(spark, sf_dir):
    """The year before each order, from the order's own date."""
    rdb = AD.tpch(spark, sf_dir)
    cfg = _cfg(agg_primitives=("count", "sum", "min", "max", "std"), lookback=dt.timedelta(days=365))
    return _round_apart(G.compute_features(rdb, _order_targets(rdb), "customer", None, cfg))


@query("dfs_row_mode")
def q_dfs_row_mode(spark, sf_dir):
    """G3g / G12: most frequent values before each order."""
    rdb = AD.tpch(spark, sf_dir)
    return G.compute_features(rdb, _order_targets(rdb), "customer", None, _cfg(agg_primitives=("mode",)))


@query("dfs_row_stacked")
def q_dfs_row_stacked(spark, sf_dir):
    """Stacked features, lines and orders both known by each order's own date."""
    rdb = AD.tpch(spark, sf_dir)
    cfg = G.DfsConfig(max_depth=2, include_entities=("orders", "lineitem"), agg_primitives=("count", "sum"), stack_primitives=("sum", "mean", "max"))
    return _round_apart(G.compute_features(rdb, _order_targets(rdb), "customer", None, cfg))


@query("dfs_parent_cutoff")
def q_dfs_parent_cutoff(spark, sf_dir):
    """Order values over each supplier's lines, known only once line and order both exist (a third
    to a half of the lines are older than their order)."""
    rdb = AD.tpch(spark, sf_dir)
    anchors = anchors_for(spark, sf_dir, "shop")
    tgt = expand_created(rdb["supplier"].select(F.col("s_suppkey").alias("__id")), None, anchors, keep_index=False)
    cfg = G.DfsConfig(max_depth=2, include_entities=("lineitem", "orders"),
                      agg_primitives=("count", "sum", "max", "std"))
    specs = [s for s in G.enumerate_features(rdb.schema, "supplier", cfg)
             if s.kind == "agg" and s.column in (None, "l_quantity", "orders.o_totalprice")]
    return _round_doubles(G.compute_features(rdb, tgt, "supplier", anchors, cfg, specs))


@query("dfs_direct")
def q_dfs_direct(spark, sf_dir):
    """Orders at each anchor (creation-based) with their customer's columns."""
    rdb = AD.tpch(spark, sf_dir)
    anchors = anchors_for(spark, sf_dir, "shop")
    tgt = C.creation_candidates(rdb, "orders", anchors).select(F.col("o_orderkey").alias("__id"), "__timestamp")
    cfg = G.DfsConfig(max_depth=1, include_entities=("customer",))
    specs = [s for s in G.enumerate_features(rdb.schema, "orders", cfg) if s.kind == "direct"]
    return _round_doubles(G.compute_features(rdb, tgt, "orders", anchors, cfg, specs))


@query("dfs_multi_key")
def q_dfs_multi_key(spark, sf_dir):
    """Link-label rows keyed (voter=supplier, post=order) get features of both keys."""
    rdb = AD.tpch(spark, sf_dir)
    f = AD.forum_a(spark, sf_dir)
    anchors = anchors_for(spark, sf_dir, "forum_a")
    links = L.link_labels(f["votes"], "UserId", "PostId", "CreationDate", anchors, dt.timedelta(days=30),
                          dst_entities=f["posts"].select("Id", "CreationDate"), dst_time="CreationDate")
    cfg = G.DfsConfig(max_depth=1, agg_primitives=("count",), include_entities=("lineitem",))
    s_specs = G.enumerate_features(rdb.schema, "supplier", cfg)
    o_specs = G.enumerate_features(rdb.schema, "orders", cfg)
    a = G.compute_features(rdb, links, "supplier", anchors, cfg, s_specs)
    a = a.withColumnRenamed("COUNT(lineitem)", "supplier.COUNT(lineitem)")
    tgt = a.withColumnRenamed("__id", "__src").withColumnRenamed("__target_id", "__id")
    b = G.compute_features(rdb, tgt, "orders", anchors, cfg, o_specs, few=True)  # an order has its lines' rows at an anchor
    b = b.withColumnRenamed("COUNT(lineitem)", "post.COUNT(lineitem)")
    return b.withColumnRenamed("__id", "__target_id").withColumnRenamed("__src", "__id")


@query("dfs_array_mean")
def q_dfs_array_mean(spark, sf_dir):
    df = G.array_aggregates(AD.vectors(spark, sf_dir), "grp", "embedding")
    return df.select("grp", *[F.transform(F.col(f"`{c}`"), lambda x: F.round(x, 4)).alias(c)
                              for c in df.columns if c != "grp"])


@query("dfs_parent_aggregate")
def q_dfs_parent_aggregate(spark, sf_dir):
    """What an order's customer had done before the order's own date."""
    rdb = AD.tpch(spark, sf_dir)
    tgt = rdb["orders"].select(F.col("o_orderkey").alias("__id"), F.col("o_orderdate").cast("timestamp_ntz").alias("__timestamp"))
    cfg = G.DfsConfig(max_depth=2, include_entities=("customer", "orders"), direct_aggregates=True,
                      agg_primitives=("count", "sum", "max", "time_since_last", "mode"))
    specs = [s for s in G.enumerate_features(rdb.schema, "orders", cfg) if s.kind == "parent"]
    return _round_apart(G.compute_features(rdb, tgt, "orders", None, cfg, specs))


@query("dfs_parent_at_anchors")
def q_dfs_parent_at_anchors(spark, sf_dir):
    """The same on shared anchors: every order at every anchor from its creation on."""
    rdb = AD.tpch(spark, sf_dir)
    anchors = anchors_for(spark, sf_dir, "shop")
    # dealt out by the key before each row becomes one per anchor, so the join by the key need not move those
    dealt = rdb.with_tables({"orders": rdb["orders"].repartition("o_orderkey")}, rdb.schema)
    tgt = C.creation_candidates(dealt, "orders", anchors).select(F.col("o_orderkey").alias("__id"), "__timestamp")
    cfg = G.DfsConfig(max_depth=2, include_entities=("customer", "orders"), direct_aggregates=True, agg_primitives=("count", "sum"))
    specs = [s for s in G.enumerate_features(rdb.schema, "orders", cfg) if s.kind == "parent"]
    return _round_apart(G.compute_features(rdb, tgt, "orders", anchors, cfg, specs))


@query("dfs_datetime_min_max")
def q_dfs_datetime_min_max(spark, sf_dir):
    """G3d / G3e over datetime columns."""
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=(), datetime_primitives=("min", "max")))


@query("label_link_candidates")
def q_link_candidates(spark, sf_dir):
    """D-10: voters' candidate posts from links of the last week up to the anchor and a seeded draw, labelled a month ahead."""
    f = AD.forum_a(spark, sf_dir)
    voters = f["votes"].groupBy("UserId").agg(F.min("CreationDate").alias("born"))
    return L.link_candidates(f["votes"], "UserId", "PostId", "CreationDate", anchors_for(spark, sf_dir, "forum_a"),
                             dt.timedelta(days=7), dt.timedelta(days=30), voters, f["posts"].select("Id", "CreationDate"))


@query("dfs_array_cutoff")
def q_dfs_array_cutoff(spark, sf_dir):
    """G3j: element-wise means and extremes of the lines' (quantity, price, discount) vectors, per supplier and anchor."""
    rdb = AD.tpch(spark, sf_dir)
    lines = rdb["lineitem"].withColumn("l_vec", F.array("l_quantity", "l_extendedprice", "l_discount"))
    rdb = rdb.with_tables({"lineitem": lines}, rdb.schema.with_table(
        rdb.schema.table("lineitem").with_columns([SC.ColumnSchema("l_vec", SC.ARRAY)])))
    anchors = anchors_for(spark, sf_dir, "shop")
    tgt = expand_created(rdb["supplier"].select(F.col("s_suppkey").alias("__id")), None, anchors, keep_index=False)
    cfg = G.DfsConfig(max_depth=1, include_entities=("lineitem",), agg_primitives=("count",), array_primitives=("mean", "max", "min"))
    out = G.compute_features(rdb, tgt, "supplier", anchors, cfg)
    return out.select(*[F.transform(F.col(f"`{c}`"), lambda x: F.round(x + F.lit(1e-7), 4)).alias(c) if c.startswith("ARRAY") else F.col(f"`{c}`") for c in out.columns])


@query("dfs_num_unique")
def q_dfs_num_unique(spark, sf_dir):
    """Distinct values seen before each anchor, exactly."""
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("num_unique",)))


@query("dfs_num_unique_approx")
def q_dfs_num_unique_approx(spark, sf_dir):
    """Distinct lines of each supplier before each anchor, exactly and by sketches; the sketch must be within five
    standard errors (8 %) of the exact count."""
    rdb = AD.tpch(spark, sf_dir)
    lines = rdb["lineitem"].withColumn("l_part", F.col("l_partkey").cast("string"))
    rdb = rdb.with_tables({"lineitem": lines}, rdb.schema.with_table(rdb.schema.table("lineitem").with_columns([SC.ColumnSchema("l_part", "category")])))
    anchors = anchors_for(spark, sf_dir, "shop")
    out = expand_created(rdb["supplier"].select(F.col("s_suppkey").alias("__id")), None, anchors, keep_index=False)
    name = "NUM_UNIQUE(lineitem.l_part)"
    for approximate, to in ((False, "n_unique"), (True, "sketch")):
        cfg = G.DfsConfig(max_depth=1, include_entities=("lineitem",), agg_primitives=("num_unique",), use_approximate_aggregations=approximate)
        specs = [s for s in G.enumerate_features(rdb.schema, "supplier", cfg) if s.name == name]
        out = G.compute_features(rdb, out, "supplier", anchors, cfg, specs).withColumnRenamed(name, to)
    return out.select("__id", "__timestamp", "n_unique", (F.abs(F.col("sketch") - F.col("n_unique")) <= F.col("n_unique") * 0.08).alias("within"))


@query("dfs_key_mappings")
def q_dfs_key_mappings(spark, sf_dir):
    """Every line with its supplier's and its order's earlier lines, cut off at the line's own date."""
    rdb = AD.tpch(spark, sf_dir)
    lines = rdb["lineitem"].select("l_id", F.col("l_suppkey").alias("who"), F.col("l_orderkey").alias("what"),
                                   F.col("l_shipdate").cast("timestamp_ntz").alias("seen"))
    return _round_apart(G.compute_dfs_features(rdb, lines, {"who": "supplier.s_suppkey", "what": "orders.o_orderkey"}, "seen",
                                               G.DfsConfig(max_depth=1, include_entities=("lineitem",)), {"agg_primitives": ("count", "sum")}))


@query("train_frame_e12")
def q_train_frame_e12(spark, sf_dir):
    """The whole training frame of a churn query: labels known by now, history, time parts and the customer's own columns."""
    shop, rdb = AD.shop(spark, sf_dir), AD.tpch(spark, sf_dir)
    spec = PQ.QuerySpec("customer", lambda r, a: L.user_churn(r, a, H), AD.SHOP_TODAY, sampling_rate=None, horizon_days=H.days, feature_rdb=rdb,
                        dfs=_cfg(agg_primitives=("count", "sum"), trans_primitives=("year", "month", "day", "dayofweek")),
                        entity_columns=("c_nationkey", "c_acctbal", "c_mktsegment"))
    return _round_apart(PQ.training_frame(shop, spec)[0])


@query("entity_as_of_versions")
def q_entity_as_of_versions(spark, sf_dir):
    """Each order with its customer's latest earlier order as the customer's version then (status, price)."""
    orders = read_table(spark, sf_dir, "orders")
    tgt = orders.select("o_orderkey", F.col("o_custkey").alias("__id"), F.col("o_orderdate").cast("timestamp_ntz").alias("__timestamp"))
    versions = orders.select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return E.entity_as_of(tgt, versions, "o_custkey", "o_orderdate", ["price", "status"])


@query("label_sql_text")
def q_label_sql_text(spark, sf_dir):
    """D-12: label code as SQL text: a customer's reviews in the rest of each anchor's month."""
    shop = AD.shop(spark, sf_dir)
    sql = """SELECT t.timestamp AS __timestamp, r.customer_id AS __id, count(*) AS __label
FROM timestamps t JOIN review r ON date_trunc('month', r.review_time) = date_trunc('month', t.timestamp)
WHERE r.review_time > t.timestamp GROUP BY t.timestamp, r.customer_id"""
    return L.run_label_spec(sql, shop.tables, anchors_for(spark, sf_dir, "shop"), spark)


# ---------------------------------------------------------------- sinks


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/relcast-{name}-{uuid.uuid4().hex}"


@query("sink_sorted")
def q_sink_sorted(spark, sf_dir):
    """The churn labels written in order of anchor and customer and read back with their places."""
    path = R.write_sorted(q_user_churn(spark, sf_dir), _folder(spark, "sorted"), ["__timestamp", "__id"])
    return R.read_sorted(spark, path)


@query("sink_task_tables")
def q_sink_task_tables(spark, sf_dir):
    """The three tables of a task read back."""
    paths = R.write_task_tables(q_user_churn(spark, sf_dir), _folder(spark, "tasks"), "customer")
    parts = [spark.read.parquet(p).withColumn("split", F.lit(name)) for name, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


@query("sink_labels_csv")
def q_sink_labels_csv(spark, sf_dir):
    """A frame written as CSV by the prediction sink and read by the label scan."""
    path = R.write_predictions(q_user_churn(spark, sf_dir), _folder(spark, "csv"))
    return R.read_labels_csv(spark, path, label_type="int")


@query("sink_snapshots")
def q_sink_snapshots(spark, sf_dir):
    """Feature snapshots written by time, read back, the latest of each customer before the last anchor."""
    path = _folder(spark, "store")
    R.write_snapshots(_customer_features(spark, sf_dir, _cfg(agg_primitives=("count",))).drop("__label"), path, "customer")
    return E.latest_before(R.read_snapshots(spark, path, "customer"), AD.SHOP_TODAY)


@query("sink_copied_tables")
def q_sink_copied_tables(spark, sf_dir):
    """Entity tables copied, and the orders of the customers in an id file."""
    rdb = AD.tpch(spark, sf_dir)
    folder = _folder(spark, "copy")
    R.copy_tables(rdb, folder)
    ids = rdb["customer"].where("c_mktsegment = 'BUILDING'").select("c_custkey")
    ids.write.option("header", True).csv(f"{folder}/ids")
    wanted = R.read_entity_ids(spark, f"{folder}/ids")
    orders = spark.read.parquet(f"{folder}/orders").withColumn("__id", F.col("o_custkey"))
    return E.entity_filter(orders, wanted).select("__id", "o_orderkey")


# ---------------------------------------------------------------- group F


@query("canonicalize_numeric")
def q_canonicalize_numeric(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    return T.canonicalize_numeric(part, ["p_size", "p_retailprice", "p_brand", "p_type"])


@query("featurize_datetime")
def q_featurize_datetime(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    return T.featurize_datetime(ev, ["ts"], ("year", "month", "day", "hour", "dayofweek"))


@query("normalize_zscore")
def q_normalize_zscore(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return T.normalize_numeric(cust, ["c_acctbal"]).select("c_custkey", r4("c_acctbal"))


@query("drop_redundant")
def q_drop_redundant(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").withColumn("const_col", F.lit(1)).withColumn(
        "null_col", F.lit(None).cast("double")).withColumn("uniq_text", F.col("event_id").cast("string"))
    return T.drop_redundant(ev, text_cols=["uniq_text", "event_type", "props"], keep=["event_id"])


@query("transform_pipeline")
def q_transform_pipeline(spark, sf_dir):
    """Canonicalise, then a user column transform, on the shop RDB."""
    shop = AD.shop(spark, sf_dir)
    pipe = T.Pipeline((T.canonicalize_rdb, T.normalize_amounts()))
    out = pipe(shop)
    return out["product"].select("product_id", r4("price"), r4("price_log"))


# ---------------------------------------------------------------- group H


CNT, SUMP, MEANP = "COUNT(orders)", "SUM(orders.o_totalprice)", "MEAN(orders.o_totalprice)"


def _feature_frame(spark, sf_dir):
    return _customer_features(spark, sf_dir, _cfg(agg_primitives=("count", "sum", "mean")))


@query("impute_median")
def q_impute_median(spark, sf_dir):
    f = _feature_frame(spark, sf_dir)
    pre = M.fit_preprocessor(f, [MEANP], [], scale=False)
    return pre.impute(f).select("__id", "__timestamp", r4(MEANP))


@query("scale_robust")
def q_scale_robust(spark, sf_dir):
    f = _feature_frame(spark, sf_dir)
    pre = M.fit_preprocessor(f, [CNT, SUMP], [], scale=True)
    return pre.transform(f).select("__id", "__timestamp", r4(CNT), r4(SUMP))


@query("metric_auroc")
def q_metric_auroc(spark, sf_dir):
    f = _feature_frame(spark, sf_dir).withColumn("score", -F.col(f"`{CNT}`").cast("double"))
    return M.auroc(f, "__label", "score").select(F.round("auroc", 6).alias("auroc"), "n_pos", "n_neg")


@query("metric_rmse")
def q_metric_rmse(spark, sf_dir):
    """Naive persistence forecast of user LTV: past 91-day spend vs next 91-day spend."""
    shop = AD.shop(spark, sf_dir)
    anchors = anchors_for(spark, sf_dir, "shop")
    labels = L.user_ltv(shop, anchors, H)
    priced = L._priced_reviews(shop)
    past = window_aggregate(priced, ["customer_id"], "review_time", anchors, [Win("p", -H, dt.timedelta(0))],
                            [Agg("s", "sum", "price")]).select(F.col("customer_id").alias("__id"), "__timestamp",
                                                               F.col("p__s").alias("yhat"))
    j = labels.join(past, ["__id", "__timestamp"], "left").fillna({"yhat": 0.0})
    m = M.regression_metrics(j, "__label", "yhat")
    return m.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "n")


@query("metric_accuracy_f1")
def q_metric_accuracy_f1(spark, sf_dir):
    f = _feature_frame(spark, sf_dir).withColumn(
        "pred", F.when(F.col(f"`{CNT}`") <= 3, 1).otherwise(0))
    m = M.accuracy_f1(f, "__label", "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


def _churn_spec(spark, sf_dir, task="classification"):
    shop = AD.shop(spark, sf_dir)
    if task == "classification":
        label_fn = lambda rdb, anchors: L.user_churn(rdb, anchors, H)
    else:
        label_fn = lambda rdb, anchors: L.user_ltv(rdb, anchors, H)
    cfg = G.DfsConfig(max_depth=2, include_entities=("orders", "lineitem"),
                      agg_primitives=("count", "sum", "mean", "max", "time_since_last"),
                      stack_primitives=("mean", "max"))
    spec = PQ.QuerySpec("customer", label_fn, AD.SHOP_TODAY, task, horizon_days=H.days, dfs=cfg,
                        feature_rdb=AD.tpch(spark, sf_dir))
    return shop, spec


@query("predict_churn")
def q_predict_churn(spark, sf_dir):
    """E12 + H4/H6/H8: churn model on sampled labelled anchors, predictions at T for all customers."""
    shop, spec = _churn_spec(spark, sf_dir)
    ans = PQ.answer(shop, spec)
    return M.format_predictions(ans.predictions, "classification", ans.model.n_classes)


@query("predict_ltv")
def q_predict_ltv(spark, sf_dir):
    shop, spec = _churn_spec(spark, sf_dir, "regression")
    ans = PQ.answer(shop, spec)
    return M.format_predictions(ans.predictions, "regression")


@query("explain_top_features")
def q_explain_top_features(spark, sf_dir):
    """Permutation attribution, over all training rows, of the churn prediction of the customer with
    the highest predicted churn probability (ties: smallest id); top 10 features."""
    shop, spec = _churn_spec(spark, sf_dir)
    ans = PQ.answer(shop, spec)
    test = materialize(ans.test)  # searched for the entity, then read for its features
    best = M.format_predictions(M.predict(ans.model, test), "classification").orderBy(
        F.col("y_prob").desc(), F.col("__id")).first()["__id"]
    entity = X.entity_row(test, best)
    return M.top_k_features(X.explain_whole(ans.model, entity, ans.train), 10)


@query("holdout_validation")
def q_holdout_validation(spark, sf_dir):
    """H9: 80/20 hash split of the training features, accuracy on the hold-out."""
    shop, spec = _churn_spec(spark, sf_dir)
    anchors = A.make_anchors(shop, spec.ts_current, horizon=H, data_end=spec.ts_current)
    labels = C.sample_labels(L.user_churn(shop, anchors, H), 0.3)
    train = G.compute_features(spec.feature_rdb, labels, "customer", anchors, spec.dfs, few=True)
    res = M.validate(train, "classification")
    return spark.createDataFrame([res["validation"]])


# ---------------------------------------------------------------- group I and A


@query("top_products")
def q_top_products(spark, sf_dir):
    shop = AD.shop(spark, sf_dir)
    sold = shop["review"].groupBy("product_id").agg(F.count(F.lit(1)).alias("n_sold"))
    sales = sold.join(shop["product"].select("product_id", "price"), "product_id")
    return I.top_n(sales, "product_id", F.col("price") * F.col("n_sold"), 10, "revenue").select(
        "product_id", r4("revenue"))


@query("histogram_acctbal")
def q_histogram_acctbal(spark, sf_dir):
    return I.histogram(read_table(spark, sf_dir, "customer"), "c_acctbal", 10)


@query("engagement_trend")
def q_engagement_trend(spark, sf_dir):
    return I.trend(read_table(spark, sf_dir, "events"), "ts", "day", ["event_type"])


@query("pivot_status")
def q_pivot_status(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate"))
    return I.pivot_counts(o, "yr", "o_orderstatus", ["F", "O", "P"])


@query("corr_price_quantity")
def q_corr_price_quantity(spark, sf_dir):
    c = I.correlation(read_table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")
    return c.select(F.round(c.columns[0], 6).alias(c.columns[0]))


@query("latest_order")
def q_latest_order(spark, sf_dir):
    return I.latest_row(read_table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@query("predictions_by_segment")
def q_predictions_by_segment(spark, sf_dir):
    shop, spec = _churn_spec(spark, sf_dir)
    ans = PQ.answer(shop, spec)
    pred = M.format_predictions(ans.predictions, "classification")
    return I.aggregate_predictions(pred, shop["customer"], "customer_id", "segment")


@query("rank_predictions")
def q_rank_predictions(spark, sf_dir):
    shop, spec = _churn_spec(spark, sf_dir)
    pred = M.format_predictions(PQ.answer(shop, spec).predictions, "classification")
    return I.rank_predictions(pred, 10)


@query("table_profile")
def q_table_profile(spark, sf_dir):
    """A15 over every table and column: least and greatest value as a number (floating columns) or as text (others)."""
    floating = F.col("dtype").isin("double", "float")
    prof = R.table_profile(R.load_rdb(spark, sf_dir, tables=ALL_TABLES))

    def number(c):
        return F.when(floating, F.round(F.expr(f"try_cast({c} AS double)"), 4))

    def text(c):
        return F.when(~floating, F.col(c))
    return prof.select("table_name", "n_rows", "column_name", "non_null",
                       number("min_value").alias("min_number"), number("max_value").alias("max_number"),
                       text("min_value").alias("min_text"), text("max_value").alias("max_text"))


@query("feature_columns")
def q_feature_columns(spark, sf_dir):
    """Orders under a composite row key, without keys and time column."""
    rdb = AD.tpch(spark, sf_dir)
    keyed = R.with_row_index(rdb["orders"], "row_key", ["o_custkey", "o_orderkey"])
    return R.drop_excluded(keyed, rdb.schema.table("orders")).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("trans_primitives")
def q_trans_primitives(spark, sf_dir):
    """Time parts of each event's own time."""
    ev = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return G.transform_features(ev, "ts")


@query("relationship_integrity")
def q_relationship_integrity(spark, sf_dir):
    return R.key_integrity(AD.tpch(spark, sf_dir))


# ---------------------------------------------------------------- streaming

@query("stream_activity_counts")
def q_stream_activity_counts(spark, sf_dir):
    """Per (user, anchor) click count and value sum up to the anchor, maintained by a
    Structured Streaming job over the events files (forum-B anchors)."""
    import os as _os
    from .streaming.incremental import streamed_cumulative
    schema = spark.read.parquet(_os.path.join(sf_dir, "events.parquet")).schema
    out = streamed_cumulative(spark, sf_dir, schema, ["user_id"], "ts", anchors_for(spark, sf_dir, "forum_b"),
                              [Agg("n_clicks", "count"), Agg("sum_value", "sum", "value")],
                              where="event_type = 'click'", file_glob="events.parquet")
    return out.select("user_id", "__timestamp", "n_clicks", r4("sum_value"))


@query("stream_late_events")
def q_stream_late_events(spark, sf_dir):
    """The same aggregates from eight files, latest times first, one file a batch: events arrive
    months late, in batches that know nothing of each other."""
    import os as _os
    import uuid as _uuid
    from .session import ensure_checkpoint_dir
    from .streaming.incremental import streamed_cumulative
    events = read_table(spark, sf_dir, "events")
    files = _os.path.join(ensure_checkpoint_dir(spark), "relcast-late-" + _uuid.uuid4().hex)
    events.repartitionByRange(8, F.col("ts").desc()).write.parquet(files)
    out = streamed_cumulative(spark, files, events.schema, ["user_id"], "ts", anchors_for(spark, sf_dir, "forum_b"),
                              [Agg("n_clicks", "count"), Agg("sum_value", "sum", "value")],
                              where="event_type = 'click'", files_per_batch=1)
    return out.select("user_id", "__timestamp", "n_clicks", r4("sum_value"))


# ---------------------------------------------------------------- more B / D / E / H

@query("cached_anchors")
def q_cached_anchors(spark, sf_dir):
    """Distinct snapshot times strictly before T from the review snapshots."""
    snap = _review_snapshots(spark, sf_dir)
    return A.cached_anchors(snap, AD.SHOP_TODAY)


@query("anchors_censored")
def q_anchors_censored(spark, sf_dir):
    """Anchors whose 91-day label window ends inside the data (data end = T)."""
    return A.anchors_plan(AD.shop(spark, sf_dir), AD.SHOP_TODAY, horizon=H, data_end=AD.SHOP_TODAY)


def user_churn_code(tables: dict, anchors: list) -> DataFrame:
    """A user label function (D-12 callable form): customers active in the 91 days
    up to t, label 1 when they write no review in the next 91 days."""
    return L.forward_label(tables["review"], "customer_id", "review_time", anchors, H,
                           agg="not_exists", entities=tables["customer"], entity_key="customer_id")


@query("label_user_code")
def q_label_user_code(spark, sf_dir):
    """D-12/D-13: user label code run against the RDB tables and the anchor list."""
    shop = AD.shop(spark, sf_dir)
    return L.run_label_spec(user_churn_code, shop.tables, anchors_for(spark, sf_dir, "shop"), spark)


@query("split_by_time")
def q_split_by_time(spark, sf_dir):
    """Churn labels tagged train / validation / test by anchor time."""
    labels = L.user_churn(AD.shop(spark, sf_dir), anchors_for(spark, sf_dir, "shop"), H)
    return E.split_by_time(labels, dt.datetime(2000, 12, 31), dt.datetime(2001, 4, 30))


@query("predict_batch")
def q_predict_batch(spark, sf_dir):
    """H7: model on (snapshot features x churn labels); ids = every customer; latest
    snapshot before T, realigned, scored; ids without history keep a NULL prediction."""
    from .operators.predictive import predict_batch
    shop = AD.shop(spark, sf_dir)
    snap = _review_snapshots(spark, sf_dir)
    known = A.censor_filter(anchors_for(spark, sf_dir, "shop"), H, AD.SHOP_TODAY)
    labels = L.user_churn(shop, known, H)
    train = E.label_feature_join(snap, C.sample_labels(labels, 0.3))
    fm = M.fit(train, "classification")
    ids = shop["customer"].select(F.col("customer_id").alias("__id"))
    return predict_batch(fm, snap, ids, AD.SHOP_TODAY)


ADHOC_SQL = """
SELECT c.c_mktsegment AS segment, count(DISTINCT o.o_custkey) AS n_customers,
       count(*) AS n_orders, round(sum(o.o_totalprice), 4) AS revenue
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderstatus = 'F'
GROUP BY c.c_mktsegment
"""


@query("adhoc_sql")
def q_adhoc_sql(spark, sf_dir):
    """Ad-hoc SQL over the RDB tables registered as views."""
    return AD.tpch(spark, sf_dir).sql(ADHOC_SQL)
