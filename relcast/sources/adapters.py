"""Adapters from the generated TPC-H-like tables to the relational shapes the
predictive tasks are written for (shop, forum-A, forum-B, vectors).

All adapters are projections / filters / one equi-join over the given tables,
so their work grows with the data.  Time columns are normalised to
``timestamp_ntz``.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import schema as S
from .rdb import Rdb

# Fixed task constants of the adapted datasets.
SHOP_TODAY = dt.datetime(2001, 8, 1)
FORUM_B_TODAY = dt.datetime(2024, 1, 31)
HORIZON = dt.timedelta(days=365 // 4)   # 91 days
FORUM_B_HORIZON = dt.timedelta(days=7)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _ntz(c: str) -> F.Column:
    return F.col(c).cast("timestamp_ntz")


SHOP_SCHEMA = S.RdbSchema((
    S.TableSchema("customer", (
        S.ColumnSchema("customer_id", S.PRIMARY_KEY),
        S.ColumnSchema("customer_name", "text"),
        S.ColumnSchema("segment", "category"),
        S.ColumnSchema("balance", "float"))),
    S.TableSchema("product", (
        S.ColumnSchema("product_id", S.PRIMARY_KEY),
        S.ColumnSchema("category", "category"),
        S.ColumnSchema("brand", "category"),
        S.ColumnSchema("title", "text"),
        S.ColumnSchema("price", "float"))),
    S.TableSchema("review", (
        S.ColumnSchema("review_time", S.DATETIME),
        S.ColumnSchema("customer_id", S.FOREIGN_KEY, "customer.customer_id"),
        S.ColumnSchema("product_id", S.FOREIGN_KEY, "product.product_id"),
        S.ColumnSchema("rating", "float"),
        S.ColumnSchema("verified", "float")), time_column="review_time"),
))


def shop(spark: SparkSession, sf_dir: str) -> Rdb:
    """customer <- review -> product; review = orders JOIN lineitem on the order key."""
    customer = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    product = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lineitem = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    review = orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey).select(
        _ntz("o_orderdate").alias("review_time"), F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("rating"),
        F.col("l_discount").alias("verified"))
    return Rdb(spark, {"customer": customer, "product": product, "review": review}, SHOP_SCHEMA)


FORUM_A_SCHEMA = S.RdbSchema((
    S.TableSchema("users", (S.ColumnSchema("Id", S.PRIMARY_KEY),
                            S.ColumnSchema("Segment", "category"))),
    S.TableSchema("posts", (
        S.ColumnSchema("Id", S.PRIMARY_KEY),
        S.ColumnSchema("OwnerUserId", S.FOREIGN_KEY, "users.Id"),
        S.ColumnSchema("PostTypeId", "category"),
        S.ColumnSchema("Score", "float"),
        S.ColumnSchema("CreationDate", S.DATETIME)), time_column="CreationDate"),
    S.TableSchema("votes", (
        S.ColumnSchema("Id", S.PRIMARY_KEY),
        S.ColumnSchema("PostId", S.FOREIGN_KEY, "posts.Id"),
        S.ColumnSchema("UserId", S.FOREIGN_KEY, "users.Id"),
        S.ColumnSchema("VoteTypeId", "category"),
        S.ColumnSchema("Weight", "float"),
        S.ColumnSchema("CreationDate", S.DATETIME)), time_column="CreationDate"),
))

VOTE_ID_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def vote_id(prefix: str = "") -> F.Column:
    """Unique composite vote id, built before any join (concat_ws skips nulls)."""
    return F.concat_ws("-", *[F.col(prefix + c).cast("string") for c in VOTE_ID_COLS],
                       F.unix_seconds(F.col(prefix + "l_shipdate").cast("timestamp")).cast("string"))


def forum_a(spark: SparkSession, sf_dir: str) -> Rdb:
    """posts = orders, votes = lineitem (post = order, voter = supplier)."""
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"),
                                                   F.col("c_mktsegment").alias("Segment"))
    posts = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Id"), F.col("o_custkey").alias("OwnerUserId"),
        F.col("o_orderstatus").alias("PostTypeId"), F.col("o_totalprice").alias("Score"),
        _ntz("o_orderdate").alias("CreationDate"))
    votes = read(spark, sf_dir, "lineitem").select(
        vote_id().alias("Id"), F.col("l_orderkey").alias("PostId"),
        F.col("l_suppkey").alias("UserId"), F.col("l_returnflag").alias("VoteTypeId"),
        F.col("l_quantity").alias("Weight"), _ntz("l_shipdate").alias("CreationDate"))
    return Rdb(spark, {"users": users, "posts": posts, "votes": votes}, FORUM_A_SCHEMA)


FORUM_B_SCHEMA = S.RdbSchema((
    S.TableSchema("users", (S.ColumnSchema("Id", S.PRIMARY_KEY),
                            S.ColumnSchema("CreationDate", S.DATETIME)), time_column="CreationDate"),
    S.TableSchema("posts", (S.ColumnSchema("Id", S.PRIMARY_KEY),
                            S.ColumnSchema("OwnerUserId", S.FOREIGN_KEY, "users.Id"),
                            S.ColumnSchema("Value", "float"),
                            S.ColumnSchema("CreationDate", S.DATETIME)), time_column="CreationDate"),
    S.TableSchema("votes", (S.ColumnSchema("Id", S.PRIMARY_KEY),
                            S.ColumnSchema("UserId", S.FOREIGN_KEY, "users.Id"),
                            S.ColumnSchema("Value", "float"),
                            S.ColumnSchema("CreationDate", S.DATETIME)), time_column="CreationDate"),
    S.TableSchema("comments", (S.ColumnSchema("Id", S.PRIMARY_KEY),
                               S.ColumnSchema("UserId", S.FOREIGN_KEY, "users.Id"),
                               S.ColumnSchema("Value", "float"),
                               S.ColumnSchema("CreationDate", S.DATETIME)), time_column="CreationDate"),
    S.TableSchema("badges", (S.ColumnSchema("Id", S.PRIMARY_KEY),
                             S.ColumnSchema("UserId", S.FOREIGN_KEY, "users.Id"),
                             S.ColumnSchema("Value", "float"),
                             S.ColumnSchema("Date", S.DATETIME)), time_column="Date"),
))

FORUM_B_TYPES = {"posts": "view", "votes": "click", "comments": "error", "badges": "purchase"}


def forum_b(spark: SparkSession, sf_dir: str) -> Rdb:
    """users = first signup per user; posts / votes / comments / badges = events by type."""
    ev = read(spark, sf_dir, "events")
    users = (ev.where(F.col("event_type") == "signup").groupBy("user_id")
             .agg(F.min(_ntz("ts")).alias("CreationDate"))
             .select(F.col("user_id").alias("Id"), "CreationDate"))
    tables = {"users": users}
    for name, etype in FORUM_B_TYPES.items():
        user_col = "OwnerUserId" if name == "posts" else "UserId"
        time_col = "Date" if name == "badges" else "CreationDate"
        tables[name] = ev.where(F.col("event_type") == etype).select(
            F.col("event_id").alias("Id"), F.col("user_id").alias(user_col),
            F.col("value").alias("Value"), _ntz("ts").alias(time_col))
    return Rdb(spark, tables, FORUM_B_SCHEMA)


TPCH_SCHEMA = S.RdbSchema((
    S.TableSchema("customer", (
        S.ColumnSchema("c_custkey", S.PRIMARY_KEY), S.ColumnSchema("c_name", "text"),
        S.ColumnSchema("c_nationkey", "category"), S.ColumnSchema("c_acctbal", "float"),
        S.ColumnSchema("c_mktsegment", "category"))),
    S.TableSchema("orders", (
        S.ColumnSchema("o_orderkey", S.PRIMARY_KEY),
        S.ColumnSchema("o_custkey", S.FOREIGN_KEY, "customer.c_custkey"),
        S.ColumnSchema("o_orderstatus", "category"), S.ColumnSchema("o_totalprice", "float"),
        S.ColumnSchema("o_orderdate", S.DATETIME), S.ColumnSchema("o_orderpriority", "category")),
        time_column="o_orderdate"),
    S.TableSchema("lineitem", (
        S.ColumnSchema("l_id", S.PRIMARY_KEY),
        S.ColumnSchema("l_orderkey", S.FOREIGN_KEY, "orders.o_orderkey"),
        S.ColumnSchema("l_partkey", S.FOREIGN_KEY, "part.p_partkey"),
        S.ColumnSchema("l_suppkey", S.FOREIGN_KEY, "supplier.s_suppkey"),
        S.ColumnSchema("l_quantity", "float"), S.ColumnSchema("l_extendedprice", "float"),
        S.ColumnSchema("l_discount", "float"), S.ColumnSchema("l_returnflag", "category"),
        S.ColumnSchema("l_shipdate", S.DATETIME)), time_column="l_shipdate"),
    S.TableSchema("part", (
        S.ColumnSchema("p_partkey", S.PRIMARY_KEY), S.ColumnSchema("p_brand", "category"),
        S.ColumnSchema("p_type", "category"), S.ColumnSchema("p_size", "int"),
        S.ColumnSchema("p_retailprice", "float"))),
    S.TableSchema("supplier", (
        S.ColumnSchema("s_suppkey", S.PRIMARY_KEY), S.ColumnSchema("s_nationkey", "category"),
        S.ColumnSchema("s_acctbal", "float"))),
))


def tpch(spark: SparkSession, sf_dir: str) -> Rdb:
    """The generated tables themselves with declared keys (lineitem gets a composite PK)."""
    t = {}
    for ts in TPCH_SCHEMA.tables:
        df = read(spark, sf_dir, ts.name)
        if ts.name == "lineitem":
            df = df.withColumn("l_id", vote_id())
        for c in ts.columns:
            if c.dtype == S.DATETIME:
                df = df.withColumn(c.name, _ntz(c.name))
        t[ts.name] = df.select(*ts.column_names)
    return Rdb(spark, t, TPCH_SCHEMA)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item(vec_id, group, embedding) from the embeddings table."""
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("grp"), "embedding")
