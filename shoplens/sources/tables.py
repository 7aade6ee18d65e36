"""The given parquet tables, mapped onto the commerce data model.

Mapping (test table -> concept):
  part                  -> product catalogue (p_type is the category)
  distinct p_type       -> category table (id = xxhash64 of the name)
  orders x lineitem     -> explicit ratings (quantity 1-50 -> rating 1-5)
  events                -> user actions (product = props.k)
  documents             -> reviews (user, product and rating derived from doc_id)
  customer/nation/region-> user regions

Every reader selects only the columns it needs, so the parquet scan prunes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.scalars import round_half_up

# --- fixed values: test-data mapping parameters -------------------------------
REVIEW_USERS = 150          # review user = doc_id % 150
REVIEW_PRODUCTS = 100       # review product = doc_id % 100
REVIEW_RATINGS = 5          # review rating = 1 + doc_id % 5
REVIEW_EPOCH = "2024-01-01 00:00:00"   # review time = epoch + doc_id minutes
REVIEW_SOURCE_NAME = "documents"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def line_rating(quantity) -> F.Column:
    """Quantity 1-50 mapped to a 1-5 rating."""
    return F.lit(1) + F.floor((quantity - F.lit(1)) / F.lit(10))


def category_id(name) -> F.Column:
    return F.xxhash64(name)


def products_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows as a CSV would deliver them (every column text).

    stars and reviews come from the order lines of each part (mean line rating,
    number of lines).  The test tables carry no image, URL, best-seller or
    bought-last-month data; those columns are null.
    """
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_retailprice"])
    stats = (read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity"])
             .groupBy("l_partkey")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.avg(line_rating(F.col("l_quantity"))).alias("mean_rating")))
    joined = part.join(stats, part.p_partkey == stats.l_partkey, "left")
    null = F.lit(None).cast("string")
    return joined.select(
        F.col("p_partkey").cast("string").alias("asin"),
        F.col("p_name").alias("title"),
        null.alias("imgUrl"),
        null.alias("productURL"),
        round_half_up(F.col("mean_rating"), 1).cast("string").alias("stars"),
        F.col("n_lines").cast("string").alias("reviews"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.col("p_retailprice").cast("string").alias("listPrice"),
        category_id(F.col("p_type")).cast("string").alias("category_id"),
        null.alias("isBestSeller"),
        null.alias("boughtInLastMonth"),
    )


def categories_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per category: (id, category_name)."""
    return (read_table(spark, sf_dir, "part", ["p_type"]).distinct()
            .select(category_id(F.col("p_type")).alias("id"), F.col("p_type").alias("category_name")))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit ratings (user_id, asin, rating, timestamp): mean line rating per
    (customer, part), time of the latest order."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"])
    j = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return (j.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("part"))
            .agg(F.avg(line_rating(F.col("l_quantity"))).cast("float").alias("rating"),
                 F.max("o_orderdate").alias("timestamp"))
            .select("user_id", F.col("part").cast("string").alias("asin"), "rating", "timestamp"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User actions in the ACTION schema, from ``events``."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("product_id"),
        F.col("event_type").alias("action"),
        F.col("ts").alias("timestamp"),
        F.lit("events").alias("source"),
        F.lit(None).cast("double").alias("original_rating"),
        F.lit(None).cast("double").alias("confidence"),
    )


def events_with_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions plus the event's money value (used as order value for purchases)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.select(
        F.col("event_id"), F.col("ts").alias("timestamp"), F.col("user_id"),
        F.col("event_type").alias("action"), F.col("value"),
        F.get_json_object("props", "$.k").alias("product_id"))


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows as a review CSV would hold them, plus their row index.

    Columns: row_index, user_id, product_id, rating (text), text, lang, source,
    n_chars, review_date.
    """
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    return docs.select(
        F.col("doc_id").alias("row_index"),
        (F.col("doc_id") % REVIEW_USERS).alias("user_id"),
        (F.col("doc_id") % REVIEW_PRODUCTS).alias("product_id"),
        (F.lit(1) + F.col("doc_id") % REVIEW_RATINGS).cast("string").alias("rating"),
        F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars"),
        F.timestamp_add("MINUTE", F.col("doc_id"),
                        F.lit(REVIEW_EPOCH).cast("timestamp_ntz")).alias("review_date"),
    )


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, nation, region) from customer x nation x region; the optimizer
    broadcasts the small dimensions by their measured bytes."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return (cust.join(geo, cust.c_nationkey == geo.n_nationkey)
            .select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("nation"),
                    F.col("r_name").alias("region")))
