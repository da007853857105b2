"""Bindings from the driver's parquet tables to the recommender's data model.

Each binding is a lazy DataFrame over the parquet scan, so Catalyst prunes
columns and pushes filters into the reader. The matching DuckDB SQL for each
binding lives in ``affinity.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# Deterministic train/test split rule and rating rule over line items.
SPLIT_MULTIPLIER = 31
SPLIT_MODULUS = 5
RATING_LEVELS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _order_lines(spark: SparkSession, sf_dir: str, item_col: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", item_col, "l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B_int: distinct (customer, part) purchase interactions."""
    return (_order_lines(spark, sf_dir, "l_partkey")
            .select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
            .distinct())


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B_sup_raw: (customer, supplier) per line item, duplicates kept."""
    return (_order_lines(spark, sf_dir, "l_suppkey")
            .select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")))


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B_evt: (user_id, props.k) from the event stream, duplicates kept."""
    ev = table(spark, sf_dir, "events").select("user_id", "props")
    return ev.select(F.col("user_id").alias("user"),
                     F.get_json_object("props", "$.k").cast("int").cast("bigint").alias("item"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B_rat: (customer, part, rating 1..5) with rating = 1 + quantity mod 5, max per pair."""
    lines = _order_lines(spark, sf_dir, "l_partkey")
    rating = (F.lit(1) + F.pmod(F.col("l_quantity").cast("int"), F.lit(RATING_LEVELS)))
    return (lines.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
            .agg(F.max(rating).cast("double").alias("rating")))


def _is_test(df: DataFrame) -> "F.Column":
    return F.pmod(F.col("user") * SPLIT_MULTIPLIER + F.col("item"), F.lit(SPLIT_MODULUS)) == 0


def split_ratings(rat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split of every rating (nothing dropped)."""
    return rat.filter(~_is_test(rat)), rat.filter(_is_test(rat))


def train_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_ratings(ratings(spark, sf_dir))[0]


def test_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_ratings(ratings(spark, sf_dir))[1]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B_emb: (id, vec ARRAY<DOUBLE>)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("vec"))


def item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B_set: each customer's sorted set of purchased part ids (ARRAY<INT>)."""
    return (purchases(spark, sf_dir)
            .groupBy("user")
            .agg(F.array_sort(F.collect_set(F.col("item").cast("int"))).alias("idx"))
            .withColumnRenamed("user", "id"))


def part_count(spark: SparkSession, sf_dir: str) -> int:
    """Dimension of the set vectors (largest part id + 1)."""
    return int(table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]) + 1


def part_dim(spark: SparkSession, sf_dir: str):
    """Set-vector dimension as a lazy scalar subquery column (max part id + 1)."""
    return table(spark, sf_dir, "part").select((F.max("p_partkey") + 1).cast("int")).scalar()
