"""Counted sets: relations (key, count, label) with one row a key and counts above zero.

Building is one hash aggregation with map-side combination; every change of a set is an
aggregation of the changes and one equi-join on the key, so all of them shuffle by key alone and
work on bucketed tables without any shuffle.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions.expressions import key_in_range
from countloom.plans.spec import FilterSpec

SCHEMA = "key bigint, count bigint, label bigint"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def saturated(count: Column, spec: FilterSpec | None) -> Column:
    return count if spec is None or spec.maximum_count is None else F.least(count, F.lit(spec.maximum_count))


def _key(key: str, spec: FilterSpec | None, policy: str | None = None) -> Column:
    """A key as it is stored: in the spec's range, by its policy."""
    return F.col(key).cast("bigint") if spec is None else key_in_range(key, spec, policy=policy)


def build(rows: DataFrame, spec: FilterSpec | None = None, *, key: str = "key", n: str | Column | None = None, policy: str | None = None) -> DataFrame:
    """Count items: rows of (key, n) that may repeat; n defaults to 1 and counts of 0 leave no row."""
    own = _key(key, spec, policy)
    times = F.lit(1) if n is None else F.col(n) if isinstance(n, str) else n
    counted = rows.select(own.alias("key"), times.cast("bigint").alias("n")).filter("key is not null and n > 0")
    total = saturated(F.sum("n"), spec)
    return counted.groupBy("key").agg(total.alias("count")).withColumn("label", F.lit(0).cast("bigint"))


def insert(cs: DataFrame, rows: DataFrame, spec: FilterSpec | None = None, **how) -> DataFrame:
    """The set after adding rows; labels stay, and new keys have none."""
    both = cs.unionByName(build(rows, spec, **how))
    return both.groupBy("key").agg(saturated(F.sum("count"), spec).alias("count"), F.max("label").alias("label"))


def remove(cs: DataFrame, rows: DataFrame, spec: FilterSpec | None = None, *, key: str = "key", n: str | None = None, clear_label: bool = True) -> DataFrame:
    """The set after taking n of each key, down to none; a key that something was taken from loses its label."""
    whole = None if spec is None else replace(spec, maximum_count=None)
    less = build(rows, whole, key=key, n=n).select("key", F.col("count").alias("n"))
    left = F.col("count") - F.coalesce("n", F.lit(0))
    label = F.when(F.col("n").isNull(), F.col("label")).otherwise(0) if clear_label else F.col("label")
    return cs.join(less, "key", "left").filter(left > 0).select("key", left.alias("count"), label.cast("bigint").alias("label"))


def set_counts(cs: DataFrame, rows: DataFrame, spec: FilterSpec | None = None, *, key: str = "key", n: str = "n") -> DataFrame:
    """The set after assigning counts; 0 deletes; of several for one key the largest holds."""
    new = rows.groupBy(_key(key, spec).alias("key")).agg(F.max(F.col(n).cast("bigint")).alias("n")).filter("key is not null")
    joined = cs.join(new, "key", "full_outer")
    label = F.when(F.col("n") < F.col("count"), 0).otherwise(F.coalesce("label", F.lit(0)))
    return joined.select("key", saturated(F.coalesce("n", "count"), spec).alias("count"), label.cast("bigint").alias("label")).filter("count > 0")


def replace_label(cs: DataFrame, old: int, new: int) -> DataFrame:
    """Every association with one label moved to another."""
    return cs.withColumn("label", F.when(F.col("label") == old, new).otherwise(F.col("label")).cast("bigint"))


def count_key(cs: DataFrame, key: int, spec: FilterSpec | None = None) -> int:
    """Count of one key; 0 if absent.  The filter reaches the scan of a stored set."""
    row = cs.filter(F.col("key") == (key if spec is None else spec.reduce(key))).select("count").first()
    return row["count"] if row else 0


def query(cs: DataFrame, keys: DataFrame, spec: FilterSpec | None = None, *, key: str = "key") -> DataFrame:
    """(key, count, label) of the distinct keys asked for, zeros for absent ones."""
    asked = keys.select(_key(key, spec).alias("key")).filter("key is not null").distinct()
    return asked.join(cs, "key", "left").select("key", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.coalesce("label", F.lit(0)).cast("bigint").alias("label"))


def batch_query(cs: DataFrame, batch: DataFrame, spec: FilterSpec | None = None, *, key: str = "key") -> DataFrame:
    """(key, count) of the batch's keys that the set holds."""
    return batch.select(_key(key, spec).alias("key")).distinct().join(cs.select("key", "count"), "key")


def singletons(cs: DataFrame) -> DataFrame:
    """The layer of items counted once."""
    return cs.filter("count = 1")


def repeated(cs: DataFrame) -> DataFrame:
    """The layer of items counted more than once."""
    return cs.filter("count > 1")


def histogram(cs: DataFrame) -> DataFrame:
    """(count, n): how many keys have each count."""
    return cs.groupBy("count").agg(F.count("*").alias("n"))


def heavy_hitters(cs: DataFrame, k: int) -> DataFrame:
    """The k keys of largest count; ties go to smaller keys.  Each task keeps k rows."""
    return cs.orderBy(F.desc("count"), "key").limit(k)


def totals(cs: DataFrame) -> DataFrame:
    """One row: distinct keys, all items, singletons."""
    once = F.sum(F.when(F.col("count") == 1, 1).otherwise(0))
    return cs.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce(once, F.lit(0)).cast("bigint").alias("n_once"))
