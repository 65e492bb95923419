"""Work in key order without one task for all: ranges of about equal size, and one row a range for what crosses them."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should have, and ranges at most.
ROWS, MOST = 1_000_000, 16_384


def settled(df: DataFrame) -> DataFrame:
    """The rows written once, to the session's checkpoint folder, where there is one; else as they are."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df


def with_ranges(df: DataFrame, order: Column, *, ranges: int | None = None) -> DataFrame:
    """Adds part: the number of a row's range in the order.  Ranges are cut at quantiles, as many as the rows need.

    The rows are settled first: counting them, the quantiles, what is summed up a range and the result all read what is written.
    """
    own = settled(df.withColumn("part_value", order.cast("double")))
    df = own.drop("part_value")
    if ranges is None:
        ranges = max(1, min(MOST, -(-df.count() // ROWS)))
    cuts = own.approxQuantile("part_value", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        return df.withColumn("part", F.lit(0))
    # rounding to double keeps the order, so equal values and the rows between them stay together
    return Bucketizer(splits=splits, inputCol="part_value", outputCol="part").transform(own).drop("part_value").withColumn("part", F.col("part").cast("int"))


def before(totals: DataFrame, value: str, alias: str) -> DataFrame:
    """(part, alias): the sum over all earlier ranges, from one row a range."""
    window = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum(value).over(window), F.lit(0)).cast("bigint").alias(alias))


def ranked(df: DataFrame, order: Column, *, ranges: int | None = None) -> DataFrame:
    """Adds rank: the 0-based place in the order; of equal values any comes first."""
    own = df.columns
    rows = with_ranges(df.withColumn("order_value", order), F.col("order_value"), ranges=ranges)
    base = before(rows.groupBy("part").agg(F.count("*").alias("n")), "n", "base")
    place = F.row_number().over(Window.partitionBy("part").orderBy("order_value")) - 1
    # one row a range
    return rows.withColumn("place", place).join(F.broadcast(base), "part").select(*own, (F.col("place") + F.col("base")).cast("bigint").alias("rank"))
