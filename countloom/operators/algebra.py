"""Multiset algebra over counted sets, by union and aggregation wherever that suffices.

A merge function builds the result's columns from (count_a, label_a, count_b, label_b), absent
values being 0; it is a Column expression, so the whole plan stays in Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.operators.layout import guarded
from countloom.plans.spec import FilterSpec

MergeFn = Callable[[Column, Column, Column, Column], tuple[Column, Column]]


def _tagged(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [s.select(F.lit(i).alias("src"), "key", "count", "label") for i, s in enumerate(sets)])


def combine(a: DataFrame, b: DataFrame, merge: MergeFn) -> DataFrame:
    """Any two-sided operation: one aggregation brings both sides of a key together."""
    return multi_combine([a, b], lambda counts, labels: merge(counts[0], labels[0], counts[1], labels[1]))


def multi_combine(sets: Sequence[DataFrame], merge: Callable[[list[Column], list[Column]], tuple[Column, Column]]) -> DataFrame:
    """Any operation over several sets: `merge` gets a key's counts and labels in all of them, 0 where it is absent."""
    sides = _sides(sets)
    n = range(len(sets))
    count, label = merge([F.col(f"c{i}") for i in n], [F.col(f"l{i}") for i in n])
    return sides.select("key", count.cast("bigint").alias("count"), label.cast("bigint").alias("label")).filter("count > 0")


def _sides(sets: Sequence[DataFrame]) -> DataFrame:
    """(key, c0, l0, c1, l1, ...) of every key of any set."""

    def of(side: int, what: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("src") == side, F.col(what))), F.lit(0)).cast("bigint")

    columns = [of(i, what).alias(f"{what[0]}{i}") for i in range(len(sets)) for what in ("count", "label")]
    return _tagged(sets).groupBy("key").agg(*columns)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts added; the label of the first set."""
    label = F.coalesce(F.max(F.when(F.col("src") == 0, F.col("label"))), F.lit(0)).cast("bigint")
    return _tagged([a, b]).groupBy("key").agg(F.sum("count").alias("count"), label.alias("label"))


def merge_joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """merge() by a full join: of two sets that are bucketed alike no row is shuffled, and sorted buckets are merged as streams."""
    other = b.select("key", F.col("count").alias("n"))
    joined = a.hint("merge").join(other, "key", "full_outer")
    none = F.lit(0).cast("bigint")
    return joined.select("key", (F.coalesce("count", none) + F.coalesce("n", none)).alias("count"), F.coalesce("label", none).alias("label"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smaller count of common keys; the label of the first set."""
    other = b.select("key", F.col("count").alias("n"))
    return a.join(other, "key").select("key", F.least("count", "n").alias("count"), "label")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of the first less those of the second, where above zero; the first set's label."""
    other = b.select("key", F.col("count").alias("n"))
    left = F.col("count") - F.coalesce("n", F.lit(0))
    return a.join(other, "key", "left").filter(left > 0).select("key", left.alias("count"), "label")


def multi_merge(sets: Sequence[DataFrame]) -> DataFrame:
    """Counts added over any number of sets; the label of the last set that holds the key."""
    return _tagged(sets).groupBy("key").agg(F.sum("count").alias("count"), F.max_by("label", "src").alias("label"))


def migrate(source: DataFrame, dest: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """dest with source's counts added; source's label wins on its keys.  With the spec of dest its disk limit holds."""
    label = F.max_by("label", F.when(F.col("src") == 0, 1).otherwise(0))
    moved = _tagged([source, dest]).groupBy("key").agg(F.sum("count").alias("count"), label.alias("label"))
    return moved if spec is None else guarded(moved, spec, disk=True)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose counts or labels differ, or that one set lacks."""
    return _sides([a, b]).filter("c0 <> c1 or l0 <> l1")


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (eq): whether keys, counts and labels agree."""
    return differences(a, b).agg((F.count("*") == 0).alias("eq"))


def inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (product): the sum over common keys of the counts' products."""
    other = b.select("key", F.col("count").alias("n"))
    return a.join(other, "key").agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0)).cast("bigint").alias("product"))


def magnitude(a: DataFrame) -> DataFrame:
    """One row (magnitude): the integer part of the Euclidean norm of the counts."""
    return a.agg(F.floor(F.sqrt(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)).cast("double"))).cast("bigint").alias("magnitude"))
