"""Item labels, and the inverted index that tells for every key which sets hold it.

A combination of sets gets its number by the smallest key that has it; numbering looks only at the
distinct combinations, which one aggregation makes small before anything is numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.functions.expressions import label_fits
from countloom.operators.counted import _key
from countloom.operators.ranges import ranked, settled
from countloom.plans.spec import FilterSpec


def add_labels(cs: DataFrame, assigned: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Labels of existing keys set; assignments to absent keys are ignored, of several the largest holds."""
    label = F.col("label").cast("bigint") if spec is None else label_fits("label", spec)
    new = assigned.select(_key("key", spec).alias("key"), label.alias("new")).groupBy("key").agg(F.max("new").alias("new"))
    return cs.join(new, "key", "left").select("key", "count", F.coalesce("new", "label").alias("label"))


def remove_labels(cs: DataFrame, keys: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Labels of the given keys set to 0; counts stay."""
    gone = keys.select(_key("key", spec).alias("key")).distinct().withColumn("gone", F.lit(True))
    return cs.join(gone, "key", "left").select("key", "count", F.when(F.col("gone"), 0).otherwise(F.col("label")).cast("bigint").alias("label"))


def get_labels(cs: DataFrame, keys: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """(key, label) of the keys asked for; 0 without one."""
    asked = keys.select(_key("key", spec).alias("key")).distinct()
    return asked.join(cs.select("key", "label"), "key", "left").select("key", F.coalesce("label", F.lit(0)).cast("bigint").alias("label"))


def combinations(sources: DataFrame) -> DataFrame:
    """(key, count, sources) from rows (src, key, count): counts added, ids of the sets that hold the key."""
    return sources.groupBy("key").agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("src")).alias("sources"))


def label_index(combined: DataFrame, n_sources: int) -> DataFrame:
    """(label, sources): single sets are numbered by themselves, the others from n_sources on.

    All single sets are listed, used or not.  Distinct combinations are numbered range by range, in parallel.
    """
    spark = combined.sparkSession
    many = combined.filter(F.size("sources") > 1).groupBy("sources").agg(F.min("key").alias("first"))
    numbered = ranked(many, F.col("first")).select((F.col("rank") + n_sources).alias("label"), "sources")
    single = spark.range(n_sources).select(F.col("id").alias("label"), F.array(F.col("id").cast("int")).alias("sources"))
    return single.unionByName(numbered)


def invertible_merge(sets: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of all sets with combination labels, and the index (label, sources)."""
    rows = None
    for i, cs in enumerate(sets):
        part = cs.select(F.lit(i).alias("src"), "key", "count")
        rows = part if rows is None else rows.unionAll(part)
    return invertible_merge_rows(rows, len(sets))


def invertible_merge_rows(sources: DataFrame, n_sources: int) -> tuple[DataFrame, DataFrame]:
    """The same for one relation (src, key, count) of n_sources sets."""
    combined = settled(combinations(sources))
    index = label_index(combined, n_sources)
    return combined.join(index, "sources").select("key", "count", "label"), index


def invertible_merge_no_count(sets: Sequence[DataFrame]) -> DataFrame:
    """(key, count) where count is the label; keys of the first set alone have label 0 and are absent."""
    merged, _ = invertible_merge(sets)
    return merged.filter("label <> 0").select("key", F.col("label").alias("count"))


def sources_of(merged: DataFrame, index: DataFrame) -> DataFrame:
    """(key, sources): every key with the ids of the sets that hold it."""
    return merged.select("key", "label").join(index, "label").select("key", "sources")


def compose(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], n_sources: int) -> tuple[DataFrame, DataFrame]:
    """Merge two merged sets whose indexes name sets by global ids."""
    flat = [m.join(i, "label").select(F.col("sources"), "key", "count") for m, i in (left, right)]
    both = flat[0].unionAll(flat[1])
    combined = settled(both.groupBy("key").agg(F.sum("count").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources")))
    index = label_index(combined, n_sources)
    return combined.join(index, "sources").select("key", "count", "label"), index


def _later(ids: str, by: int) -> Column:
    return F.transform(ids, lambda s: (s + by).cast("int"))


def compose_many(inputs: Sequence[tuple[DataFrame, DataFrame, int] | DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Compose any number of labelled sets (items, index, n_sources) and fresh ones (items alone, one source each) at once.

    The sources of the inputs follow one another: ids of an input start where those of the ones before it end.  Items carry their
    labels as they are; which combination of (input, label) pairs a key has is put into one number by which the
    distinct combinations, and nothing else, are looked up in the indexes.
    """
    rows, index, base = None, None, 0
    for i, one in enumerate(inputs):
        items, own, n = (one, None, 1) if isinstance(one, DataFrame) else one
        part = items.select(F.lit(i).alias("input"), "key", "count", (F.lit(0).cast("bigint") if own is None else F.col("label").cast("bigint")).alias("label"))
        names = items.sparkSession.range(1).select(F.col("id").alias("label"), F.array(F.lit(0)).alias("sources")) if own is None else own.select("label", "sources")
        moved = names.select(F.lit(i).alias("input"), F.col("label").cast("bigint").alias("label"), _later("sources", base).alias("sources"))
        rows, index, base = (part, moved, base + n) if rows is None else (rows.unionAll(part), index.unionAll(moved), base + n)
    # a key has at most one label an input: an array of them, as short as the inputs are few, is the combination
    labels_of = F.array(*(F.coalesce(F.max(F.when(F.col("input") == i, F.col("label"))), F.lit(-1)) for i in range(len(inputs))))
    per_key = settled(rows.groupBy("key").agg(F.sum("count").alias("count"), labels_of.alias("combination")).withColumn("code", F.xxhash64("combination")))
    distinct = per_key.groupBy("code", "combination").agg(F.min("key").alias("first"))
    each = distinct.select("code", "combination", "first", F.posexplode("combination").alias("input", "label")).filter("label >= 0")
    spelled = each.join(index, ["input", "label"]).groupBy("code", "combination").agg(F.min("first").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    spelled = settled(spelled)
    # different combinations may name the same sources; those are one label
    many = spelled.filter(F.size("sources") > 1).groupBy("sources").agg(F.min("first").alias("first"))
    numbered = ranked(many, F.col("first")).select((F.col("rank") + base).alias("label"), "sources")
    single = per_key.sparkSession.range(base).select(F.col("id").alias("label"), F.array(F.col("id").cast("int")).alias("sources"))
    found = single.unionByName(numbered)
    code = spelled.join(found, "sources").select("code", "combination", "label")
    return per_key.join(code, ["code", "combination"]).select("key", "count", "label"), found
