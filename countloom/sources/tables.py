"""Counted sets on storage: Parquet items and labels, the parameters as JSON, label maps as text.

Items are written in key ranges and sorted, so a lookup reads few row groups.  All paths go through
Spark's file systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions.expressions import key_order
from countloom.operators.counted import SCHEMA
from countloom.plans.spec import FilterSpec


def save(cs: DataFrame, spec: FilterSpec, path: str, index: DataFrame | None = None, *, block_labels: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Write items, parameters and, if given, the index (label, sources) and the blocks' payloads (block_id, payload).

    Payloads of more than the spec's block_label_bytes are an error, unless that is 0.
    """
    order = key_order("key", spec)
    cs.select("key", "count", "label").repartitionByRange(order).sortWithinPartitions(order).write.mode(mode).parquet(f"{path}/items")
    write_spec(cs.sparkSession, spec, path, mode=mode)
    if index is not None:
        index.select("label", "sources").write.mode(mode).parquet(f"{path}/labels")
    if block_labels is not None:
        payload = F.col("payload")
        if spec.block_label_bytes:
            long = F.raise_error(F.concat(F.lit("payload too long in block "), F.col("block_id").cast("string"))).cast(block_labels.schema["payload"].dataType)
            payload = F.when(F.octet_length("payload") > spec.block_label_bytes, long).otherwise(payload)
        block_labels.select("block_id", payload.alias("payload")).write.mode(mode).parquet(f"{path}/block_labels")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, FilterSpec, DataFrame | None]:
    """Items (read lazily), parameters, and the index or None."""
    index = spark.read.parquet(f"{path}/labels") if exists(spark, f"{path}/labels") else None
    return spark.read.schema(SCHEMA).parquet(f"{path}/items"), read_spec(spark, path), index


def load_block_labels(spark: SparkSession, path: str) -> DataFrame | None:
    """(block_id, payload) stored with a set, or None."""
    return spark.read.parquet(f"{path}/block_labels") if exists(spark, f"{path}/block_labels") else None


def write_spec(spark: SparkSession, spec: FilterSpec, path: str, *, mode: str = "errorifexists") -> None:
    spark.createDataFrame([(spec.to_json(),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/spec")


def read_spec(spark: SparkSession, path: str) -> FilterSpec:
    return FilterSpec.from_json(spark.read.text(f"{path}/spec").first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def save_bucketed(cs: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed and sorted by key: joins on key, and algebra.merge_joined, then need no shuffle."""
    cs.write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)


def write_label_text(index: DataFrame, path: str) -> None:
    """One line `label a;b;c;` for each label."""
    line = F.concat(F.col("label").cast("string"), F.lit(" "), F.array_join(F.transform("sources", lambda s: F.concat(s.cast("string"), F.lit(";"))), ""))
    index.select(line.alias("value")).write.text(path)


def read_label_text(spark: SparkSession, path: str) -> DataFrame:
    """(label, sources) from such lines; the end mark adds no source."""
    parts = F.split("value", " ")
    sources = F.transform(F.filter(F.split(F.coalesce(F.get(parts, 1), F.lit("")), ";"), lambda s: s != ""), lambda s: s.cast("int"))
    return spark.read.text(path).filter("value <> ''").select(F.get(parts, 0).cast("bigint").alias("label"), sources.alias("sources"))
