"""The object interface, and streams."""

import pytest
from pyspark.sql import functions as F

from countloom.countedset import CountedSet
from countloom.plans.spec import FilterSpec
from countloom.streaming import buffered


def of(spark, pairs, spec):
    return CountedSet.of(spark.createDataFrame(pairs, "key bigint, n bigint"), spec, n="n")


def test_iterate_and_reload(spark, tmp_path):
    cs = of(spark, [(100, 100000), (103, 100), (101, 10000), (102, 1000)], FilterSpec(5, 13, 0, 4))
    want = [(100, 0, 100000), (101, 0, 10000), (102, 0, 1000), (103, 0, 100)]
    assert list(cs) == want
    cs.save(f"{tmp_path}/s")
    again = CountedSet.load(spark, f"{tmp_path}/s")
    assert list(again) == want and again.spec == cs.spec and again.equals(cs)


def test_incompatible_sets_raise(spark):
    a, b = (of(spark, [(1, 1)], FilterSpec(5, bits)) for bits in (15, 16))
    for operation in (a.merge, a.intersect, a.subtract, a.equals, a.inner_product, a.migrate_from):
        with pytest.raises(ValueError):
            operation(b)
    with pytest.raises(ValueError):
        a.resize(30)
    with pytest.raises(ValueError):
        a.sources_of()


def test_changes_and_room(spark):
    spec = FilterSpec(16, 25)
    cs = of(spark, [(k, 50) for k in range(1000)], spec)
    bigger = cs.resize(18)
    assert bigger.equals(cs) and bigger.space() <= cs.space() and cs.distinct() == 1000
    assert cs.insert(spark.range(5).select(F.col("id").alias("key"))).count_key(3) == 51
    assert cs.reset().distinct() == 0 and cs.magnitude() == int((1000 * 2500) ** 0.5)
    both = CountedSet.invertible_merge([cs, of(spark, [(7, 1), (2000, 4)], spec)])
    assert {r["key"]: r["sources"] for r in both.sources_of().filter("key in (7, 8, 2000)").collect()} == {7: [0, 1], 8: [0], 2000: [1]}
    assert CountedSet.multi_merge([cs, cs]).count_key(1) == 100 and cs.migrate_from(cs).count_key(1) == 100
    assert cs.seek(1).first()["key"] == 512 and [r["key"] for r in cs.find(998).collect()] == [998, 999] and cs.find(5000).count() == 0


def test_windowed_stream_equals_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    counts = buffered.windowed_counts(stream, time="ts", key="event_type", late="1 day", width="1 day")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("start"), F.col("event_type").alias("key")).agg(F.count("*").alias("count"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))
    running = buffered.running_counts(stream, FilterSpec(16, 24), key="user_id")
    query = running.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("running").agg(F.sum("count")).first()[0] == events.filter("user_id is not null").count()


def test_compose_and_store(spark, tmp_path):
    def of(values):
        return CountedSet.of(spark.createDataFrame([(v,) for v in values], "key bigint"), FilterSpec(10, 18), guard=False)

    sources = [[1, 2, 3], [2, 3], [3, 9], [4, 1], [9]]
    a, b, c, d, e = map(of, sources)
    whole = CountedSet.compose([CountedSet.invertible_merge([a, b]), c, CountedSet.invertible_merge([d, e])])
    got = {r.key: list(r.sources) for r in whole.sources_of().collect()}
    assert got == {k: [i for i, s in enumerate(sources) if k in s] for k in (1, 2, 3, 4, 9)}
    again = CountedSet.compose([whole, of([1])])  # a composed set is an input like others
    assert {r.key: list(r.sources) for r in again.sources_of().collect()}[1] == [0, 3, 5]
    held = whole.stored(str(tmp_path / "set"), ranges=2)
    assert held.count_key(3) == 3 and held.statistics()["distinct"] == 5
