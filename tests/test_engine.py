"""Ranges, limits, key policies, wide keys, buffered sets and streams beyond the registered queries."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from countloom.countedset import CountedSet, LayeredSet
from countloom.functions import expressions as X
from countloom.operators import algebra, counted, labels, layout, ranges, sizing
from countloom.plans.spec import FilterSpec
from countloom.sources import tables
from countloom.streaming import buffered, state

SPEC = FilterSpec(10, 18, label_bits=3)


def keys(spark, values, column="key"):
    return spark.createDataFrame([(v,) for v in values], f"{column} bigint")


def plain_layout(items, spec):
    """key: (slot, slots), by the definition."""
    out, at = {}, 0
    for key, count in sorted(items):
        n = 1 if count < 8 else 2
        while count >= 8 and count - 8 >= 7 << ((n - 1) * spec.remainder_bits):
            n += 1
        at = max(at, key >> spec.remainder_bits)
        out[key] = at, n
        at += n
    return out


@pytest.mark.parametrize("kind", ["sequential", "clustered", "random"])
@pytest.mark.parametrize("n_ranges", [1, 7, 64])
def test_layout_in_ranges(spark, kind, n_ranges):
    rng = random.Random(5)
    own = {"sequential": range(700), "clustered": [k for c in (0, 5000, 200000) for k in range(c, c + 200)], "random": rng.sample(range(SPEC.range), 600)}[kind]
    items = [(k, rng.choice([1, 1, 2, 9, 300, 5000])) for k in own]
    cs = spark.createDataFrame([(k, c, 0) for k, c in items], counted.SCHEMA).repartition(5)
    want = plain_layout(items, SPEC)
    rows = layout.layout(cs, SPEC, ranges=n_ranges).collect()
    assert {r.key: (r.slot, r.len) for r in rows} == want and all(r.block_id == r.slot // 64 for r in rows)
    assert {r.key: r.rank for r in layout.item_order(cs, SPEC, ranges=n_ranges).collect()} == {k: i for i, k in enumerate(sorted(own))}
    runs, before = [], None
    for slot, n in sorted(want.values()):
        if before != slot:
            runs.append([slot, 0, 0])
        runs[-1][1] += n
        runs[-1][2] += 1
        before = slot + n
    assert sorted((r.start, r.length, r.n) for r in layout.clusters(cs, SPEC).collect()) == [tuple(r) for r in runs]
    blocks = {}
    for slot, _ in want.values():
        blocks[slot // 64] = blocks.get(slot // 64, 0) + 1
    assert {r.block_id: (r.n, r.n_before) for r in layout.blocks(cs, SPEC).collect()} == {b: (n, sum(m for c, m in blocks.items() if c < b)) for b, n in blocks.items()}


def test_ranges_are_of_even_size(spark):
    rows = keys(spark, [k * k for k in range(4000)])
    sizes = [r["count"] for r in ranges.with_ranges(rows, F.col("key"), ranges=8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8
    equal = ranges.with_ranges(keys(spark, [3] * 500), F.col("key"), ranges=8)
    assert equal.select("part").distinct().count() == 1
    assert ranges.ranked(keys(spark, []), F.col("key")).count() == 0


def test_one_policy_everywhere(spark):
    far = SPEC.range * 3
    cs = counted.build(keys(spark, [1, 2, 2, 3]), SPEC)
    assert counted.count_key(cs, 2 + far, SPEC) == counted.count_key(cs, 2 - far, SPEC) == 2
    assert {r.key: r["count"] for r in counted.query(cs, keys(spark, [2 + far, 3 - far, 9 + far]), SPEC).collect()} == {2: 2, 3: 1, 9: 0}
    assert {r.key for r in counted.set_counts(cs, spark.createDataFrame([(far + 2, 7)], "key bigint, n bigint"), SPEC).collect()} == {1, 2, 3}
    assert {r.key: r["count"] for r in counted.remove(cs, keys(spark, [2 + far, 1 - far]), SPEC).collect()} == {2: 1, 3: 1}
    named = labels.add_labels(cs, spark.createDataFrame([(far + 1, 5)], "key bigint, label bigint"), SPEC)
    assert {r.key: r.label for r in labels.get_labels(named, keys(spark, [1 - far]), SPEC).collect()} == {1: 5}
    one = CountedSet.of(keys(spark, [1 + far, 1]), SPEC)
    assert one.count_key(1 - far) == 2 and one.remove(keys(spark, [1 + 2 * far])).count_key(1) == 1
    strict = FilterSpec(10, 18, policy="strict")
    for bad in (lambda: CountedSet.of(keys(spark, [SPEC.range]), strict).distinct(), lambda: one.query(keys(spark, [0])) and counted.query(cs, keys(spark, [-1]), strict).collect(), lambda: counted.remove(cs, keys(spark, [-1]), strict).collect()):
        with pytest.raises(PySparkException):
            bad()
    with pytest.raises(ValueError):
        counted.count_key(cs, SPEC.range, strict)


def test_capacity_errors(spark):
    small = FilterSpec(4, 12)
    room = small.capacity()
    fits = CountedSet.of(keys(spark, range(room)), small)
    assert fits.distinct() == room
    with pytest.raises(PySparkException, match="slots are needed"):
        CountedSet.of(keys(spark, range(room + 1)), small).distinct()
    with pytest.raises(PySparkException, match="slots are needed"):
        fits.insert(keys(spark, [room])).distinct()
    assert fits.insert(keys(spark, [room]), guard=False).distinct() == room + 1
    with pytest.raises(PySparkException, match="slots are needed"):
        CountedSet.empty(spark, small).migrate_from(fits).distinct()
    with pytest.raises(OverflowError):
        layout.check_capacity(fits.insert(keys(spark, [room]), guard=False).items, small)
    assert layout.overflows(counted.build(keys(spark, [(1 << 12) - 1 - k for k in range(60)]), small), small).count() > 0


def test_wide_keys(spark):
    spec = FilterSpec(16, 64)
    values = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 3 << 62]
    from decimal import Decimal

    raw = spark.createDataFrame([(Decimal(v),) for v in values * 2], "u decimal(20,0)").select(X.from_unsigned("u").alias("key"))
    cs = CountedSet.of(raw, spec)
    assert [key % (1 << 64) for key, _, n in cs if n == 2] == sorted(values)
    assert {int(r.u) for r in cs.items.select(X.to_unsigned("key").alias("u")).collect()} == set(values)
    assert cs.count_key((1 << 64) - 1) == 2 and cs.find(1 << 63).count() == 3
    assert {r.key % (1 << 64): r.slot for r in cs.layout().collect()}[(1 << 64) - 1] >= (1 << 16) - 1
    assert X.text_key("x", spec) is not None


def test_seek_rules(spark):
    cs = counted.build(keys(spark, [(q << 8) + 1 for q in (60, 70, 90, 200)]), SPEC)
    at = lambda p, **how: [r.key >> 8 for r in layout.seek(cs, SPEC, p, **how).collect()]
    assert at(90) == [90, 200] and at(80) == [90, 200]
    assert at(90, block_aligned=True) == [90, 200]  # occupied: from there
    assert at(80, block_aligned=True) == [70, 90, 200]  # else from the first of its block
    assert at(150, block_aligned=True) == at(250, block_aligned=True) == [200] and at(260, block_aligned=True) == []
    with pytest.raises(IndexError):
        layout.seek(cs, SPEC, SPEC.all_slots + 1)


def test_combination_of_many(spark):
    sets = [counted.build(keys(spark, [k for k in range(30) if k % m == 0] * m), SPEC) for m in (1, 2, 3, 5)]
    least = algebra.multi_combine(sets, lambda counts, _: (F.least(*counts), F.lit(1)))
    assert {(r.key, r["count"], r.label) for r in least.collect()} == {(0, 1, 1)}


def test_smallest_requirement():
    rng = random.Random(2)
    for _ in range(6):
        histogram = {rng.randrange(1, 999): rng.randrange(1, 900) for _ in range(20)}
        bits, tag = rng.randrange(20, 30), rng.randrange(0, 6)
        options = [(sizing.estimate_memory_kib(1 << q, bits - q, f, tag), q, f) for q in range(8, bits) for f in range(1, bits - q) if sizing.is_enough(histogram, 1 << q, f, bits - q)]
        kib, q, f = min(options)
        assert sizing.estimate_requirement(histogram, bits, tag) == (q, f, kib)


def test_buffered_set(spark, tmp_path):
    held = buffered.BufferedSet(spark, str(tmp_path / "set"), SPEC)
    held.insert(keys(spark, [1, 2, 2]), "a")
    held.insert(keys(spark, [1, 2, 2]), "a")
    assert held.count_key(2) == 2 and held.version() == 0
    held.sync()
    held.insert(keys(spark, [1, 2, 2]), "a")  # a stream that starts again before its commit
    held.insert(keys(spark, [2, SPEC.range + 5]), "b")
    assert {r.key: r["count"] for r in held.items().collect()} == {1: 1, 2: 3, 5: 1} and held.waiting() == ["b"]
    held.remove(keys(spark, [2, 2]), "less")
    held.remove(keys(spark, [2, 2]), "less")
    assert {r.key: r["count"] for r in held.batch_query(keys(spark, [2, 5, 7])).collect()} == {2: 1, 5: 1}
    held.add_labels(spark.createDataFrame([(5, 3), (9, 1)], "key bigint, label bigint"))
    again = buffered.BufferedSet(spark, held.path)
    assert again.spec == SPEC and {r.key: r.label for r in again.get_labels(keys(spark, [1, 5])).collect()} == {1: 0, 5: 3}
    other = again.copy(str(tmp_path / "copy"))
    again.reset()
    again.insert(keys(spark, [1]), "b")  # merged before the reset
    assert again.items().count() == 0 and other.items().count() == 3
    with pytest.raises(ValueError):
        buffered.BufferedSet(spark, held.path, FilterSpec(11, 18))
    with pytest.raises(ValueError):
        buffered.BufferedSet(spark, str(tmp_path / "new"))


def test_an_insert_during_a_sync_stays(spark, tmp_path, monkeypatch):
    held = buffered.BufferedSet(spark, str(tmp_path / "set"), SPEC)
    held.insert(keys(spark, [1]), "a")
    write = held.tiers._write

    def slow(rows, m, kind, **how):
        if kind == "base":
            monkeypatch.setattr(held.tiers, "_write", write)
            held.insert(keys(spark, [1, 2]), "late")
        return write(rows, m, kind, **how)

    monkeypatch.setattr(held.tiers, "_write", slow)
    held.sync()
    assert held.waiting() == ["late"] and {r.key: r["count"] for r in held.items().collect()} == {1: 2, 2: 1}


def test_buffer_flushes_and_overflows(spark, tmp_path):
    held = buffered.BufferedSet(spark, str(tmp_path / "set"), FilterSpec(6, 14), buffer_bits=4)
    held.insert(keys(spark, range(10)), "a")
    assert held.version() == 0
    held.insert(keys(spark, range(100, 110)), "b")
    assert held.version() == 1 and held.waiting() == []
    assert held.space().first()["percent"] == 20 * 100 // held.spec.all_slots
    with pytest.raises(OverflowError):
        held.insert(keys(spark, range(1000, 1200)), "c")
    assert held.items().count() == 20
    held.drop_buffer()
    assert held.waiting() == [] and held.items().count() == 20


def test_saturated_buffer(spark, tmp_path):
    held = buffered.BufferedSet(spark, str(tmp_path / "set"), FilterSpec(10, 18, maximum_count=3))
    for b in "ab":
        held.insert(keys(spark, [1, 1]), b)
    assert held.count_key(1) == 3
    held.sync()
    assert held.count_key(1) == 3


def test_block_labels_are_stored(spark, tmp_path):
    cs = counted.build(keys(spark, range(0, 3000, 7)), SPEC)
    payloads = spark.createDataFrame([(b, b"x%d" % b) for b in range(5)], "block_id bigint, payload binary")
    tables.save(cs, SPEC, str(tmp_path / "set"), block_labels=payloads)
    items, spec, index = tables.load(spark, str(tmp_path / "set"))
    own = layout.with_block_labels(items, spec, tables.load_block_labels(spark, str(tmp_path / "set")))
    assert index is None and all(bytes(r.payload) == b"x%d" % r.block_id for r in own.filter("block_id < 5").collect()) and own.count() == items.count()
    with pytest.raises(PySparkException, match="payload too long"):
        tables.save(cs, FilterSpec(10, 18, block_label_bytes=1), str(tmp_path / "long"), block_labels=payloads)
    tables.save(cs, FilterSpec(10, 18, block_label_bytes=2), str(tmp_path / "short"), block_labels=payloads)
    tables.save(cs, SPEC, str(tmp_path / "bare"))
    assert tables.load_block_labels(spark, str(tmp_path / "bare")) is None


def test_bucketed_sets_join_and_merge_without_a_shuffle(spark):
    sets = {"bucketed_a": range(1000), "bucketed_b": range(500, 1500)}
    for name, values in sets.items():
        tables.save_bucketed(counted.build(keys(spark, values), SPEC), name, 4)
    a, b = (spark.table(name) for name in sets)
    merged = algebra.merge_joined(a, b)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (algebra.intersect(a, b), algebra.subtract(a, b), merged):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.key: r["count"] for r in merged.collect()} == {k: 1 + (500 <= k < 1000) for k in range(1500)}
        assert algebra.equals(merged, algebra.merge(a, b)).first()["eq"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in sets:
            spark.sql(f"drop table {name}")


def test_a_guarded_set_is_made_once(spark):
    """Its rows come from what was written; only the check reads them a second time."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for frame in batches:
            made.add(len(frame))
            yield frame

    cs = CountedSet.of(keys(spark, range(300)).mapInPandas(seen, "key bigint"), SPEC)
    assert cs.items.count() == 300 and cs.items.filter("key < 9").count() == 9 and made.value == 300


@pytest.mark.parametrize("triggers", [1, 20])
def test_running_changes_over_triggers(spark, tmp_path, triggers):
    """The same counts for any number of triggers, in which files don't follow the order of time."""
    rng, spec = random.Random(5), FilterSpec(10, 18, maximum_count=5)
    rows = [(rng.randrange(6), rng.choice([-4, -1, 1, 2, 3]), 1_700_000_000 + 60 * rng.randrange(200)) for _ in range(240)]
    rows += [(7, 2, 1_700_000_000), (7 + spec.range, -5, 1_700_000_000)]  # of one instant what is added comes first
    want: dict = {}
    for key in {k % spec.range for k, _, _ in rows}:
        by_time: dict = {}
        for k, n, t in rows:
            if k % spec.range == key:
                own = by_time.setdefault(t, [0, 0])
                own[n < 0] += abs(n)
        count = 0
        for t in sorted(by_time):
            count = max(0, min(5, count + by_time[t][0]) - by_time[t][1])
        want[key] = count
    folder = tmp_path / "in"
    for k in range(triggers):
        part = spark.createDataFrame(rows[k::triggers], "key bigint, n bigint, t bigint").selectExpr("key", "n", "timestamp_seconds(t) as ts")
        part.coalesce(1).write.mode("append").parquet(str(folder))
    got = {}
    stream = spark.readStream.schema("key bigint, n bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))

    def one(part, number):
        got.update({r.key: r["count"] for r in part.collect()})

    # the newest row is 200 minutes after the oldest: nothing is late, and timers settle what is older than that
    changes = state.running_changes(stream, spec, key="key", n="n", time="ts", late="4 hours")
    changes.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert got == want


def test_timers_settle_and_state_is_read(spark, tmp_path):
    spec, folder = FilterSpec(10, 18), tmp_path / "in"
    for rows in ([(1, 5, 0), (2, 3, 10)], [(1, -2, 20), (2, -9, 30)], [(3, 1, 100_000)], [(3, 1, 100_001), (4, 7, 5)]):
        part = spark.createDataFrame(rows, "key bigint, n bigint, t bigint").selectExpr("key", "n", "timestamp_seconds(1700000000 + t) as ts")
        part.coalesce(1).write.mode("append").parquet(str(folder))
        got = {}

        def one(part, number, got=got):
            got.update({r.key: r["count"] for r in part.collect()})

        stream = spark.readStream.schema("key bigint, n bigint, ts timestamp").parquet(str(folder))
        changes = state.running_changes(stream, spec, key="key", n="n", time="ts", late="1 hour")
        changes.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert got == {3: 2}, "a row more than an hour behind is left out"
    # settled by timers: key 1 has 3 left, key 2 none and so no state
    assert {r.key: r["count"] for r in state.changes_state(spark, str(tmp_path / "log")).collect()} == {1: 3}


def test_layered_set(spark, tmp_path):
    spec, more = FilterSpec(8, 18), FilterSpec(6, 18)
    both = LayeredSet.of_layers(keys(spark, [1, 2, 2, 3, 9]), spec, more)
    assert both.singletons().distinct() == 3 and both.repeated().distinct() == 1
    grown = both.insert(keys(spark, [1, 5]))
    assert isinstance(grown, LayeredSet) and grown.repeated().distinct() == 2 and grown.count_key(1) == 2
    assert grown.remove(keys(spark, [1])).singletons().count_key(1) == 1
    assert both.space() == max(both.singletons().space(), both.repeated().space())
    assert {(r.layer, r.n) for r in both.dump().collect()} == {(0, 3), (1, 1)}
    grown.save(str(tmp_path / "set"))
    again = LayeredSet.load(spark, str(tmp_path / "set"))
    assert again.equals(grown) and again.repeated_spec == more and again.reset().distinct() == 0
    again.check_capacity()
    with pytest.raises(ValueError):
        LayeredSet(both.items, spec, repeated_spec=FilterSpec(6, 20))


def test_buffered_dump_and_set(spark, tmp_path):
    held = buffered.BufferedSet(spark, str(tmp_path / "set"), SPEC)
    held.insert(keys(spark, [1, 2]), "a")
    held.sync()
    held.insert(keys(spark, [2, 3, 3]), "b")
    assert {(r.tier, r.n) for r in held.dump().collect()} == {(0, 2), (1, 2)}
    assert held.as_set().magnitude() == 3 and held.as_set().merge(held.as_set()).count_key(3) == 4
