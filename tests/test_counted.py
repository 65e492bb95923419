"""Literal cases of counting, algebra, labels, layout, sizing, storage and buffering."""

import pytest
from pyspark.sql import functions as F

from countloom.functions import expressions as X
from countloom.operators import algebra, counted, labels, layout, sizing
from countloom.plans.spec import FilterSpec
from countloom.sources import tables
from countloom.streaming import buffered


def rows(spark, pairs):
    return spark.createDataFrame(pairs or [], "key bigint, n bigint")


def as_dict(cs):
    return {r["key"]: r["count"] for r in cs.collect()}


def test_simple_counts(spark):
    spec = FilterSpec(5, 13, 0, 2)
    cs = counted.build(rows(spark, [(100, 1)] * 11 + [(1500, 50), (1600, 60), (2000, 4000)]), spec, n="n")
    assert as_dict(cs) == {100: 11, 1500: 50, 1600: 60, 2000: 4000}
    assert counted.count_key(cs, 100) == 11 and counted.count_key(cs, 7) == 0


def test_saturation_and_big_counts(spark):
    big = rows(spark, [(100, 100000), (150, 8), (150, 8)])
    assert as_dict(counted.build(big, FilterSpec(5, 13, 0, 4, maximum_count=10), n="n")) == {100: 10, 150: 10}
    assert as_dict(counted.build(big, FilterSpec(5, 13, 0, 4), n="n")) == {100: 100000, 150: 16}


def test_policies_and_nulls(spark):
    spec = FilterSpec(5, 13)
    odd = rows(spark, [(spec.range + 3, 1), (3, 1), (None, 5), (4, 0), (5, None)])
    assert as_dict(counted.build(odd, spec, n="n")) == {3: 2}
    with pytest.raises(Exception, match="out of range"):
        counted.build(odd, spec, n="n", policy="strict").collect()


def test_remove_and_assign(spark):
    cs = counted.build(rows(spark, [(k, 50) for k in range(10)]), n="n")
    left = counted.remove(cs, rows(spark, [(k, 50) for k in range(0, 10, 2)] + [(1, 20), (99, 1)]), n="n")
    assert as_dict(left) == {1: 30, 3: 50, 5: 50, 7: 50, 9: 50}
    assert as_dict(counted.set_counts(cs, rows(spark, [(0, 0), (1, 7), (77, 3)]))) == {1: 7, 77: 3} | {k: 50 for k in range(2, 10)}


def test_partial_removal_clears_label(spark):
    cs = spark.createDataFrame([(1, 50, 3), (2, 50, 4)], counted.SCHEMA)
    assert {r["key"]: r["label"] for r in counted.remove(cs, rows(spark, [(1, 1)]), n="n").collect()} == {1: 0, 2: 4}
    kept = counted.remove(cs, rows(spark, [(1, 1)]), n="n", clear_label=False)
    assert {r["key"]: r["label"] for r in kept.collect()} == {1: 3, 2: 4}


def test_algebra_laws(spark):
    a = counted.build(rows(spark, [(k, k % 7 + 1) for k in range(60)]), n="n")
    b = counted.build(rows(spark, [(k, k % 5 + 1) for k in range(30, 90)]), n="n")
    assert as_dict(algebra.merge(a, b)) == as_dict(algebra.merge(b, a)) == as_dict(algebra.multi_merge([a, b]))
    both, less = as_dict(algebra.intersect(a, b)), as_dict(algebra.subtract(a, b))
    assert {k: both.get(k, 0) + less.get(k, 0) for k in as_dict(a)} == as_dict(a)
    assert algebra.equals(a, a).first()["eq"] and not algebra.equals(a, b).first()["eq"]
    assert as_dict(algebra.combine(a, b, lambda ca, la, cb, lb: (ca + cb, la))) == as_dict(algebra.merge(a, b))


def test_empty_sets(spark):
    none, a = counted.empty(spark), counted.build(rows(spark, [(1, 2)]), n="n")
    assert as_dict(algebra.merge(none, a)) == {1: 2} and as_dict(algebra.intersect(none, a)) == {}
    assert algebra.inner_product(none, a).first()["product"] == 0 and algebra.magnitude(none).first()["magnitude"] == 0
    assert layout.layout(none, FilterSpec(5, 13)).count() == 0 and layout.item_order(none, FilterSpec(5, 13)).count() == 0


def test_invertible_merge_property(spark):
    sets = [counted.build(rows(spark, [(k, 50) for k in range(1, 200) if k % (j + 1) == 0]), n="n") for j in range(6)]
    merged, index = labels.invertible_merge(sets)
    found = {r["key"]: r["sources"] for r in labels.sources_of(merged, index).collect()}
    assert found == {k: [j for j in range(6) if k % (j + 1) == 0] for k in range(1, 200)}
    no_count = as_dict(labels.invertible_merge_no_count(sets))
    assert 1 not in no_count and no_count[2] >= 6
    halves = [labels.invertible_merge_rows(parts, 6) for parts in (_sourced(sets, range(3)), _sourced(sets, range(3, 6)))]
    again, index2 = labels.compose(*halves, 6)
    assert {r["key"]: (r["count"], r["label"]) for r in again.collect()} == {r["key"]: (r["count"], r["label"]) for r in merged.collect()}


def _sourced(sets, which):
    out = None
    for j in which:
        part = sets[j].select(F.lit(j).alias("src"), "key", "count")
        out = part if out is None else out.unionAll(part)
    return out


def test_labels(spark):
    cs = counted.build(rows(spark, [(k, 2) for k in range(120, 151)]), n="n")
    spec = FilterSpec(16, 24, 3, 3)
    marked = labels.add_labels(cs, spark.createDataFrame([(150, 7), (120, 1), (999, 2)], "key bigint, label bigint"), spec)
    assert {r["key"]: r["label"] for r in marked.filter("label > 0").collect()} == {150: 7, 120: 1}
    with pytest.raises(Exception, match="label out of range"):
        labels.add_labels(cs, spark.createDataFrame([(150, 8)], "key bigint, label bigint"), spec).collect()
    assert labels.remove_labels(marked, marked.filter("key = 150")).filter("key = 150").first()["label"] == 0


def slots_by_loop(c, f, r):
    if c < 2**f:
        return int(c > 0)
    n = 1
    while c - 2**f >= (2**f - 1) << (n * r):
        n += 1
    return 1 + n


@pytest.mark.parametrize(("f", "r"), [(1, 2), (3, 8), (5, 9)])
def test_slots_expression(spark, f, r):
    counts = sorted({c for e in range(40) for c in (2**e - 1, 2**e, 2**e + 1)} | set(range(300)))
    spec = FilterSpec(16, 16 + r, 0, f)
    got = spark.createDataFrame([(c,) for c in counts], "c bigint").select("c", X.slots("c", spec).alias("s")).collect()
    assert all(row["s"] == slots_by_loop(row["c"], f, r) for row in got)


def test_layout_is_greedy_placement(spark):
    spec = FilterSpec(8, 16, 0, 2)
    cs = counted.build(rows(spark, [(k * 7919 % 65536, k % 90 + 1) for k in range(120)]), spec, n="n")
    placed, end = {}, 0
    for key, count in sorted(as_dict(cs).items()):
        at = max(key >> spec.remainder_bits, end)
        placed[key], end = at, at + slots_by_loop(count, 2, spec.remainder_bits)
    for ranges in (1, 16, 256):
        assert {r["key"]: r["slot"] for r in layout.layout(cs, spec, ranges=ranges).collect()} == placed
    assert [r["rank"] for r in layout.item_order(cs, spec).orderBy("key").collect()] == list(range(len(placed)))
    layout.check_capacity(cs, spec)
    with pytest.raises(OverflowError):
        layout.check_capacity(cs, FilterSpec(4, 16, 0, 2))


def test_spec_errors():
    for bad in (dict(quotient_bits=0), dict(key_bits=65), dict(policy="wrap"), dict(fixed_counter_size=0), dict(maximum_count=0)):
        with pytest.raises(ValueError):
            FilterSpec(**bad)
    with pytest.raises(ValueError):
        FilterSpec.of_slots(1000, 24)
    with pytest.raises(ValueError):
        FilterSpec(10, 15).resized(30)
    with pytest.raises(ValueError):
        FilterSpec(5, 15).require_same_keys(FilterSpec(5, 16))
    assert FilterSpec.from_json(FilterSpec(9, 20).to_json()) == FilterSpec(9, 20)


def test_sizing():
    histogram = {1: 5000, 3: 200, 900: 4}
    q, f, kib = sizing.estimate_requirement(histogram, 24, 0)
    assert sizing.is_enough(histogram, 1 << q, f, 24 - q) and kib == sizing.estimate_memory_kib(1 << q, 24 - q, f, 0)
    with pytest.raises(OverflowError):
        sizing.estimate_requirement({1: 1 << 40}, 12, 0)


def test_storage_round_trip(spark, tmp_path):
    cs = spark.createDataFrame([(1, 5, 2), (9, 1, 0)], counted.SCHEMA)
    index = spark.createDataFrame([(0, [0]), (2, [1, 2]), (3, [])], "label bigint, sources array<int>")
    tables.save(cs, FilterSpec(5, 13, 2), f"{tmp_path}/set", index)
    back, spec, labels_back = tables.load(spark, f"{tmp_path}/set")
    assert spec == FilterSpec(5, 13, 2) and algebra.equals(cs, back).first()["eq"] and labels_back.count() == 3
    tables.write_label_text(index, f"{tmp_path}/text")
    assert {r["label"]: r["sources"] for r in tables.read_label_text(spark, f"{tmp_path}/text").collect()} == {0: [0], 2: [1, 2], 3: []}


def test_buffered_set(spark, tmp_path):
    held = buffered.BufferedSet(spark, f"{tmp_path}/held", FilterSpec(5, 13))
    assert held.items().count() == 0
    held.insert(rows(spark, [(1, 2), (2, 3)]), "one", n="n")
    held.insert(rows(spark, [(1, 2), (2, 3)]), "one", n="n")  # the same batch again
    assert as_dict(held.items()) == {1: 2, 2: 3}
    held.sync()
    held.insert(rows(spark, [(2, 4)]), "two", n="n")
    assert held.version() == 1 and as_dict(held.items()) == {1: 2, 2: 7} and as_dict(held.base()) == {1: 2, 2: 3}
    assert as_dict(buffered.remove(held.base(), held.delta(), rows(spark, [(2, 5)]), n="n")) == {1: 2, 2: 2}
