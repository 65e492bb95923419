"""Queries over stored sets in key ranges: merges, lookups, ranks, pages, figures and comparisons that read what they need."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.countedset import CountedSet
from countloom.functions import expressions as X
from countloom.operators import algebra, counted, labels
from countloom.plans.catalogue import A, N, R, SLOTS, SPEC, WIDE, WIDE_SQL, _scratch, labelled, read, register, source, wide
from countloom.plans.spec import FilterSpec
from countloom.sources import tables
from countloom.sources.tiered import TieredSet

SATURATED = FilterSpec(quotient_bits=16, key_bits=24, label_bits=3, maximum_count=60)


def _n(cs: DataFrame) -> DataFrame:
    return cs.select("key", F.col("count").alias("n"))


def tiered(spark, sf_dir, spec: FilterSpec = SPEC, *, merged: bool = True) -> TieredSet:
    """A in the base, N waiting."""
    held = TieredSet(spark, _scratch(spark), spec)
    held.insert(_n(source(spark, sf_dir, "A")), "part-A", n="n")
    if merged:
        held.compact()
    held.insert(_n(source(spark, sf_dir, "N")), "part-N", n="n")
    return held


A_N = f"(select key, cast(sum(count) as bigint) as count from (select * from {A} a union all select * from {N} n) u group by key)"


@register(f"select key, count from {A_N} t")
def tiered_merge_scan(spark, sf_dir):
    """Base and changes merged in place: the plan has no exchange."""
    return tiered(spark, sf_dir).items().select("key", "count")


@register(f"""with a as (select key, least(60, count) as c from {A} t),
b as (select coalesce(a.key, n.key) as key, least(60, coalesce(c, 0) + coalesce(n.count, 0)) as c from a full join {N} n on a.key = n.key),
d as (select b.key, greatest(0, c - coalesce(r.count, 0)) as c, r.key is not null as less from b left join {R} r on b.key = r.key),
l as (select key, c, case when c > 0 and key % 3 = 0 then key % 8 else 0 end as label from d)
select coalesce(l.key, n.key) as key, cast(least(60, coalesce(c, 0) + coalesce(n.count, 0)) as bigint) as count, cast(coalesce(label, 0) as bigint) as label
from l full join {N} n on l.key = n.key where coalesce(c, 0) + coalesce(n.count, 0) > 0""")
def tiered_changes(spark, sf_dir):
    """Insertions, removals and labels in turn, saturated, none of them merged; their order counts."""
    held = tiered(spark, sf_dir, SATURATED)
    held.remove(_n(source(spark, sf_dir, "R")), "less-R", n="n")
    held.set_labels(held.items().filter("key % 3 = 0").select("key", (F.col("key") % 8).alias("label")))
    held.insert(_n(source(spark, sf_dir, "N")), "again-N", n="n")
    return held.items()


@register(f"select key, cast(sum(count) as bigint) as count from (select * from {A} a union all select * from {N} n union all select * from {R} r where key <= (select max(key) // 8 from {R} m)) u group by key")
def tiered_compaction(spark, sf_dir):
    """A change of an eighth of the keys, merged: only the ranges that it touches are written again."""
    held = tiered(spark, sf_dir)
    held.compact()
    some = source(spark, sf_dir, "R")
    held.insert(_n(some.filter(F.col("key") <= F.floor(F.lit(some.agg(F.max("key")).first()[0]) / 8))), "some-R", n="n")
    held.compact()
    return held.items().select("key", "count")


@register(f"""with q as (select distinct o_orderkey as key from orders where o_orderkey between (select max(o_orderkey) // 2 from orders) and (select max(o_orderkey) // 2 + 2000 from orders))
select q.key, coalesce(t.count, 0) as count, cast(0 as bigint) as label from q left join {A_N} t on q.key = t.key""")
def tiered_lookup(spark, sf_dir):
    """A band of keys asked for: only the files of its ranges are opened."""
    orders = read(spark, sf_dir, "orders")
    middle = orders.agg(F.max("o_orderkey")).first()[0] // 2
    return tiered(spark, sf_dir).query(orders.filter(F.col("o_orderkey").between(middle, middle + 2000)), key="o_orderkey")


@register(f"select o.key, t.count from (select distinct o_orderkey as key from orders) o join {A_N} t on o.key = t.key")
def tiered_batch_query(spark, sf_dir):
    return tiered(spark, sf_dir).batch_query(read(spark, sf_dir, "orders"), key="o_orderkey")


@register(f"""select t.key, t.rank from (select key, row_number() over (order by key) - 1 as rank from {A_N} t) t join (select distinct o_orderkey as key from orders where o_custkey % 2 = 0) o on o.key = t.key""")
def stored_rank(spark, sf_dir):
    """Ranks of a batch of keys, from the rows before each range and the ranges asked for."""
    return tiered(spark, sf_dir).rank(read(spark, sf_dir, "orders").filter("o_custkey % 2 = 0"), key="o_orderkey")


@register(f"select cast(key as varchar) as key, row_number() over (order by key) - 1 as rank from {WIDE_SQL} t")
def stored_rank_unsigned(spark, sf_dir):
    held = TieredSet(spark, _scratch(spark), WIDE)
    held.load(wide(spark, sf_dir))
    return held.rank(wide(spark, sf_dir)).select(X.to_unsigned("key").cast("string").alias("key"), "rank")


@register(f"""with t as (select key, count, row_number() over (order by key) - 1 as place from {A_N} t where key > (select max(key) * 2 // 5 from {A} m))
select key, count, cast(place // 1000 as integer) as page from t where place < 3000""")
def keyset_pages(spark, sf_dir):
    """Three pages of 1,000 from a cursor on, each from where the one before stopped."""
    held = tiered(spark, sf_dir)
    cursor, out = source(spark, sf_dir, "A").agg(F.max("key")).first()[0] * 2 // 5, None
    for page in range(3):
        rows, cursor = held.page(1000, cursor)
        rows = rows.select("key", "count", F.lit(page).alias("page"))
        out = rows if out is None else out.unionAll(rows)
        if cursor is None:
            break
    return out


@register(f"select count(*) as n_distinct, cast(sum(count) as bigint) as total, cast(sum({SLOTS}) as bigint) as slots from {A_N} t")
def stored_statistics(spark, sf_dir):
    """Kept figures, for ranges with changes waiting counted anew."""
    found = tiered(spark, sf_dir).statistics()
    return spark.createDataFrame([(found["distinct"], found["total"], found["slots"])], "n_distinct bigint, total bigint, slots bigint")


@register(f"""with t as (select key, count from {A_N} t), u as (select key, count - case when key % 1000 = 7 then 1 else 0 end as c1 from t)
select key, count as c0, cast(c1 as bigint) as c1 from t join u using (key) where count <> c1""")
def stored_differences(spark, sf_dir):
    """Two stored sets compared by their ranges' digests; only ranges that differ are read row by row."""
    one = tiered(spark, sf_dir)
    one.compact()
    other = TieredSet(spark, _scratch(spark), SPEC, like=one)
    other.load(one.items())
    other.remove(one.items().filter("key % 1000 = 7").select("key"))
    return one.differences(other).select("key", "c0", "c1")


@register(f"""with s as (select 0 as src, key, count from {A} a union all select 1, key, count from {N} n union all select 2, key, count from {R} r
 union all select 3 + l_linenumber % 2, l_orderkey % 16777216, cast(sum(cast(l_quantity as bigint)) as bigint) from lineitem where l_linenumber <= 2 group by 1, 2
 union all select 5, o_orderkey % 16777216, count(*) from orders group by 1, 2)
select key, cast(sum(count) as bigint) as count, array_to_string(list_sort(list(distinct src)), ';') as sources from s group by key""")
def compose_many(spark, sf_dir):
    """Three labelled sets and a fresh one composed at once: ids of their sources follow one another."""
    parts = {f: source(spark, sf_dir, f) for f in "ANR"}
    lines = {k: counted.build(read(spark, sf_dir, "lineitem").filter(f"l_linenumber <= 2 and l_linenumber % 2 = {k}"), SPEC, key="l_orderkey", n=F.col("l_quantity").cast("bigint")) for k in (0, 1)}
    one, two, three = labels.invertible_merge([parts["A"], parts["N"]]), labels.invertible_merge([parts["R"]]), labels.invertible_merge([lines[0], lines[1]])
    fresh = counted.build(read(spark, sf_dir, "orders"), SPEC, key="o_orderkey")
    merged, index = labels.compose_many([(*one, 2), (*two, 1), (*three, 2), fresh])
    return merged.join(index, "label").select("key", "count", F.array_join(F.transform("sources", lambda s: s.cast("string")), ";").alias("sources"))


@register(f"select key, count, cast(key % 8 as bigint) as label from {A} t")
def stored_labels(spark, sf_dir):
    """A labelled set loaded as a base and opened again by its path."""
    held = TieredSet(spark, _scratch(spark), SPEC)
    held.load(labelled(spark, sf_dir, "A"))
    return TieredSet(spark, held.path).items()


@register(f"select key, count, label from (select key, count, cast(0 as bigint) as label, row_number() over (order by key) as place from {A_N} t) u where place <= 2500")
def stored_iterator(spark, sf_dir):
    """The first items of an iteration, which fetches pages as they are asked for."""
    first = itertools.islice(tiered(spark, sf_dir), 2500)
    return spark.createDataFrame([(key, count, label) for key, label, count in first], "key bigint, count bigint, label bigint")


@register(f"select key, cast(count * 2 as bigint) as count from {A} t")
def set_copy_reset(spark, sf_dir):
    """A copy is a set of its own: the first one's reset leaves it, and merging both copies counts twice."""
    one = CountedSet(source(spark, sf_dir, "A"), SPEC)
    other, again = one.copy(), one.copy()
    return other.merge(again).merge(one.reset()).items.select("key", "count")


@register(f"select key, cast(sum(count) as bigint) as count from (select * from {A} a union all select * from {N} n) u group by key")
def bucketed_merge(spark, sf_dir):
    """Two sets stored in buckets, merged without a shuffle."""
    names = [f"bucketed_{uuid.uuid4().hex}" for _ in range(2)]
    for name, flag in zip(names, "AN", strict=True):
        tables.save_bucketed(source(spark, sf_dir, flag), name, 8)
    return algebra.merge_joined(*map(spark.table, names)).select("key", "count")


@register(f"select key, cast(sum(count) as bigint) as count from (select * from {A} a union all select * from {N} n union all select * from {R} r) u group by key")
def tiered_absorb(spark, sf_dir):
    """A stored set merged into another that is cut alike, range by range."""
    held = tiered(spark, sf_dir)
    other = TieredSet(spark, _scratch(spark), SPEC, like=held)
    other.load(source(spark, sf_dir, "R"))
    held.absorb(other, "R")
    return held.items().select("key", "count")
