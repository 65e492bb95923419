"""Where items would lie in a slotted filter, in closed form, and what follows from it.

With items in key order, S the slots before an item and q its quotient, its slot is S plus
the running maximum of q - S.  Running sums and maxima over the whole key order are
taken in two passes: within ranges of about equal size in parallel, then over one row a range.  The running maximum
grows exactly where a gap is, so it names the cluster that an item lies in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.expressions import key_order, quotient, slots
from countloom.operators.ranges import before, ranked, settled, with_ranges
from countloom.plans.spec import BLOCK_SLOTS, FilterSpec


def occupied(cs: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row (slots): slots that all counts occupy."""
    return cs.agg(F.coalesce(F.sum(slots("count", spec)), F.lit(0)).cast("bigint").alias("slots"))


def space(cs: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row (percent): how full the set is, cut to an integer."""
    return occupied(cs, spec).select((F.col("slots") * 100).cast("double").__truediv__(spec.all_slots).cast("int").alias("percent"))


def layered_space(layers: list[tuple[DataFrame, FilterSpec]]) -> DataFrame:
    """One row (percent): how full the fullest of several sets is."""
    rows = None
    for cs, spec in layers:
        rows = space(cs, spec) if rows is None else rows.unionAll(space(cs, spec))
    return rows.agg(F.max("percent").alias("percent"))


def check_capacity(cs: DataFrame, spec: FilterSpec, *, disk: bool = False) -> None:
    """Raise OverflowError if the counts need more slots than may be occupied."""
    used = occupied(cs, spec).first()[0]
    if used > spec.capacity(disk=disk):
        raise OverflowError(f"{used} slots are needed, {spec.capacity(disk=disk)} may be occupied")


def guarded(cs: DataFrame, spec: FilterSpec, *, disk: bool = False) -> DataFrame:
    """The same items; evaluating them fails if the counts need more slots than may be occupied.

    They are settled first, so that what makes them runs once, and check and result read what is written.
    """
    cs = settled(cs)
    limit = spec.capacity(disk=disk)
    message = F.concat(F.col("slots").cast("string"), F.lit(f" slots are needed, {limit} may be occupied"))
    fits = occupied(cs, spec).select(F.when(F.col("slots") > limit, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("fits"))
    return cs.crossJoin(F.broadcast(fits)).filter("fits").drop("fits")  # one row


def _placed(cs: DataFrame, spec: FilterSpec, ranges: int | None = None) -> DataFrame:
    """(key, count, label, slot, len, shift, part); shift: the slot less all slots before, the same throughout a cluster."""
    rows = cs.withColumn("q", quotient("key", spec)).withColumn("len", slots("count", spec)).withColumn("order", key_order("key", spec))
    rows = with_ranges(rows, F.col("order"), ranges=ranges)
    earlier = Window.partitionBy("part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("part").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("s", F.coalesce(F.sum("len").over(earlier), F.lit(0)))
    local = local.withColumn("m", F.max(F.col("q") - F.col("s")).over(so_far))
    # one row a range: slots before it, and the greatest q - S before it
    peaks = local.groupBy("part").agg(F.max("m").alias("peak"), F.sum("len").alias("total"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = peaks.withColumn("base", F.coalesce(F.sum("total").over(all_before), F.lit(0)))
    offsets = offsets.withColumn("top", F.max(F.col("peak") - F.col("base")).over(all_before)).select("part", "base", "top")
    joined = local.join(F.broadcast(offsets), "part")
    shift = F.greatest(F.col("m") - F.col("base"), F.coalesce("top", F.lit(-(1 << 62)))).cast("bigint")
    return joined.select("key", "count", "label", (F.col("s") + F.col("base") + shift).cast("bigint").alias("slot"), "len", shift.alias("shift"), "part")


def layout(cs: DataFrame, spec: FilterSpec, *, ranges: int | None = None) -> DataFrame:
    """(key, count, label, slot, len, block_id) of every item."""
    return _placed(cs, spec, ranges).select("key", "count", "label", "slot", "len", F.expr(f"slot div {BLOCK_SLOTS}").alias("block_id"))


def overflows(cs: DataFrame, spec: FilterSpec) -> DataFrame:
    """Items that would reach past the last slot."""
    return layout(cs, spec).filter(F.col("slot") + F.col("len") > spec.all_slots)


def reachable_blocks(cs: DataFrame, spec: FilterSpec) -> int:
    """Blocks that items may begin in, those past the last slot that the spec has among them.

    An item's slot is at most the largest quotient and the slots of all items before it.
    """
    return max(spec.blocks, -(-(spec.slots + occupied(cs, spec).first()["slots"]) // BLOCK_SLOTS))


def first_in_block(cs: DataFrame, spec: FilterSpec) -> DataFrame:
    """(key, block_id, first_key): the first item of each item's block."""
    placed = layout(cs, spec)
    return placed.select("key", "block_id", F.first("key").over(Window.partitionBy("block_id").orderBy(key_order("key", spec))).alias("first_key"))


def blocks(cs: DataFrame, spec: FilterSpec) -> DataFrame:
    """(block_id, n, n_before): items that begin in each block, and in all blocks before it."""
    counts = _placed(cs, spec).groupBy(F.expr(f"slot div {BLOCK_SLOTS}").alias("block_id")).agg(F.count("*").alias("n"), F.min("part").alias("part"))
    counts = settled(counts)
    inside = Window.partitionBy("part").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    base = before(counts.groupBy("part").agg(F.sum("n").alias("t")), "t", "base")
    n_before = F.coalesce(F.sum("n").over(inside), F.lit(0))
    local = counts.withColumn("n_before", n_before)
    return local.join(F.broadcast(base), "part").select("block_id", "n", (F.col("n_before") + F.col("base")).cast("bigint").alias("n_before"))


def dump(cs: DataFrame, spec: FilterSpec, payloads: DataFrame | None = None) -> DataFrame:
    """(block_id, n, slots, first_key, last_key, payload): what begins in each block that something begins in."""
    placed = _placed(cs, spec).withColumn("block_id", F.expr(f"slot div {BLOCK_SLOTS}"))
    rows = placed.groupBy("block_id").agg(F.count("*").alias("n"), F.sum("len").alias("slots"), F.min_by("key", "slot").alias("first_key"), F.max_by("key", "slot").alias("last_key"))
    if payloads is None:
        return rows.withColumn("payload", F.lit(None).cast("string"))
    return rows.join(payloads.select("block_id", "payload"), "block_id", "left")


def clusters(cs: DataFrame, spec: FilterSpec) -> DataFrame:
    """(start, length, n) of every maximal run of occupied slots."""
    return _placed(cs, spec).groupBy("shift").agg(F.min("slot").alias("start"), F.sum("len").alias("length"), F.count("*").alias("n")).drop("shift")


def item_order(cs: DataFrame, spec: FilterSpec, *, ranges: int | None = None) -> DataFrame:
    """(key, rank): the 0-based place of every key, an order-preserving minimal perfect hash."""
    return ranked(cs.select("key"), key_order("key", spec), ranges=ranges)


def seek(cs: DataFrame, spec: FilterSpec, position: int, *, block_aligned: bool = False) -> DataFrame:
    """Items from a quotient on, in key order.

    block_aligned: if no item has that quotient, from the first item of the quotient's block of 64 on, or the next there is.
    """
    if position > spec.all_slots:
        raise IndexError("position past the last slot")
    q = quotient("key", spec)
    rows = cs.filter(q >= position)
    if block_aligned:
        there = cs.filter(q == position).select(F.lit(True).alias("there")).limit(1)
        start = position - position % BLOCK_SLOTS
        here = cs.sparkSession.range(1).join(there, F.lit(True), "left").select(F.when(F.col("there"), position).otherwise(start).alias("first"))
        rows = cs.filter(q >= start).crossJoin(F.broadcast(here)).filter(q >= F.col("first")).drop("first")  # one row
    return rows.orderBy(key_order("key", spec))


def find(cs: DataFrame, key: int, spec: FilterSpec | None = None) -> DataFrame:
    """Items from a key on, in key order; nothing if the key is absent."""
    key = key if spec is None else spec.reduce(key)
    there = cs.filter(F.col("key") == key).select(F.lit(1).alias("one")).limit(1)
    order = key_order("key", spec)
    return cs.filter(order >= key_order(F.lit(key).cast("bigint"), spec)).join(F.broadcast(there), F.lit(True), "left_semi").orderBy(order)


def with_block_labels(cs: DataFrame, spec: FilterSpec, payloads: DataFrame) -> DataFrame:
    """(key, block_id, payload): the payload (block_id, payload) of the block of every item, null without one."""
    return layout(cs, spec).select("key", "block_id").join(payloads, "block_id", "left").select("key", "block_id", "payload")
