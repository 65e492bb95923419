"""How much room a counted set will need; searches run over a histogram of at most 999 rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.plans.spec import LOAD_MEMORY, FilterSpec


def count_histogram(cs: DataFrame, most: int = 999) -> dict[int, int]:
    """Keys by count, for counts of 1 to `most` (the sizing rule looks no further)."""
    rows = cs.filter((F.col("count") >= 1) & (F.col("count") <= most)).groupBy("count").agg(F.count("*").alias("n")).collect()
    return {r["count"]: r["n"] for r in rows}


def estimate_memory_kib(slots: int, slot_bits: int, counter_bits: int, label_bits: int) -> int:
    """KiB of `slots` slots with their block headers."""
    spec = FilterSpec.of_slots(slots, 63)
    return spec.blocks * (17 + 8 * (slot_bits + counter_bits + label_bits)) // 1024


def slots_by_size(count: int, counter_bits: int, slot_bits: int) -> int:
    """Slots that the sizing rule gives a count: one, then one for every further digit."""
    used, reach = 1, counter_bits
    while count > (1 << reach) - 1:
        used, reach = used + 1, reach + slot_bits
    return used


def is_enough(histogram: dict[int, int], slots: int, counter_bits: int, slot_bits: int) -> bool:
    """Whether the histogram's items stay below the load limit."""
    return sum(n * slots_by_size(c, counter_bits, slot_bits) for c, n in histogram.items()) < int(LOAD_MEMORY * slots)


def estimate_requirement(histogram: dict[int, int], hash_bits: int, label_bits: int) -> tuple[int, int, int]:
    """(quotient bits, counter bits, KiB) of the smallest set that holds the histogram; OverflowError if none does."""
    best = None
    for quotient_bits in range(8, min(63, hash_bits)):
        slot_bits = hash_bits - quotient_bits
        for counter_bits in range(1, slot_bits):
            size = estimate_memory_kib(1 << quotient_bits, slot_bits, counter_bits, label_bits)
            if (best is None or size < best[2]) and is_enough(histogram, 1 << quotient_bits, counter_bits, slot_bits):
                best = quotient_bits, counter_bits, size
    if best is None:
        raise OverflowError("no set of that key range holds the histogram")
    return best
