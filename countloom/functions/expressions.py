"""Column expressions over keys and counts; all of them stay inside Catalyst."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from countloom.plans.spec import FilterSpec


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_in_range(key: str | Column, spec: FilterSpec, *, policy: str | None = None) -> Column:
    """The key inside the range: reduced ("mod"), or as it is with an error outside ("strict"); by default as the spec says."""
    key, policy = _col(key).cast("bigint"), policy or spec.policy
    if policy not in ("mod", "strict"):
        raise ValueError("policy is mod or strict")
    if spec.key_bits == 64:  # every BIGINT is the bits of one
        return key
    if policy == "mod":
        return F.pmod(key, F.lit(spec.range))
    return F.when(key.isNull() | (key >= 0) & (key < spec.range), key).otherwise(F.raise_error(F.concat(F.lit("key out of range: "), key.cast("string"))).cast("bigint"))


def from_unsigned(key: str | Column) -> Column:
    """The BIGINT with the bits of an unsigned 64-bit number, given as DECIMAL(20,0)."""
    key = _col(key).cast("decimal(20,0)")
    return F.when(key >= F.lit(Decimal(1 << 63)), key - F.lit(Decimal(1 << 64))).otherwise(key).cast("bigint")


def to_unsigned(key: str | Column) -> Column:
    """The unsigned 64-bit number with the bits of a BIGINT, as DECIMAL(20,0)."""
    key = _col(key)
    wide = key.cast("decimal(20,0)")
    return F.when(key < 0, wide + F.lit(Decimal(1 << 64))).otherwise(wide).cast("decimal(20,0)")


def key_order(key: str | Column, spec: FilterSpec | None) -> Column:
    """A BIGINT that orders keys as unsigned numbers."""
    return _col(key) if spec is None or spec.key_bits < 64 else _col(key).bitwiseXOR(F.lit(-(1 << 63)))


def text_key(text: str | Column, spec: FilterSpec) -> Column:
    """A key for any string: a hash, cut to the range."""
    hashed = F.xxhash64(_col(text))
    return hashed if spec.key_bits == 64 else hashed.bitwiseAND(spec.range - 1)


def quotient(key: str | Column, spec: FilterSpec) -> Column:
    return F.shiftrightunsigned(_col(key), spec.remainder_bits)


def remainder(key: str | Column, spec: FilterSpec) -> Column:
    return _col(key).bitwiseAND((1 << spec.remainder_bits) - 1)


def slots(count: str | Column, spec: FilterSpec) -> Column:
    """Slots that a count occupies: one while it fits the fixed counter, then one more a digit."""
    c, fixed = _col(count), 1 << spec.fixed_counter_size
    largest, out, n = fixed - 1, F.lit(2), 1
    while largest << (n * spec.remainder_bits) < 1 << 62:
        out = out + F.when(c - fixed >= largest << (n * spec.remainder_bits), 1).otherwise(0)
        n += 1
    return F.when(c <= 0, 0).when(c < fixed, 1).otherwise(out).cast("bigint")


def slots_sql(count: str, spec: FilterSpec) -> str:
    """The same as portable SQL."""
    fixed = 1 << spec.fixed_counter_size
    terms, n = [], 1
    while (fixed - 1) << (n * spec.remainder_bits) < 1 << 62:
        terms.append(f"case when {count} - {fixed} >= {(fixed - 1) << (n * spec.remainder_bits)} then 1 else 0 end")
        n += 1
    return f"cast(case when {count} <= 0 then 0 when {count} < {fixed} then 1 else 2 + {' + '.join(terms)} end as bigint)"


def bit_rank(word: str | Column, position: int) -> Column:
    """Set bits at or below a position."""
    return F.bit_count(_col(word).bitwiseAND((1 << (position + 1)) - 1 if position < 62 else -1 if position == 63 else (1 << 63) - 1))


def highest_bit(word: str | Column) -> Column:
    """Position of the highest set bit of a positive number."""
    return F.length(F.bin(_col(word))) - 1


def label_fits(label: str | Column, spec: FilterSpec) -> Column:
    """The label, or an error if it needs more than label_bits."""
    label = _col(label).cast("bigint")
    return F.when(label.isNull() | (label >= 0) & (label < 1 << spec.label_bits), label).otherwise(F.raise_error(F.concat(F.lit("label out of range: "), label.cast("string"))).cast("bigint"))
