"""Parameters of a counted set, checked once; everything else is derived from them."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

#: Occupied slots allowed, as a share of all: in memory and on disk.
LOAD_MEMORY, LOAD_DISK = 0.95, 0.85
BLOCK_SLOTS = 64


@dataclass(frozen=True)
class FilterSpec:
    """`2**quotient_bits` slots for keys of `key_bits` bits.

    With key_bits up to 63 keys are non-negative BIGINTs; with 64 a BIGINT holds the key's 64 bits, and keys of 2**63 and
    more look negative.  policy says what becomes of a key outside the range, wherever one comes in: it is
    reduced ("mod") or an error ("strict").  maximum_count, if given, saturates counts.  Raises
    ValueError for parameters that fit no counted set.
    """

    quotient_bits: int = 16
    key_bits: int = 24
    label_bits: int = 0
    fixed_counter_size: int = 3
    block_label_bytes: int = 0
    maximum_count: int | None = None
    policy: str = "mod"

    def __post_init__(self):
        if not 1 <= self.quotient_bits < self.key_bits <= 64:
            raise ValueError("quotient_bits must be at least 1 and below key_bits, key_bits at most 64")
        if self.key_bits - self.quotient_bits > 62:
            raise ValueError("quotient_bits must leave 62 remainder bits at most")
        if self.policy not in ("mod", "strict"):
            raise ValueError("policy is mod or strict")
        if self.fixed_counter_size < 1:
            raise ValueError("fixed_counter_size must be positive")
        if not 0 <= self.label_bits <= 62 or self.block_label_bytes < 0:
            raise ValueError("label_bits must be 0 to 62, block_label_bytes not negative")
        if self.maximum_count is not None and self.maximum_count < 1:
            raise ValueError("maximum_count must be positive or None")

    @classmethod
    def of_slots(cls, slots: int, key_bits: int, **rest) -> FilterSpec:
        """By the number of slots, which must be a power of two."""
        if slots < 2 or slots & (slots - 1):
            raise ValueError("the number of slots must be a power of two")
        return cls(slots.bit_length() - 1, key_bits, **rest)

    @property
    def slots(self) -> int:
        return 1 << self.quotient_bits

    @property
    def range(self) -> int:
        """Keys are below this."""
        return 1 << self.key_bits

    @property
    def remainder_bits(self) -> int:
        return self.key_bits - self.quotient_bits

    @property
    def all_slots(self) -> int:
        """With the overflow area past the last quotient."""
        return self.slots + int(10 * math.sqrt(self.slots))

    @property
    def blocks(self) -> int:
        return -(-self.all_slots // BLOCK_SLOTS)

    @property
    def bits_per_slot(self) -> int:
        return self.remainder_bits + self.fixed_counter_size + self.label_bits

    def reduce(self, key: int) -> int:
        """A single key as it is stored."""
        if self.policy == "strict" and not 0 <= key < self.range:
            raise ValueError(f"key out of range: {key}")
        key %= self.range
        return key - (1 << 64) if key >= 1 << 63 else key

    def capacity(self, *, disk: bool = False) -> int:
        """Most slots that may be occupied."""
        return int((LOAD_DISK if disk else LOAD_MEMORY) * self.all_slots)

    def resized(self, quotient_bits: int) -> FilterSpec:
        """The same keys over another number of slots; at least two remainder bits must be left."""
        if self.key_bits - quotient_bits < 2:
            raise ValueError("resizing must leave at least two remainder bits")
        return replace(self, quotient_bits=quotient_bits, maximum_count=None)

    def require_same_keys(self, *others: FilterSpec) -> None:
        if any(o.key_bits != self.key_bits for o in others):
            raise ValueError("counted sets of different key ranges can't be combined")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FilterSpec:
        return cls(**json.loads(text))
