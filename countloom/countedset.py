"""One object for a counted set: its items, its parameters and, after an invertible merge, its index.

Every method returns a new set or a plain value; nothing is changed in place, so copies are free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions.expressions import key_order
from countloom.operators import algebra, counted, labels, layout, sizing
from countloom.plans.spec import FilterSpec
from countloom.sources import tables
from countloom.sources.tiered import TieredSet


class CountedSet:
    """`items` are rows (key, count, label); counts above zero, one row a key."""

    def __init__(self, items: DataFrame, spec: FilterSpec, index: DataFrame | None = None):
        self.items, self.spec, self.index = items, spec, index

    @classmethod
    def empty(cls, spark: SparkSession, spec: FilterSpec) -> CountedSet:
        return cls(counted.empty(spark), spec)

    @classmethod
    def of(cls, rows: DataFrame, spec: FilterSpec, *, key: str = "key", n: str | None = None, guard: bool = True) -> CountedSet:
        """Count rows that may repeat.  guard: evaluating the set fails where it needs more slots than may be occupied."""
        items = counted.build(rows, spec, key=key, n=n)
        return cls(layout.guarded(items, spec) if guard else items, spec)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CountedSet:
        return cls(*tables.load(spark, path))

    def save(self, path: str, **how) -> None:
        tables.save(self.items, self.spec, path, self.index, **how)

    def _with(self, items: DataFrame, index: DataFrame | None = None) -> CountedSet:
        return CountedSet(items, self.spec, index)

    def copy(self) -> CountedSet:
        """The same set: nothing changes in place."""
        return self._with(self.items, self.index)

    def _other(self, other: CountedSet) -> DataFrame:
        self.spec.require_same_keys(other.spec)
        return other.items

    # changes

    def insert(self, rows: DataFrame, *, guard: bool = True, **how) -> CountedSet:
        """guard: evaluating the set fails where it needs more slots than may be occupied."""
        items = counted.insert(self.items, rows, self.spec, **how)
        return self._with(layout.guarded(items, self.spec) if guard else items, self.index)

    def remove(self, rows: DataFrame, **how) -> CountedSet:
        return self._with(counted.remove(self.items, rows, self.spec, **how), self.index)

    def set_counts(self, rows: DataFrame, **how) -> CountedSet:
        return self._with(counted.set_counts(self.items, rows, self.spec, **how), self.index)

    def reset(self) -> CountedSet:
        """No items, the same parameters."""
        return CountedSet.empty(self.items.sparkSession, self.spec)

    def resize(self, quotient_bits: int) -> CountedSet:
        """The same items over another number of slots; the index is dropped."""
        return CountedSet(self.items, self.spec.resized(quotient_bits))

    # lookups

    def count_key(self, key: int) -> int:
        return counted.count_key(self.items, key, self.spec)

    def query(self, keys: DataFrame, *, key: str = "key") -> DataFrame:
        return counted.query(self.items, keys, self.spec, key=key)

    def batch_query(self, batch: DataFrame, *, key: str = "key") -> DataFrame:
        return counted.batch_query(self.items, batch, self.spec, key=key)

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(key, label, count) in key order, fetched range by range."""
        for row in self.items.orderBy(key_order("key", self.spec)).toLocalIterator():
            yield row["key"], row["label"], row["count"]

    def seek(self, position: int, **how) -> DataFrame:
        return layout.seek(self.items, self.spec, position, **how)

    def find(self, key: int) -> DataFrame:
        return layout.find(self.items, key, self.spec)

    # labels

    def add_labels(self, assigned: DataFrame) -> CountedSet:
        return self._with(labels.add_labels(self.items, assigned, self.spec), self.index)

    def remove_labels(self, keys: DataFrame) -> CountedSet:
        return self._with(labels.remove_labels(self.items, keys, self.spec), self.index)

    def get_labels(self, keys: DataFrame) -> DataFrame:
        return labels.get_labels(self.items, keys, self.spec)

    def replace_label(self, old: int, new: int) -> CountedSet:
        return self._with(counted.replace_label(self.items, old, new), self.index)

    def sources_of(self) -> DataFrame:
        """(key, sources) of an invertible merge."""
        if self.index is None:
            raise ValueError("the set has no index; it is not an invertible merge")
        return labels.sources_of(self.items, self.index)

    # algebra

    def merge(self, other: CountedSet) -> CountedSet:
        return self._with(algebra.merge(self.items, self._other(other)))

    def intersect(self, other: CountedSet) -> CountedSet:
        return self._with(algebra.intersect(self.items, self._other(other)))

    def subtract(self, other: CountedSet) -> CountedSet:
        return self._with(algebra.subtract(self.items, self._other(other)))

    def migrate_from(self, source: CountedSet, *, guard: bool = True) -> CountedSet:
        """guard: evaluating the set fails where it needs more slots than a set on disk may occupy."""
        return self._with(algebra.migrate(self._other(source), self.items, self.spec if guard else None), self.index)

    def equals(self, other: CountedSet) -> bool:
        return algebra.equals(self.items, self._other(other)).first()["eq"]

    def inner_product(self, other: CountedSet) -> int:
        return algebra.inner_product(self.items, self._other(other)).first()["product"]

    def magnitude(self) -> int:
        return algebra.magnitude(self.items).first()["magnitude"]

    @staticmethod
    def multi_combine(sets: Sequence[CountedSet], merge) -> CountedSet:
        """`merge` makes (count, label) from the lists of a key's counts and labels in all sets."""
        return sets[0]._with(algebra.multi_combine([sets[0]._other(s) for s in sets], merge))

    @staticmethod
    def multi_merge(sets: Sequence[CountedSet]) -> CountedSet:
        return sets[0]._with(algebra.multi_merge([sets[0]._other(s) for s in sets]))

    @staticmethod
    def invertible_merge(sets: Sequence[CountedSet]) -> CountedSet:
        """The union with, for every key, the label of the combination of sets that hold it."""
        items, index = labels.invertible_merge([sets[0]._other(s) for s in sets])
        return sets[0]._with(items, index)

    @staticmethod
    def compose(sets: Sequence[CountedSet]) -> CountedSet:
        """Sets with an index and plain ones merged at once: the sources of each follow those of the ones before it."""
        inputs = []
        for s in sets:
            items = sets[0]._other(s)
            inputs.append(items if s.index is None else (items, s.index, s.index.filter(F.size("sources") == 1).count()))
        merged, index = labels.compose_many(inputs)
        return sets[0]._with(merged, index)

    def stored(self, path: str, **how) -> TieredSet:
        """The items as a new stored set in key ranges, for changes in place, lookups, ranks and pages."""
        held = TieredSet(self.items.sparkSession, path, self.spec, **how)
        held.load(self.items)
        return held

    # room

    def distinct(self) -> int:
        return self.items.count()

    def slots_used(self) -> int:
        return layout.occupied(self.items, self.spec).first()["slots"]

    def space(self) -> int:
        """Percent full."""
        return layout.space(self.items, self.spec).first()["percent"]

    def check_capacity(self, **how) -> None:
        layout.check_capacity(self.items, self.spec, **how)

    def item_order(self) -> DataFrame:
        return layout.item_order(self.items, self.spec)

    def layout(self) -> DataFrame:
        return layout.layout(self.items, self.spec)

    def dump(self, payloads: DataFrame | None = None) -> DataFrame:
        """What each block holds."""
        return layout.dump(self.items, self.spec, payloads)

    def estimate_requirement(self) -> tuple[int, int, int]:
        return sizing.estimate_requirement(sizing.count_histogram(self.items), self.spec.key_bits, self.spec.label_bits)


class LayeredSet(CountedSet):
    """A set in two layers: items counted once, and the others.  All operations are those of the whole.

    The layers are predicates of one relation, so an item never has to be moved; stored, each has its own parameters.
    """

    def __init__(self, items: DataFrame, spec: FilterSpec, index: DataFrame | None = None, *, repeated_spec: FilterSpec | None = None):
        super().__init__(items, spec, index)
        self.repeated_spec = repeated_spec or spec
        spec.require_same_keys(self.repeated_spec)

    def _with(self, items: DataFrame, index: DataFrame | None = None) -> LayeredSet:
        return LayeredSet(items, self.spec, index, repeated_spec=self.repeated_spec)

    @classmethod
    def of_layers(cls, rows: DataFrame, spec: FilterSpec, repeated_spec: FilterSpec | None = None, *, key: str = "key", n: str | None = None) -> LayeredSet:
        """Count rows that may repeat."""
        return cls(counted.build(rows, spec, key=key, n=n), spec, repeated_spec=repeated_spec)

    def singletons(self) -> CountedSet:
        return CountedSet(counted.singletons(self.items), self.spec)

    def repeated(self) -> CountedSet:
        return CountedSet(counted.repeated(self.items), self.repeated_spec)

    def reset(self) -> LayeredSet:
        return self._with(counted.empty(self.items.sparkSession))

    def space(self) -> int:
        """Percent full of the fuller layer."""
        return layout.layered_space([(self.singletons().items, self.spec), (self.repeated().items, self.repeated_spec)]).first()["percent"]

    def check_capacity(self, **how) -> None:
        self.singletons().check_capacity(**how)
        self.repeated().check_capacity(**how)

    def dump(self, payloads: DataFrame | None = None) -> DataFrame:
        """What each block of each layer (0: counted once) holds."""
        both = [part.dump(payloads).withColumn("layer", F.lit(i)) for i, part in enumerate((self.singletons(), self.repeated()))]
        return both[0].unionByName(both[1])

    def save(self, path: str, **how) -> None:
        self.singletons().save(f"{path}/once", **how)
        self.repeated().save(f"{path}/more", **how)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LayeredSet:
        once, more = CountedSet.load(spark, f"{path}/once"), CountedSet.load(spark, f"{path}/more")
        return cls(once.items.unionByName(more.items), once.spec, repeated_spec=more.spec)
