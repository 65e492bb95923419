"""Buffered counting: a stored base, changes beside it, and streams that feed them.

(Changes kept in a stream's own state are in countloom.streaming.state.)  Reads see both.  A sync merges what waits into the base, in the key ranges that it touches and no others.  Every accepted batch
is named in the manifest of the change that brought it: one that comes again, because its stream was restarted before it had
noted the end, is left out, and one that is written while a sync is under way stays for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from countloom.countedset import CountedSet
from countloom.operators import counted, labels, layout
from countloom.operators.algebra import merge
from countloom.plans.spec import FilterSpec
from countloom.sources.tiered import BASE, INSERT, TieredSet

#: How full the buffer may be before it is merged.
FLUSH = 0.75


def view(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The merged view: counts of both tiers added, the base's label."""
    return merge(base, delta)


def remove(base: DataFrame, delta: DataFrame, rows: DataFrame, spec: FilterSpec | None = None, **how) -> DataFrame:
    """The merged view after taking counts once from the sum of both tiers."""
    return counted.remove(view(base, delta), rows, spec, **how)


class BufferedSet:
    """A counted set in a folder: a base in key ranges, and the changes that are not merged into it.

    The parameters are stored with the set; one that is opened again needs none.  `buffer_bits`: quotient bits of the
    buffer; when the insertions that wait fill FLUSH of its slots they are merged.  Without it only sync() merges.
    `guard`: with a buffer, insertions fail where both tiers need more slots than the disk's limit leaves.
    """

    def __init__(self, spark: SparkSession, path: str, spec: FilterSpec | None = None, *, buffer_bits: int | None = None, ranges: int | None = None, guard: bool = True):
        self.spark, self.buffer_bits, self.guard = spark, buffer_bits, guard
        self.tiers = TieredSet(spark, path, spec, ranges=ranges)
        self.path, self.spec = self.tiers.path, self.tiers.spec

    # tiers

    def version(self) -> int:
        """How many times changes were merged; 0 before the first sync."""
        return self.tiers.manifest()["version"]

    def base(self) -> DataFrame:
        return self.tiers._live(self.tiers.manifest(), [BASE]).select("key", "count", "label")

    def waiting(self) -> list[str]:
        """Names of the batches that the base has not, or not in all ranges."""
        return sorted(b for g in self.tiers.manifest()["gens"] if g["kind"] != BASE for b in g["batches"])

    def _delta(self, m: dict) -> DataFrame:
        rows = self.tiers._live(m, [INSERT])
        return rows.groupBy("part", "key").agg(F.sum("count").alias("count")).select("key", "count", F.lit(0).cast("bigint").alias("label"))

    def delta(self) -> DataFrame:
        """The insertions that wait."""
        return self._delta(self.tiers.manifest())

    def items(self) -> DataFrame:
        """What all changes so far amount to; the base isn't shuffled."""
        return self.tiers.items()

    # changes

    def insert(self, rows: DataFrame, batch: str, *, key: str = "key", n: str | None = None) -> None:
        """Append counted rows as one named batch; the same batch again is left out.

        OverflowError, and nothing is accepted, if both tiers together need more slots than the disk's limit leaves (unless `guard` is off).
        """
        full = []

        def check(now: dict, new: dict) -> None:
            waiting = layout.occupied(self._delta(new), self.spec).first()["slots"]
            base = sum(s[2] for g in new["gens"] if g["kind"] == BASE for s in g["ranges"].values())
            if self.guard and waiting + base > self.spec.capacity(disk=True):
                raise OverflowError(f"{waiting + base} slots are needed, {self.spec.capacity(disk=True)} may be occupied")
            full.append(waiting > FLUSH * (1 << self.buffer_bits))

        if self.tiers.insert(rows, batch, key=key, n=n, check=check if self.buffer_bits is not None else None) and full and full[-1]:
            self.sync()

    def sync(self, ratio: float = 0) -> list[int]:
        """Merge what waits into the base, in ranges where it is at least `ratio` times as much as the base; the ranges that were rewritten."""
        return self.tiers.compact(ratio)

    def remove(self, rows: DataFrame, batch: str | None = None, *, key: str = "key", n: str | None = None) -> None:
        """Take counts once from the sum of both tiers; a named batch is taken once."""
        self.tiers.remove(rows, batch, key=key, n=n)

    def add_labels(self, assigned: DataFrame, batch: str | None = None) -> None:
        """Labels of existing keys (key, label) set."""
        self.tiers.set_labels(assigned, batch)

    def remove_labels(self, keys: DataFrame, batch: str | None = None) -> None:
        """Labels of the given keys set to 0; counts stay."""
        self.tiers.set_labels(keys.select("key", F.lit(0).alias("label")), batch)

    def drop_buffer(self) -> None:
        """Merge the changes and leave none."""
        self.sync()

    def reset(self) -> None:
        """No items in either tier; the parameters stay, and so does the knowledge of what was accepted."""
        self.tiers.clear()

    def copy(self, path: str) -> BufferedSet:
        """The same items as a set of its own, which knows the same batches."""
        other = BufferedSet(self.spark, path, self.spec, buffer_bits=self.buffer_bits, guard=self.guard)
        other.tiers.load(self.items())
        marks = self.tiers.manifest()["marks"]
        other.tiers._commit(lambda now: now | {"marks": marks})
        return other

    # lookups

    def count_key(self, key: int) -> int:
        return self.tiers.count_key(key)

    def query(self, keys: DataFrame, *, key: str = "key") -> DataFrame:
        """(key, count, label) of the distinct keys asked for, zeros for absent ones."""
        return self.tiers.query(keys, key=key)

    def batch_query(self, batch: DataFrame, *, key: str = "key") -> DataFrame:
        """(key, count) of the batch's keys that either tier holds, counts of both added."""
        return self.tiers.batch_query(batch, key=key)

    def get_labels(self, keys: DataFrame) -> DataFrame:
        return labels.get_labels(self.tiers.query(keys), keys, self.spec)

    def space(self) -> DataFrame:
        """One row (percent): how much of the disk's slots both tiers occupy, each for itself."""
        tiers = layout.occupied(self.base(), self.spec).unionAll(layout.occupied(self.delta(), self.spec))
        return tiers.agg((F.sum("slots") * 100 / self.spec.all_slots).cast("int").alias("percent"))

    def as_set(self) -> CountedSet:
        """Both tiers as one set, for merges, products and all else."""
        return CountedSet(self.items(), self.spec)

    def dump(self) -> DataFrame:
        """What each block holds, of the base (tier 0) and of the insertions that wait."""
        tiers = [layout.dump(t, self.spec).withColumn("tier", F.lit(i)) for i, t in enumerate((self.base(), self.delta()))]
        return tiers[0].unionByName(tiers[1])

    # streams

    def feed(self, stream: DataFrame, checkpoint: str, *, key: str, n: str | None = None, **trigger) -> StreamingQuery:
        """Start counting a stream into the delta, one batch each trigger; by default all that is there."""

        def one(rows: DataFrame, number: int) -> None:
            self.insert(rows, f"batch-{number:012d}", key=key, n=n)

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_counts(stream: DataFrame, spec: FilterSpec, *, key: str) -> DataFrame:
    """Counts of a stream in the state store, for inserts only (complete or update mode)."""
    return counted.build(stream, spec, key=key)


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(stream: DataFrame, *, time: str, key: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """(start, key, count) over tumbling or, with slide, overlapping windows; rows later than `late` behind the newest are dropped."""
    timed = _timed(stream, time, late).groupBy(F.window(time, width, slide).alias("w"), F.col(key).alias("key"))
    return timed.agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "key", "count")


def session_counts(stream: DataFrame, *, time: str, key: str, late: str, gap: str) -> DataFrame:
    """(start, end, key, count) of each key's runs of rows with less than `gap` between them."""
    timed = _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key"))
    return timed.agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "count")


def without_repeats(stream: DataFrame, *, time: str, late: str, by: list[str]) -> DataFrame:
    """The rows, of those equal in `by` within the watermark the first."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(by)


def scratch(root: str) -> str:
    """A folder of one's own below `root`."""
    return f"{root}/countloom-{uuid.uuid4().hex}"
