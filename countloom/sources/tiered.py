"""A counted set on storage in key ranges and generations: changes are appended, and only the ranges that they touch are rewritten.

The keys are cut into ranges once, at quantiles.  Every generation, the base's or one change's, is written in these ranges, one
file each, as a bucketed table: Spark then knows that all rows of a range lie in one partition, so the scan that
merges the generations needs no shuffle, and one that is asked for few ranges opens their files alone.  Which generations hold
in which range, with rows, counts, slots, digest and least and greatest key of each, is told by a manifest; the newest complete
one counts, and has the parameters.  A change of the set is a new manifest, so a run that breaks off leaves the old one.

Generations apply in their order: insertions add (up to the saturation), removals take down to none and
clear the label, labels go to keys that are there.  Neighbours of one kind are combined by one sum, so that the merge stays one aggregation.
"""

from __future__ import annotations

import bisect
import copy
import hashlib
import json
import re
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom.functions.expressions import key_order, label_fits, slots
from countloom.operators import counted
from countloom.operators.algebra import differences
from countloom.operators.ranges import settled
from countloom.plans.spec import FilterSpec

#: Ranges of a new set at least and at most, rows that a range should have, and how many times as many make it be cut anew.
RANGES, MOST_RANGES, ROWS, WIDEST = 8, 16_384, 1_000_000, 4
#: Keys asked for that may be sent to the ranges.
SENT = 100_000
#: So many generations of insertions of one level become one of the next.
FAN = 8
#: Seconds after which an unfinished manifest counts as given up.
GIVEN_UP = 60
BASE, INSERT, REMOVE, LABEL = "base", "insert", "remove", "label"
COLUMNS = ["part", "range", "key", "count", "label", "gen"]
#: Items that an iteration fetches at a time.
PAGE = 10_000
#: Digests are sums of hashes modulo this.
DIGESTS = 1 << 64


def spark_hash(value: int) -> int:
    """Spark's hash of an INT: Murmur3 of 32 bits with seed 42, signed."""
    k = value * 0xCC9E2D51 & 0xFFFFFFFF
    k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
    h = 42 ^ k
    h = (h << 13 & 0xFFFFFFFF | h >> 19) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def parts_of(n: int) -> list[int]:
    """A number for each of n ranges that Spark's hash brings to the bucket of the range's own number."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < n:
        found.setdefault(spark_hash(value) % n, value)
        value += 1
    return [found[k] for k in range(n)]


class Conflict(RuntimeError):
    """Another writer changed what a change was made from."""


def _note(marks: dict, batch: str) -> None:
    """Remember a batch: numbered ones of a source by the mark up to which all are known, others by name."""
    source, number = re.fullmatch(r"(.*?)(\d*)", batch, re.S).groups()
    if not number or str(int(number)).zfill(len(number)) != number:
        source, number = batch, ""
    if not number:
        marks["names"] = sorted({*marks["names"], batch})
        return
    upto, above = marks["sources"].get(f"{source}#{len(number)}", [-1, []])
    above = {*above, int(number)} if int(number) > upto else set(above)
    while upto + 1 in above:
        upto += 1
        above.remove(upto)
    marks["sources"][f"{source}#{len(number)}"] = [upto, sorted(above)]


def _noted(marks: dict, batch: str) -> bool:
    source, number = re.fullmatch(r"(.*?)(\d*)", batch, re.S).groups()
    if number:
        upto, above = marks["sources"].get(f"{source}#{len(number)}", [-1, []])
        if int(number) <= upto or int(number) in above:
            return True
    return batch in marks["names"]


class TieredSet:
    """A stored counted set; `ranges`: how many key ranges a new one has, by default as many as its first rows need.

    `like`: another set whose ranges a new one takes over, so that both can be compared and merged range by range.
    """

    def __init__(self, spark: SparkSession, path: str, spec: FilterSpec | None = None, *, ranges: int | None = None, like: TieredSet | None = None):
        self.spark, self.path, self.wanted_ranges = spark, path.rstrip("/"), ranges
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: set[tuple[str, int]] = set()
        found = self._newest()[1]
        stored = FilterSpec.from_json(found["spec"]) if found["spec"] else None
        if stored is None and spec is None:
            raise ValueError("a new stored set needs its parameters")
        if stored is not None and spec is not None and stored != spec:
            raise ValueError("the stored set has other parameters")
        self.spec = stored or spec
        if stored is None:
            alike = like.manifest() if like is not None else {}
            self._create(0, self._empty() | {"spec": spec.to_json()} | {k: alike[k] for k in ("cuts", "parts") if k in alike})

    @staticmethod
    def _empty() -> dict:
        return {"spec": None, "epoch": 0, "version": 0, "cuts": None, "parts": [], "gens": [], "marks": {"names": [], "sources": {}}, "dead": []}

    # manifests

    def _names(self, folder: str) -> list[str]:
        where = self.fs_path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def _read(self, number: int) -> dict | None:
        """A manifest, None if it isn't complete."""
        stream = self.fs.open(self.fs_path(f"{self.path}/manifest/{number:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict]:
        """(number of the newest manifest there is, the newest complete one); waits for one that is being written."""
        numbers = [int(n[:-5]) for n in self._names("manifest") if n.endswith(".json")]
        for number in reversed(numbers):
            while (found := self._read(number)) is None:
                age = time.time() - self.fs.getFileStatus(self.fs_path(f"{self.path}/manifest/{number:09d}.json")).getModificationTime() / 1000
                if age > GIVEN_UP:
                    break
                time.sleep(0.05)
            if found is not None:
                return numbers[-1], found
        return -1, self._empty()

    def manifest(self) -> dict:
        return self._newest()[1]

    def _create(self, number: int, manifest: dict) -> bool:
        """Write a manifest; False if another writer has that number."""
        try:
            stream = self.fs.create(self.fs_path(f"{self.path}/manifest/{number:09d}.json"), False)
        except Exception as e:  # py4j wraps the file system's own exceptions
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return True

    def _commit(self, change: Callable[[dict], dict | None]) -> dict | None:
        """Apply `change` to the newest manifest; again if another writer comes first.  None from `change` leaves all as it is."""
        while True:
            number, now = self._newest()
            new = change(copy.deepcopy(now))
            if new is None:
                return None
            if self._create(number + 1, new):
                self._clean(now["dead"], number)
                return new

    def _clean(self, dead: list, number: int) -> None:
        """Delete what the manifest before the last made superfluous: whoever reads the last one needs it no more."""
        for folder, held in dead:
            for bucket in held if held is not None else [None]:
                where = self.fs_path(f"{self.path}/{folder}")
                if bucket is None:
                    self.fs.delete(where, True)
                else:
                    for name in self._names(folder):
                        if re.search(rf"_{bucket:05d}\.c\d+", name):
                            self.fs.delete(self.fs_path(f"{self.path}/{folder}/{name}"), False)
        for old in range(number - 2, -1, -1):
            if not self.fs.delete(self.fs_path(f"{self.path}/manifest/{old:09d}.json"), False):
                break
        if dead:
            for name in {n for n, _ in self._known}:
                self.spark.catalog.refreshTable(name)

    # the table

    def _table(self, m: dict) -> str:
        """The bucketed table of an epoch, with the partitions that the manifest names."""
        folder = f"{self.path}/data-{m['epoch']}"
        name = f"countloom_{hashlib.md5(folder.encode()).hexdigest()}"
        if (name, -1) not in self._known:
            self.spark.sql(
                f"create table if not exists {name} (part int, range int, key bigint, count bigint, label bigint, gen bigint) using parquet "
                f"partitioned by (gen) clustered by (part) sorted by (key) into {len(m['parts'])} buckets location '{folder}'"
            )
            self._known.add((name, -1))
        missing = [g["gen"] for g in m["gens"] if (name, g["gen"]) not in self._known]
        if missing:
            self.spark.sql(f"alter table {name} add if not exists " + " ".join(f"partition (gen={g})" for g in missing))
            self._known.update((name, g) for g in missing)
        return name

    def _cut(self, rows: DataFrame) -> tuple[list[float], list[int]]:
        """Where the ranges begin, at quantiles of these rows, and the ranges' numbers in the table."""
        own = rows.select(key_order("key", self.spec).cast("double").alias("o"))
        n = self.wanted_ranges or max(RANGES, min(MOST_RANGES, -(-own.count() // ROWS)))
        cuts = sorted(set(own.approxQuantile("o", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
        return cuts, parts_of(len(cuts) + 1)

    def _ranged(self, rows: DataFrame, m: dict) -> DataFrame:
        """Adds range and part."""
        own = rows.withColumn("o", key_order("key", self.spec).cast("double"))
        if m["cuts"]:
            own = Bucketizer(splits=[-float("inf"), *m["cuts"], float("inf")], inputCol="o", outputCol="b").transform(own)
        own = own.withColumn("range", F.col("b").cast("int") if m["cuts"] else F.lit(0))
        return own.withColumn("part", F.get(F.lit(m["parts"]), F.col("range")).cast("int")).drop("o", "b")

    def range_of(self, key: int, m: dict) -> int:
        order = key if self.spec.key_bits < 64 else key ^ -(1 << 63)
        return bisect.bisect_right(m["cuts"], float(order))

    def _claim(self) -> int:
        """A generation number of one's own."""
        taken = [int(n) for n in self._names("claims")]
        n = max(taken, default=0) + 1
        while not self.fs.createNewFile(self.fs_path(f"{self.path}/claims/{n:012d}")):
            n += 1
        for old in taken[:-1]:
            self.fs.delete(self.fs_path(f"{self.path}/claims/{old:012d}"), False)
        return n

    def _write(self, rows: DataFrame, m: dict, kind: str, *, level: int = 0, placed: bool = False) -> dict:
        """A generation of distinct keys; `placed` rows lie in their ranges' partitions already.

        Its figures come from one aggregation over the files just written, in place.
        """
        gen, name = self._claim(), self._table(m)
        own = rows if placed else self._ranged(rows, m).repartition(len(m["parts"]), "part")
        own.select("part", "range", "key", "count", "label", F.lit(gen).cast("bigint").alias("gen")).write.insertInto(name)
        self._known.add((name, gen))
        order = key_order("key", self.spec)
        figures = self.spark.table(name).filter(F.col("gen") == gen).groupBy("part", "range").agg(
            F.count("*").alias("rows"),
            F.sum("count").alias("total"),
            F.sum(slots("count", self.spec)).alias("slots"),
            F.sum(F.xxhash64("key", "count", "label").cast("decimal(38,0)")).alias("digest"),
            F.min(order).alias("least"),
            F.max(order).alias("most"),
        )
        held = {str(r["range"]): [r["rows"], r["total"], r["slots"], int(r["digest"]) % DIGESTS, r["least"], r["most"]] for r in figures.collect()}  # a row a range
        return {"gen": gen, "kind": kind, "level": level, "ranges": held, "whole": True, "batches": []}

    def _cut_first(self, rows: DataFrame) -> dict:
        """The manifest, with ranges: the first rows decide where they are cut."""
        m = self.manifest()
        if m["cuts"] is None:
            cuts, parts = self._cut(rows)

            def first(now: dict) -> dict | None:
                return now | {"cuts": cuts, "parts": parts} if now["cuts"] is None else None

            self._commit(first)
            m = self.manifest()
        return m

    # reading

    def _live(self, m: dict, kinds: Iterable[str] | None = None, ranges: Iterable[int] | None = None) -> DataFrame:
        """The rows (part, range, key, count, label, gen) that hold, of some kinds and ranges."""
        gens = [g for g in m["gens"] if kinds is None or g["kind"] in kinds]
        wanted = None if ranges is None else set(ranges)
        gens = [g for g in gens if wanted is None or any(int(r) in wanted for r in g["ranges"])]
        if not gens:
            return self.spark.createDataFrame([], "part int, range int, key bigint, count bigint, label bigint, gen bigint")
        rows = self.spark.table(self._table(m)).filter(F.col("gen").isin([g["gen"] for g in gens]))
        if wanted is not None:
            rows = rows.filter(F.col("part").isin([m["parts"][r] for r in sorted(wanted)]))
        for g in gens:
            if not g["whole"]:
                mask = [str(r) in g["ranges"] for r in range(len(m["parts"]))]
                rows = rows.filter((F.col("gen") != g["gen"]) | F.get(F.lit(mask), F.col("range")))
        return rows

    def _fold(self, rows: DataFrame, m: dict) -> DataFrame:
        """(part, range, key, count, label) after all generations, in one aggregation in place."""
        runs: list[tuple[str, list[int]]] = []
        for g in m["gens"]:
            if g["kind"] != BASE:
                if runs and runs[-1][0] == g["kind"]:
                    runs[-1][1].append(g["gen"])
                else:
                    runs.append((g["kind"], [g["gen"]]))
        base = F.col("gen").isin([g["gen"] for g in m["gens"] if g["kind"] == BASE])
        columns = [F.max(F.when(base, F.col("count"))).alias("b"), F.max(F.when(base, F.col("label"))).alias("l")]
        for i, (kind, gens) in enumerate(runs):
            here = F.col("gen").isin(gens)
            columns.append((F.max_by(F.when(here, F.col("label")), F.when(here, F.col("gen"))) if kind == LABEL else F.sum(F.when(here, F.col("count")))).alias(f"r{i}"))
        count, label = F.coalesce("b", F.lit(0)), F.coalesce("l", F.lit(0))
        for i, (kind, _) in enumerate(runs):
            value = F.col(f"r{i}")
            if kind == INSERT:
                count = counted.saturated(count + F.coalesce(value, F.lit(0)), self.spec)
            elif kind == REMOVE:
                count, label = F.greatest(count - F.coalesce(value, F.lit(0)), F.lit(0)), F.when(value.isNull(), label).otherwise(0)
            else:
                label = F.when(value.isNull() | (count <= 0), label).otherwise(value)
        folded = rows.groupBy("part", "range", "key").agg(*columns)
        return folded.select("part", "range", "key", count.cast("bigint").alias("count"), label.cast("bigint").alias("label")).filter("count > 0")

    def _items(self, m: dict, ranges: Iterable[int] | None = None) -> DataFrame:
        return self._fold(self._live(m, ranges=ranges), m)

    def items(self) -> DataFrame:
        """(key, count, label): what all changes so far amount to."""
        return self._items(self.manifest()).select("key", "count", "label")

    # changes

    def load(self, items: DataFrame) -> None:
        """Items of distinct keys as the base of an empty set."""
        if self.manifest()["cuts"] is None:
            items = settled(items)  # read for the ranges' cuts, too
        m = self._cut_first(items)
        made = self._write(items.select("key", "count", "label"), m, BASE)

        def add(now: dict) -> dict:
            if now["gens"] or now["epoch"] != m["epoch"]:
                raise Conflict("the set isn't empty")
            return now | {"gens": [made], "version": now["version"] + 1, "dead": []}

        self._commit(add)

    def _append(self, rows: DataFrame, kind: str, batch: str | None, check: Callable[[dict, dict], None] | None = None, *, placed: bool = False) -> bool:
        """One change as a generation; False if a batch of that name is known."""
        if batch is not None and _noted(self.manifest()["marks"], batch):
            return False
        if self.manifest()["cuts"] is None:
            rows = settled(rows)
        m = self._cut_first(rows)
        made = self._write(rows, m, kind, placed=placed) | {"batches": [batch] if batch is not None else []}

        def add(now: dict) -> dict | None:
            if batch is not None and _noted(now["marks"], batch):
                return None
            if now["epoch"] != m["epoch"]:
                raise Conflict("the ranges were cut anew meanwhile")
            new = now | {"gens": now["gens"] + [made], "dead": []}
            if batch is not None:
                _note(new["marks"], batch)
            if check is not None:
                check(now, new)
            return new

        try:
            done = self._commit(add)
        except Conflict:
            self._drop(m, made)
            return self._append(rows.select("key", "count", "label"), kind, batch, check)
        except OverflowError:
            self._drop(m, made)
            raise
        if done is None:
            self._drop(m, made)
            return False
        if kind == INSERT:
            self._gather()
        return True

    def _drop(self, m: dict, made: dict) -> None:
        self.fs.delete(self.fs_path(f"{self.path}/data-{m['epoch']}/gen={made['gen']}"), True)

    def insert(self, rows: DataFrame, batch: str | None = None, *, key: str = "key", n: str | None = None, check: Callable[[dict, dict], None] | None = None) -> bool:
        """Count rows; a batch of a name that is known is left out."""
        return self._append(counted.build(rows, self.spec, key=key, n=n), INSERT, batch, check)

    def absorb(self, other: TieredSet, batch: str | None = None) -> bool:
        """Add another stored set's counts; one that is cut alike is read, merged and written range by range, without a shuffle."""
        self.spec.require_same_keys(other.spec)
        m, theirs = self.manifest(), other.manifest()
        none = F.lit(0).cast("bigint").alias("label")
        if m["cuts"] is None or m["cuts"] != theirs["cuts"] or m["parts"] != theirs["parts"]:
            return self._append(other.items().select("key", "count", none), INSERT, batch)
        return self._append(other._items(theirs).select("part", "range", "key", "count", none), INSERT, batch, placed=True)

    def remove(self, rows: DataFrame, batch: str | None = None, *, key: str = "key", n: str | None = None) -> bool:
        """Take counts, down to none; a key that something was taken from loses its label."""
        whole = FilterSpec(**(json.loads(self.spec.to_json()) | {"maximum_count": None}))
        return self._append(counted.build(rows, whole, key=key, n=n), REMOVE, batch)

    def set_labels(self, assigned: DataFrame, batch: str | None = None) -> bool:
        """Labels (key, label) of the keys that are there; of several for one key the largest."""
        rows = assigned.select(counted._key("key", self.spec).alias("key"), label_fits("label", self.spec).alias("label")).filter("key is not null")
        return self._append(rows.groupBy("key").agg(F.max("label").alias("label")).select("key", F.lit(0).cast("bigint").alias("count"), "label"), LABEL, batch)

    def _replaced(self, now: dict, used: list[tuple[int, str]], made: dict) -> dict:
        """The manifest in which a new generation stands for ranges of others."""
        live = {(g["gen"], r) for g in now["gens"] for r in g["ranges"]}
        if not live.issuperset(used):
            raise Conflict("some of the ranges were merged meanwhile")
        gone: dict[int, set[str]] = {}
        for gen, r in used:
            gone.setdefault(gen, set()).add(r)
        gens, dead, at = [], [], None
        for g in now["gens"]:
            out = gone.get(g["gen"])
            if out is None:
                gens.append(g)
                continue
            if at is None:
                at = len(gens)
            rest = {r: s for r, s in g["ranges"].items() if r not in out}
            folder = f"data-{now['epoch']}/gen={g['gen']}"
            dead.append([folder, None if not rest else sorted(map(int, out))])
            if rest:
                gens.append(g | {"ranges": rest, "whole": False})
        if made["kind"] == BASE:
            gens.insert(0, made)
        elif made["ranges"]:
            gens.insert(at or 0, made)
        return now | {"gens": [g for g in gens if g["ranges"]], "dead": dead}

    def _gather(self) -> None:
        """FAN neighbouring generations of insertions of one level become one of the next: each row is rewritten once a level."""
        m = self.manifest()
        run: list[dict] = []
        for g in reversed(m["gens"]):
            if g["kind"] != INSERT or run and g["level"] != run[0]["level"]:
                break
            run.append(g)
        if len(run) < FAN:
            return
        only = m | {"gens": run[::-1]}
        rows = self._live(only).groupBy("part", "range", "key").agg(counted.saturated(F.sum("count"), self.spec).cast("bigint").alias("count"))
        made = self._write(rows.withColumn("label", F.lit(0).cast("bigint")), m, INSERT, level=run[0]["level"] + 1, placed=True)
        made["batches"] = [b for g in run[::-1] for b in g["batches"]]
        used = [(g["gen"], r) for g in run for r in g["ranges"]]
        try:
            self._commit(lambda now: self._replaced(now, used, made))
        except Conflict:
            self._drop(m, made)

    def dirty(self, m: dict | None = None) -> dict[int, int]:
        """Rows of changes that wait in each range."""
        m, out = m or self.manifest(), {}
        for g in m["gens"]:
            if g["kind"] != BASE:
                for r, s in g["ranges"].items():
                    out[int(r)] = out.get(int(r), 0) + s[0]
        return out

    def compact(self, ratio: float = 0) -> list[int]:
        """Merge the changes into the base, in ranges where they have at least `ratio` times the base's rows; the ranges rewritten."""
        while True:
            m = self.manifest()
            rows = {int(r): s[0] for g in m["gens"] if g["kind"] == BASE for r, s in g["ranges"].items()}
            touched = sorted(r for r, n in self.dirty(m).items() if n >= ratio * rows.get(r, 0))
            if not touched:
                return []
            made = self._write(self._items(m, touched), m, BASE, placed=True)
            used = [(g["gen"], r) for g in m["gens"] for r in g["ranges"] if int(r) in touched]
            try:
                self._commit(lambda now: self._replaced(now, used, made) | {"version": now["version"] + 1})
            except Conflict:
                self._drop(m, made)
                continue
            largest = max((s[0] for s in made["ranges"].values()), default=0)
            if self.wanted_ranges is None and largest > WIDEST * ROWS and len(m["parts"]) < MOST_RANGES:
                self.cut_anew()
            return touched

    def cut_anew(self, ranges: int | None = None) -> None:
        """Write the whole set in new ranges, for when it has outgrown the old ones."""
        m = self.manifest()
        wanted, self.wanted_ranges = self.wanted_ranges, ranges or self.wanted_ranges
        try:
            cuts, parts = self._cut(self.items())
        finally:
            self.wanted_ranges = wanted
        new = m | {"epoch": m["epoch"] + 1, "cuts": cuts, "parts": parts, "gens": [], "dead": []}
        made = self._write(self.items(), new, BASE)

        def replace(now: dict) -> dict:
            if now["gens"] != m["gens"]:
                raise Conflict("the set was changed while its ranges were cut anew")
            return new | {"gens": [made] if made["ranges"] else [], "version": now["version"] + 1, "dead": [[f"data-{m['epoch']}", None]]}

        self._commit(replace)

    def release(self) -> None:
        """Take the set's tables out of the session's catalogue; its files stay, and it can be opened again."""
        for name in {n for n, _ in self._known}:
            self.spark.sql(f"drop table if exists {name}")
        self._known.clear()

    def clear(self) -> None:
        """No items; the parameters and the knowledge of batches stay."""
        self._commit(lambda now: now | {"gens": [], "version": now["version"] + 1, "dead": [[f"data-{now['epoch']}/gen={g['gen']}", None] for g in now["gens"]]})

    # lookups that read what they need

    def _asked(self, keys: DataFrame, key: str, m: dict) -> tuple[DataFrame, list[int], DataFrame]:
        """(the distinct keys asked for, the ranges that they lie in, the items (range, key, count, label) of these keys).

        Few keys are sent to the ranges; with many, the items of their ranges are joined with them.
        """
        asked = keys.select(counted._key(key, self.spec).alias("key")).filter("key is not null").distinct()
        found = self._ranged(asked, m).groupBy("range").count().collect()  # a row a range
        ranges = sorted(r["range"] for r in found)
        if sum(r["count"] for r in found) <= SENT:
            items = self._fold(self._live(m, ranges=ranges).join(F.broadcast(asked), "key", "left_semi"), m)
        else:
            items = self._items(m, ranges).join(asked, "key", "left_semi")
        return asked, ranges, items

    def query(self, keys: DataFrame, *, key: str = "key") -> DataFrame:
        """(key, count, label) of the distinct keys asked for, zeros for absent ones; opens the files of their ranges alone."""
        m = self.manifest()
        if m["cuts"] is None:
            return counted.query(counted.empty(self.spark), keys, self.spec, key=key)
        asked, _, items = self._asked(keys, key, m)
        found = items.select("key", "count", "label")
        return asked.join(found, "key", "left").select("key", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("count", "label")))

    def batch_query(self, batch: DataFrame, *, key: str = "key") -> DataFrame:
        """(key, count) of the batch's keys that the set holds; opens the files of their ranges alone."""
        m = self.manifest()
        if m["cuts"] is None:
            return counted.empty(self.spark).select("key", "count")
        return self._asked(batch, key, m)[2].select("key", "count")

    def count_key(self, key: int) -> int:
        m, key = self.manifest(), self.spec.reduce(key)
        if m["cuts"] is None:
            return 0
        rows = self._live(m, ranges=[self.range_of(key, m)]).filter(F.col("key") == key)
        found = self._fold(rows, m).select("count").first()
        return found["count"] if found else 0

    def figures(self) -> dict[int, list]:
        """[rows, total, slots, digest] of every range that has rows: kept ones, and for ranges with changes waiting counted now."""
        m = self.manifest()
        dirty = self.dirty(m)
        out = {int(r): s[:4] for g in m["gens"] if g["kind"] == BASE for r, s in g["ranges"].items() if int(r) not in dirty}
        if dirty:
            own = self._items(m, dirty).groupBy("part", "range").agg(F.count("*").alias("n"), F.sum("count").alias("t"), F.sum(slots("count", self.spec)).alias("s"), F.sum(F.xxhash64("key", "count", "label").cast("decimal(38,0)")).alias("d"))
            out |= {r["range"]: [r["n"], r["t"], r["s"], int(r["d"]) % DIGESTS] for r in own.collect()}
        return out

    def statistics(self) -> dict[str, int]:
        """distinct, total and slots of the set, without reading ranges that no change waits in."""
        rows = list(self.figures().values())
        return {name: sum(r[k] for r in rows) for k, name in enumerate(("distinct", "total", "slots"))}

    def rank(self, keys: DataFrame, *, key: str = "key") -> DataFrame:
        """(key, rank) of the keys asked for that the set holds: 0-based places in key order.

        How many items lie before a range is known, so only the ranges asked for are read; in them, place is
        found by merging the sorted items with the keys.
        """
        m = self.manifest()
        if m["cuts"] is None:
            return counted.empty(self.spark).select("key", F.col("count").alias("rank"))
        before, so_far, figures = [], 0, self.figures()
        for r in range(len(m["parts"])):
            before.append(so_far)
            so_far += figures.get(r, [0])[0]
        asked, ranges, _ = self._asked(keys, key, m)
        inside = Window.partitionBy("part", "range").orderBy(key_order("key", self.spec))
        placed = self._items(m, ranges).withColumn("place", F.row_number().over(inside) - 1)
        return placed.join(asked, "key", "left_semi").select("key", (F.get(F.lit(before), F.col("range")) + F.col("place")).cast("bigint").alias("rank"))

    def page(self, n: int, after: int | None = None) -> tuple[DataFrame, int | None]:
        """(the n items (key, count, label) in key order that follow the key `after`, the cursor for the next page or None at the end).

        Opens one range after the other, until it has n items.
        """
        m, order = self.manifest(), key_order("key", self.spec)
        if m["cuts"] is None:
            return counted.empty(self.spark), None
        out, found, cursor = None, 0, after
        start = 0 if after is None else self.range_of(after, m)
        held = {int(r) for g in m["gens"] for r in g["ranges"]}
        for r in (r for r in range(start, len(m["parts"])) if r in held):
            rows = self._items(m, [r]).select("key", "count", "label")
            if after is not None and r == start:
                rows = rows.filter(order > key_order(F.lit(after).cast("bigint"), self.spec))
            part = rows.orderBy(order).limit(n - found)
            last = part.agg(F.count("*").alias("n"), F.max_by("key", order).alias("key")).first()
            if last["n"]:
                out = part if out is None else out.unionAll(part)
                found, cursor = found + last["n"], last["key"]
            if found == n:
                return out, cursor
        return (counted.empty(self.spark) if out is None else out), None

    def pages(self, n: int, after: int | None = None):
        """All pages from a key on, one DataFrame each."""
        while True:
            rows, after = self.page(n, after)
            yield rows
            if after is None:
                return

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(key, label, count) in key order, a page at a time: no more is read, and held here, than is asked for."""
        for rows in self.pages(PAGE):
            for row in rows.collect():  # a page
                yield row["key"], row["label"], row["count"]

    def differences(self, other: TieredSet) -> DataFrame:
        """(key, c0, l0, c1, l1) of the keys whose counts or labels differ, 0 where a set lacks the key.

        Sets that are cut alike compare their ranges' digests, and only the rows of ranges that differ; others are compared whole.
        """
        self.spec.require_same_keys(other.spec)
        a, b = self.manifest(), other.manifest()
        if a["cuts"] != b["cuts"]:
            return differences(self.items(), other.items())
        mine, theirs = self.figures(), other.figures()
        ranges = [r for r in {*mine, *theirs} if mine.get(r) != theirs.get(r)]
        if not ranges:
            return differences(counted.empty(self.spark), counted.empty(self.spark))
        return differences(*(s._items(m, ranges).select("key", "count", "label") for s, m in ((self, a), (other, b))))

    def equals(self, other: TieredSet) -> bool:
        """Whether keys, counts and labels agree, by the ranges' digests where both sets are cut alike, without a shuffle of rows."""
        self.spec.require_same_keys(other.spec)
        mine, theirs = self.figures(), other.figures()
        if self.manifest()["cuts"] == other.manifest()["cuts"]:
            return mine == theirs
        return all(sum(r[k] for r in mine.values()) % DIGESTS == sum(r[k] for r in theirs.values()) % DIGESTS for k in range(4))

