"""Benchmark decontamination over a stored positional inverted index of the documents.

The index is a table of segments, each over some SEGMENT_BYTES of text: a segment has the sorted terms (hashed words)
of its documents and the postings of each, its positions in the segment in order.  A benchmark window
is answered in a segment from its rarest term: that term's positions less its offset are the candidate starts, and the
other terms' postings, less their offsets, are intersected with them, rarer ones first; all windows go
through these steps together, as arrays.  A segment knows its documents whole, so a hit needs no shuffle, however often
a word or a passage occurs.

A benchmark of up to BROADCAST_BYTES of text is sent to all segments, and each picks the rarest terms by its own
counts.  A larger one stays a table: its windows are joined to the segments by the term that is rarest in
the whole corpus, so that a segment gets those windows only that it can hold, in blocks of about BLOCK_WINDOWS.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, cut, give_back, unused, utf8_list

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # on UTF-8 with A-Z lowered: every character outside ASCII is a word's
WIDTH = 10
#: Text of one segment.
SEGMENT_BYTES = 4 << 20
#: Benchmark text that may be collected and broadcast.
BROADCAST_BYTES = 4 << 20
#: Windows that one segment is asked for at a time, where the benchmark is larger.
BLOCK_WINDOWS = 100_000
#: Candidate places looked at together.
CANDIDATES = 500_000
#: Positions between two documents of a segment, so that nothing reaches from one into the next (twice the slop must be
#: less), and room that a window may ask for beyond a segment's ends.
GAP, ROOM = 32, 4096


def words_of(raw: bytes | None) -> list[bytes]:
    return WORDS.findall(raw.lower()) if raw else []


def terms_of(raw: bytes | None) -> np.ndarray:
    """Hashes of the words, in order, as signed numbers."""
    words = words_of(raw)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) for all members of ranges that begin at `starts`."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[which]


class Windows:
    """Distinct windows as rows of terms (shorter ones filled up with their first term), and the items that have each."""

    def __init__(self, rows: dict[tuple[int, ...], set[int]], width: int = WIDTH):
        self.length = np.array([len(w) for w in rows], np.int64)
        self.terms = np.array([w + (w[0],) * (width - len(w)) for w in rows], np.int64).reshape(len(rows), width)
        self.items = [sorted(i) for i in rows.values()]


def windows_of(items: list[tuple[int, bytes | None]], width: int = WIDTH) -> dict[tuple[int, ...], set[int]]:
    """Windows of benchmark items; an item of fewer words, but not none, is one."""
    found: dict[tuple[int, ...], set[int]] = {}
    for item, raw in items:
        terms = terms_of(raw).tolist()
        for start in range(max(1, len(terms) - width + 1) if terms else 0):
            found.setdefault(tuple(terms[start : start + width]), set()).add(item)
    return found


class Segment:
    """Terms in order, where the postings of each begin, and all postings; documents by their first positions."""

    def __init__(self, begins: np.ndarray, lengths: np.ndarray, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray):
        self.begins, self.lengths, self.terms, self.starts, self.positions = begins, lengths, terms, starts.astype(np.int64), positions
        self.counts = np.diff(self.starts)
        #: Postings as one sorted sequence: the term's number, then the position.
        self.size = np.int64((int(begins[-1]) + int(lengths[-1]) if len(begins) else 0) + 4 * ROOM)
        self.keys = np.repeat(np.arange(len(terms)), self.counts) * self.size + positions + ROOM

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Segment:
        """The segment of some documents' terms."""
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths + GAP) - lengths - GAP
        every = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        place = np.arange(len(every)) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
        order = np.argsort(every, kind="stable")
        every = every[order]
        new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        return cls(begins, lengths, every[new], np.append(new, len(every)), place[order])

    def within(self, term: np.ndarray, low: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term of each number has a position from `low` to `low` + 2 * slop."""
        key = term * self.size + low + ROOM
        at = np.searchsorted(self.keys, key)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] <= key[found] + 2 * slop
        return found

    def search(self, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all places from which each term of a window stands within `slop` words of its place."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.terms) or not len(windows.terms):
            return nothing
        number = np.searchsorted(self.terms, windows.terms)
        number[number == len(self.terms)] = 0
        alive = np.flatnonzero((self.terms[number] == windows.terms).all(axis=1))
        if not len(alive):
            return nothing
        number, length = number[alive], windows.length[alive]
        offsets = np.arange(number.shape[1])
        offsets = np.where(offsets < length[:, None], offsets, 0)  # the filling asks for the first term again
        order = np.argsort(self.counts[number], axis=1, kind="stable")
        number, offsets = np.take_along_axis(number, order, 1), np.take_along_axis(offsets, order, 1)
        # some windows at a time, so that a term which stands everywhere in the segment needs no more room than others
        so_far = np.cumsum(self.counts[number[:, 0]] * (2 * slop + 1)) // CANDIDATES
        found = [self._places(alive[k], number[k], offsets[k], slop) for k in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(so_far)) + 1)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _places(self, alive: np.ndarray, number: np.ndarray, offsets: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of windows whose terms come by number, the rarest first."""
        which, at = spread(self.starts[number[:, 0]], self.counts[number[:, 0]])
        start = self.positions[at].astype(np.int64) - offsets[which, 0]
        if slop:
            which, start = np.repeat(which, 2 * slop + 1), (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            both = np.unique(which * (4 * self.size) + start + self.size)
            which, start = both // (4 * self.size), both % (4 * self.size) - self.size
        for k in range(1, number.shape[1]):
            keep = self.within(number[which, k], start + offsets[which, k] - slop, slop)
            which, start = which[keep], start[keep]
        return alive[which], start

    def document(self, position: np.ndarray) -> np.ndarray:
        """Number of the document that a position lies in."""
        return np.searchsorted(self.begins, position, side="right") - 1

    def matches(self, windows: Windows, slop: int) -> dict[int, tuple[list, set, set]]:
        """Document number: (exact spans, items found exactly, items found nearby), where there are any."""
        out: dict[int, tuple[list, set, set]] = {}
        which, start = self.search(windows)
        doc = self.document(start)
        first = start - self.begins[doc] if len(doc) else start
        for d, w, a in zip(doc.tolist(), which.tolist(), first.tolist(), strict=True):
            own = out.setdefault(d, ([], set(), set()))
            own[0].append((a, a + int(windows.length[w])))
            own[1].update(windows.items[w])
        if slop:
            which, start = self.search(windows, slop)
            long = windows.length[which] > 1
            which, start = which[long], start[long]
            near = np.unique(np.stack([self.document(start + slop), which]), axis=1)
            for d, w in near.T.tolist():
                out.setdefault(d, ([], set(), set()))[2].update(windows.items[w])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SEGMENTS = "segment bigint, docs array<bigint>, begins array<int>, lengths array<int>, terms array<bigint>, starts array<int>, positions array<int>"
KINDS = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())
NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def slices(raw: list[bytes | None], most: int):
    """Ranges of texts of about `most` bytes together."""
    start = size = 0
    for i, t in enumerate(raw):
        size += len(t or b"")
        if size >= most or i + 1 == len(raw):
            yield start, i + 1
            start, size = i + 1, 0


def _index(batches):
    """Segments over the documents of a task."""
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def segment():
        s = Segment.of(texts)
        columns = number, ids, s.begins, s.lengths, s.terms, s.starts, s.positions
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True):
            ids.append(i)
            texts.append(terms_of(t))
            size += len(t or b"") + 64
            if size >= SEGMENT_BYTES:
                yield segment()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield segment()
    give_back()


def index(docs: DataFrame) -> DataFrame:
    """The index of all rows of `docs` as a table of segments, which may be stored and searched any time."""
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_index, SEGMENTS)


def _segments(batch):
    """(number, ids, segment) of stored rows."""
    for k in range(batch.num_rows):
        row = [batch.column(n)[k] for n in NAMES]
        own = [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in row[2:]]
        yield row[0].as_py(), row[1].values, Segment(own[0].astype(np.int64), own[1].astype(np.int64), *own[2:])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
LONGS = pa.list_(pa.int64())
FOUND = "spans array<struct<start:int,end:int>>, items array<bigint>, near_items array<bigint>"
MATCHES = f"doc_id bigint, n_words bigint, {FOUND}"


def _all(found: dict, which) -> list[pa.Array]:
    """Spans and items of documents, by number."""
    none = [], (), ()
    rows = [found.get(d, none) for d in which]
    spans = pa.array([[{"start": a, "end": b} for a, b in merged(r[0])] for r in rows], SPANS)
    return [spans, *(pa.array([sorted(r[k]) for r in rows], LONGS) for k in (1, 2))]


def _search(sent, slop, batches):
    """One row for each document of a segment."""
    for batch in batches:
        for _, ids, segment in _segments(batch):
            found = segment.matches(sent.value, slop)
            columns = [ids, pa.array(segment.lengths), *_all(found, range(len(ids)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items", "near_items"])


def _search_own(slop, width, batches):
    """Rows of the documents that windows joined to a segment match."""
    for batch in batches:
        asked = batch.column("asked").to_pylist()
        for (number, _, segment), own in zip(_segments(batch), asked, strict=True):
            found = segment.matches(Windows({tuple(a["w"]): set(a["items"]) for a in own}, width), slop)
            docs = sorted(found)
            columns = [pa.array([number] * len(docs), pa.int64()), pa.array(docs, pa.int32()), *_all(found, docs)]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "k", "spans", "items", "near_items"])


def _windows(width, batches):
    for batch in batches:
        found = windows_of(list(zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True)), width)
        rows = [(list(w), i) for w, items in found.items() for i in items]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], LONGS), pa.array([r[1] for r in rows], pa.int64())], ["w", "item"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].alias("text")).filter("item_id is not null and text is not null")


def send(benchmark: DataFrame, width: int):
    """The benchmark's windows as a broadcast, or None if its text is larger than BROADCAST_BYTES."""
    own = _items(benchmark)
    if (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        return None
    rows = [(r["item_id"], r["text"].encode()) for r in own.collect()]  # of checked size
    return benchmark.sparkSession.sparkContext.broadcast(Windows(windows_of(rows, width), width))


def _joined(segments: DataFrame, benchmark: DataFrame, width: int, slop: int) -> DataFrame:
    """(segment, k, spans, items, near_items) of the documents with matches, by a join on the windows' rarest terms."""
    windows = _items(benchmark).mapInArrow(functools.partial(_windows, width), "w array<bigint>, item bigint")
    windows = cut(windows.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items")))
    blocks = -(-windows.count() // BLOCK_WINDOWS) or 1
    wanted = windows.select("w", F.explode(F.array_distinct("w")).alias("term"))
    size = F.zip_with(F.slice("starts", 1, F.size("terms")), F.slice("starts", 2, F.size("terms")), lambda a, b: b - a)
    held = segments.filter(F.size("terms") > 0).select("segment", F.explode(F.arrays_zip("terms", size.alias("n"))).alias("t"))
    held = held.select("segment", F.col("t.terms").alias("term"), F.col("t.n").alias("n")).join(wanted.select("term").distinct(), "term")
    often = held.groupBy("term").agg(F.sum("n").alias("n"))
    rarest = wanted.join(often, "term").groupBy("w").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count("*").alias("present"))
    rarest = rarest.filter(F.col("present") == F.size(F.array_distinct("w"))).select("w", "term")
    seeds = windows.join(rarest, "w")
    asked = held.select("segment", "term").join(seeds, "term").select("segment", F.pmod(F.xxhash64("w"), F.lit(blocks)).alias("block"), F.struct("w", "items").alias("a"))
    asked = asked.groupBy("segment", "block").agg(F.collect_list("a").alias("asked")).drop("block")
    found = segments.join(asked, "segment").select(*NAMES, "asked").mapInArrow(functools.partial(_search_own, slop, width), f"segment bigint, k int, {FOUND}")
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    items, near = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) for c in ("items", "near_items"))
    return found.groupBy("segment", "k").agg(spans.alias("spans"), items.alias("items"), near.alias("near_items"))


def _disjoint(spans: Column) -> Column:
    """Sorted spans merged where they overlap or touch."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, s):
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, none, add)


def matches(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, slop: int = 3) -> DataFrame:
    """(doc_id, n_words, spans, items, near_items) of every row.

    spans: disjoint word ranges that exact windows cover; items: sorted item_ids with an
    exact window; near_items (with slop): those with a window of two words or more each of whose words stands within
    `slop` words of its place.  Null and empty texts have no words and nothing matches them; items
    without an id or without words match nothing; items of one id are taken together; a
    repeated document gives a row each time, and windows that tie for a place all count; very long texts are searched whole; empty
    tables give no rows, or rows without matches; other columns, whatever their names, are not read.
    """
    return search(cut(index(docs)), benchmark, width=width, slop=slop)


def search(segments: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, slop: int = 3) -> DataFrame:
    """matches() of the documents that a stored index holds."""
    if not 0 <= 2 * slop < GAP or not 0 < width <= ROOM // 2:
        raise ValueError(f"slop must be below {GAP // 2}, width at most {ROOM // 2}")
    bounded_batches(segments.sparkSession)
    sent = send(benchmark, width)
    if sent is not None:
        return segments.mapInArrow(functools.partial(_search, sent, slop), MATCHES)
    found = _joined(segments, benchmark, width, slop)
    each = segments.select("segment", F.posexplode(F.arrays_zip("docs", "lengths")).alias("k", "d"))
    empty = F.array().cast("array<bigint>")
    return each.join(found, ["segment", "k"], "left").select(
        F.col("d.docs").alias("doc_id"),
        F.col("d.lengths").cast("bigint").alias("n_words"),
        _disjoint(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
        F.coalesce("items", empty).alias("items"),
        F.coalesce("near_items", empty).alias("near_items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row, with slop also n_near_items; see matches()."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    columns = [
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        digest.alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    ]
    near = [F.size("near_items").cast("bigint").alias("n_near_items")] if slop else []
    return matches(docs, benchmark, width=width, slop=slop).select(*columns, *near)


def oracle_sql(width: int = WIDTH, slop: int = 3) -> str:
    """contamination() of `documents` against `benchmark` as DuckDB SQL, for tables without repeated ids."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""with d as (select doc_id, {words} as w from documents),
b as (select item_id, {words} as w from benchmark),
windows as (select distinct item_id, least(len(w), {width}) as n, w[i:i + {width - 1}] as g from (select item_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) as i from b where len(w) > 0) t),
starts as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows) s where len(w) >= n),
hits as (select doc_id, i, t.n, item_id from (select doc_id, i, n, w[i:i + n - 1] as g from starts) t join windows using (n, g)),
covered as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits) h) c group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as s from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) i group by doc_id),
p as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as pos from d),
often as (select t, count(*) as c from p group by t),
wins as (select g, n, row_number() over (order by g) as wid from (select distinct g, n from windows where n > 1) x),
wt as (select wid, n, unnest(g) as t, generate_subscripts(g, 1) as k from wins),
seed as (select wid, arg_min(t, c * 100 + k) as t, arg_min(k, c * 100 + k) as k from wt left join often using (t) group by wid, n having count(c) = n),
cand as (select distinct wid, doc_id, pos - k + shift as start from seed join p using (t), (select unnest(range(-{slop}, {slop + 1})) as shift) x),
near as (select distinct wid, doc_id from (select c.wid, c.doc_id, c.start from cand c join wt on wt.wid = c.wid join p on p.doc_id = c.doc_id and p.t = wt.t and p.pos between c.start + wt.k - {slop} and c.start + wt.k + {slop} group by 1, 2, 3, wt.n having count(distinct wt.k) = wt.n) y),
nearby as (select doc_id, count(distinct item_id) as n_near_items from near join wins using (wid) join windows using (g, n) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near_items, 0) as n_near_items
from d left join covered using (doc_id) left join items using (doc_id) left join nearby using (doc_id)"""


def _keep(sent, text_at, batches):
    for batch in batches:
        raw = utf8_list(batch.column(text_at))
        kept = np.ones(len(raw), bool)
        for start, stop in slices(raw, SEGMENT_BYTES):
            segment = Segment.of([terms_of(t) for t in raw[start:stop]])
            kept[start + segment.document(segment.search(sent.value)[1])] = False
        yield batch.filter(pa.array(kept))
    give_back()


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """The rows of `docs`, all columns, in which no window occurs.

    Each row is judged by its own text, whatever its doc_id, repeated ones alike; null and empty texts stay.  A benchmark that is too
    large to be sent to the rows is joined with their index; for that the rows are numbered, and written with their numbers.
    """
    bounded_batches(docs.sparkSession)
    sent = send(benchmark, width)
    if sent is not None:
        return docs.mapInArrow(functools.partial(_keep, sent, docs.columns.index("text")), docs.schema)
    row = unused(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = matches(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, width=width, slop=0)
    leaks = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias(row))
    return numbered.join(leaks, row, "left_anti").select(docs.columns)
