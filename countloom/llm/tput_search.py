"""Ranked lexical search: TPUT (three phases, uniform threshold) over term-partitioned postings.

The index is a Parquet table.  Terms are dealt to PARTS partitions by their hash; a partition's postings come in blocks, one for
each segment of some SEGMENT_BYTES of text, so that no list, however common its term, lies in one place.  What a partition
answers for an item is a list: its documents with the sum of the scores that the partition's terms give them.

1. Heads: the k highest entries of every list.  The exact scores of the documents met there bound the k-th best score of each item from below.
2. Threshold: with m lists and the bound b, a document with a score of b or more stands in some list with b / m or more.
   Every list sends all entries from there on.
3. Lookups: what those documents have in the lists that did not send them is looked up; the sums are the exact scores.

No document is lost: a bound from below only ever lets more through.  Items are asked in blocks of bounded size, against all
documents each.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, checkpoint_dir, cut, give_back, utf8_list

#: On UTF-8 with A-Z lowered; every character outside ASCII belongs to a term.
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
K = 50
#: Partitions that the terms are dealt to, and so lists an item has at most.
PARTS = 4
#: Text of one segment.
SEGMENT_BYTES = 8 << 20
#: (item, term) pairs and items asked together, and so of what is collected and broadcast, and of the list heads that a task holds;
#: an item is never split, and more items are asked in further rounds.
ITEM_PAIRS, ITEMS = 500_000, 5_000
#: Cells (item, document) that a block works on at a time: a matter of memory only.
CELLS = 4_000_000
#: Lookups that may be broadcast; more are joined.
LOOKUPS = 200_000

INDEX = "part int, segment bigint, ids array<bigint>, lengths array<int>, terms array<bigint>, starts array<int>, rows array<int>, tfs array<int>"
NAMES = [c.split()[0] for c in INDEX.split(", ")]
KINDS = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
PLACE = ["item", "part", "segment", "k", "doc_id", "value"]
PLACES = "item int, part int, segment bigint, k int, doc_id bigint, value bigint"


def terms_of(raw: bytes | None) -> list[bytes]:
    return TERMS.findall(raw.lower()) if raw else []


def term_hash(term: bytes) -> int:
    """A term's number, signed."""
    h = xxhash.xxh64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


def part_of(terms: np.ndarray) -> np.ndarray:
    return terms % PARTS


def block(number: int, ids: list, lengths: list, terms: list, rows: list, tfs: list) -> list:
    """A segment's rows of the index, one a partition."""
    terms, rows, tfs = (np.array(c, np.int64) for c in (terms, rows, tfs))
    order = np.lexsort((rows, terms))
    terms, rows, tfs = terms[order], rows[order], tfs[order]
    out = []
    for p in range(PARTS):
        own = part_of(terms) == p
        t = terms[own]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        out.append((p, number, ids, lengths, t[first], np.append(first, len(t)), rows[own], tfs[own]))
    return out


def _index(sent, batches):
    number, wanted = TaskContext.get().partitionId() << 32, None if sent is None else sent.value
    ids, lengths, terms, rows, tfs, size = [], [], [], [], [], 0

    def segment():
        made = block(number, ids, lengths, terms, rows, tfs)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], kind) for k, kind in enumerate(KINDS)], NAMES)

    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True):
            found = terms_of(raw)
            for term, tf in Counter(found).items():
                h = term_hash(term) if wanted is None else wanted.get(term)
                if h is not None:
                    terms.append(h)
                    rows.append(len(ids))
                    tfs.append(tf)
            ids.append(i)
            lengths.append(len(found))
            size += len(raw or b"") + 256
            if size >= SEGMENT_BYTES:
                yield segment()
                number, ids, lengths, terms, rows, tfs, size = number + 1, [], [], [], [], [], 0
    if ids:
        yield segment()
    give_back()


def write_index(docs: DataFrame, path: str, wanted: dict[bytes, int] | None = None) -> None:
    """Index all rows of `docs` (doc_id, text), whole, under `path`.

    wanted: terms with their numbers, if only these will ever be asked; lengths count all terms either way.  Rows
    without text have no terms; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = None if wanted is None else spark.sparkContext.broadcast(wanted)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    rows.mapInArrow(functools.partial(_index, sent), INDEX).write.partitionBy("part").parquet(path)


@dataclass
class Query:
    """A block of items: sorted term numbers, and for each (item, term) its place among them; the corpus's figures."""

    items: list
    vocabulary: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weights: np.ndarray | None = None
    documents: int = 0
    words: int = 0
    least: np.ndarray | None = None

    @classmethod
    def of(cls, pairs: list[tuple[int, int]]) -> Query:
        """From (item_id, term number)."""
        items = sorted({i for i, _ in pairs})
        number = {i: k for k, i in enumerate(items)}
        vocabulary = np.array(sorted({t for _, t in pairs}), np.int64)
        pairs = sorted((number[i], t) for i, t in pairs)
        item = np.array([i for i, _ in pairs], np.int64)
        return cls(items, vocabulary, item, np.searchsorted(vocabulary, np.array([t for _, t in pairs], np.int64)))

    def lists(self) -> np.ndarray:
        """How many lists each item has: partitions with a term of weight that some document holds."""
        real = self.weights[self.term] > 0
        both = np.unique(self.item[real] * PARTS + part_of(self.vocabulary[self.term[real]]))
        return np.bincount(both // PARTS, minlength=len(self.items))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _blocks(batches):
    """(part, segment, ids, lengths, terms, starts, rows, tfs, further columns) of each row of the index."""
    for batch in batches:
        for r in range(batch.num_rows):
            cells = [batch.column(n)[r] for n in NAMES]
            arrays = [np.asarray(c.values.to_numpy(zero_copy_only=False)) for c in cells[3:]]
            yield cells[0].as_py(), cells[1].as_py(), cells[2].values, *(a.astype(np.int64) for a in arrays), [c[r] for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in NAMES]


def sums(query: Query, lengths, terms, starts, rows, tfs):
    """(items, scores by item and document of the block) for some of the items at a time that the block has anything of."""
    at = np.searchsorted(terms, query.vocabulary)
    at[at == len(terms)] = 0
    held = (terms[at] == query.vocabulary) & (query.weights > 0) if len(terms) else np.zeros(len(query.vocabulary), bool)
    keep = held[query.term]
    item, term = query.item[keep], query.term[keep]
    if not len(item):
        return
    m = 50 + (50 * lengths * query.documents) // query.words
    score = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[rows])
    here, item = np.unique(item, return_inverse=True)
    first, size, w = starts[at[term]], starts[at[term] + 1] - starts[at[term]], query.weights[term]
    step = max(1, CELLS // len(lengths))
    for low in range(0, len(here), step):
        own = slice(*np.searchsorted(item, [low, low + step]))
        which = np.repeat(np.arange(own.start, own.stop), size[own])
        place = np.arange(len(which)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + first[which]
        out = np.zeros((min(step, len(here) - low), len(lengths)), np.int64)
        np.add.at(out.ravel(), (item[which] - low) * len(lengths) + rows[place], w[which] * score[place])
        yield here[low : low + step], out


def _places(item, part, segment, k, ids, value) -> pa.RecordBatch:
    n = len(item)
    columns = [pa.array(item, pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, segment), pa.int64()), pa.array(k, pa.int32()), ids.take(pa.array(k, pa.int64())), pa.array(value, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, PLACE)


def _figures(sent, batches):
    """(term's place, documents that hold it) of a task; -1: documents with terms, -2: all terms."""
    vocabulary = sent.value.vocabulary
    df, documents, words = np.zeros(len(vocabulary), np.int64), 0, 0
    for part, _, _, lengths, terms, starts, *_ in _blocks(batches):
        at = np.searchsorted(terms, vocabulary)
        at[at == len(terms)] = 0
        if len(terms):
            held = terms[at] == vocabulary
            df[held] += (starts[at + 1] - starts[at])[held]
        if part == 0:
            documents, words = documents + int((lengths > 0).sum()), words + int(lengths.sum())
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2]), pa.int64()), pa.array(np.append(df[term], [documents, words]), pa.int64())], ["term", "n"])


def _heads(sent, k, batches):
    """The k highest entries of each list among a task's blocks."""
    query, best = sent.value, {}
    for part, segment, ids, *arrays, _ in _blocks(batches):
        for items, scores in sums(query, *arrays):
            top = np.argpartition(-scores, k, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
            values = np.take_along_axis(scores, top, 1)
            for i, t, v in zip(items.tolist(), top, values, strict=True):
                least = best[part, i][-1][0] if len(best.get((part, i), ())) == k else 0
                new = [(int(a), segment, int(b), ids[int(b)].as_py()) for a, b in zip(v, t, strict=True) if a > least]
                if new:
                    best[part, i] = sorted(best.get((part, i), []) + new, key=lambda e: (-e[0], e[1:3]))[:k]
    rows = [(i, part, e[1], e[2], e[3], e[0]) for (part, i), entries in best.items() for e in entries]
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], PLACE)


def _sent(sent, batches):
    """All entries from each item's threshold on."""
    query = sent.value
    for part, segment, ids, *arrays, _ in _blocks(batches):
        for items, scores in sums(query, *arrays):
            at, k = np.nonzero(scores >= query.least[items][:, None])
            if len(at):
                yield _places(items[at], part, segment, k, ids, scores[at, k])


def _looked_up(sent, asked, batches):
    """What a block's list has for the (item, k) pairs asked for, where the partition isn't among those that sent it."""
    query = sent.value
    for part, segment, ids, *arrays, more in _blocks(batches):
        if asked is None:
            pairs = more[0].values
            item, k, seen = (np.asarray(pairs.field(n)) for n in ("item", "k", "seen"))
        elif segment in asked.value:
            item, k, seen = asked.value[segment]
        else:
            continue
        open_ = (seen >> part) & 1 == 0
        item, k = item[open_], k[open_]
        order = np.argsort(item, kind="stable")
        item, k = item[order], k[order]
        if not len(item):
            continue
        for items, scores in sums(query, *arrays):
            low, high = np.searchsorted(item, [items[0], items[-1] + 1])
            at = np.minimum(np.searchsorted(items, item[low:high]), len(items) - 1)
            value = np.where(items[at] == item[low:high], scores[at, k[low:high]], 0)
            some = np.flatnonzero(value)
            if len(some):
                yield _places(item[low:high][some], part, segment, k[low:high][some], ids, value[some])


def lookup(index: DataFrame, sent, wanted: DataFrame) -> DataFrame:
    """Entries of `wanted` (item, segment, k, seen) in the lists that aren't in the bits of `seen`."""
    wanted = cut(wanted.select("item", "segment", "k", "seen"))
    if wanted.count() <= LOOKUPS:
        asked: dict[int, list] = {}
        for r in wanted.collect():  # of checked size
            asked.setdefault(r["segment"], []).append((r["item"], r["k"], r["seen"]))
        table = index.sparkSession.sparkContext.broadcast({s: tuple(np.array(rows, np.int64).T) for s, rows in asked.items()})
        return index.mapInArrow(functools.partial(_looked_up, sent, table), PLACES)
    pairs = wanted.groupBy("segment").agg(F.collect_list(F.struct("item", "k", "seen")).alias("asked"))  # an item and a document of a segment each
    return index.join(pairs, "segment").select(*NAMES, "asked").mapInArrow(functools.partial(_looked_up, sent, None), PLACES)


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k first places (place) of each item."""
    order = Window.partitionBy("item").orderBy(F.desc("value"), F.asc_nulls_last("doc_id"), "segment", "k")
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _answer(index: DataFrame, query: Query, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""
    spark = index.sparkSession
    send = spark.sparkContext.broadcast
    found = dict(index.mapInArrow(functools.partial(_figures, send(query)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row a term of the block
    query.documents, query.words = found.pop(-1, 0), found.pop(-2, 0)
    query.weights = np.array([weight(query.documents, found[t]) if t in found else 0 for t in range(len(query.vocabulary))], np.int64)
    # 1: heads, and the exact scores of what they name
    sent = send(query)
    heads = index.mapInArrow(functools.partial(_heads, sent, k), PLACES)
    order = Window.partitionBy("item", "part").orderBy(F.desc("value"), "segment", "k")
    heads = cut(heads.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place"))
    key = ["item", "segment", "k"]
    seen = F.bit_or(F.lit(1).cast("bigint") * F.pow(F.lit(2), F.col("part")).cast("bigint")).alias("seen")
    met = heads.groupBy(*key).agg(seen)
    exact = heads.unionAll(lookup(index, sent, met)).groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.sum("value").alias("value"))
    bound = {r["item"]: r["value"] for r in _best(exact, k).filter(F.col("place") == k).select("item", "value").collect()}  # a row an item
    # 2: every list sends what may add up to that
    lists = query.lists()
    query.least = np.array([max(1, -(-bound.get(i, 0) // max(1, int(lists[i])))) for i in range(len(query.items))], np.int64)
    sent = send(query)
    entries = index.mapInArrow(functools.partial(_sent, sent), PLACES)
    partial = cut(entries.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.sum("value").alias("value"), seen))
    # 3: the rest of their scores
    rest = lookup(index, sent, partial).select(*key, "doc_id", "value")
    scores = partial.select(*key, "doc_id", "value").unionAll(rest).groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.sum("value").alias("value"))
    ids = F.array(*(F.lit(i).cast("bigint") for i in query.items)) if len(query.items) <= 1000 else None
    best = _best(scores, k)
    if ids is not None:
        item_id = F.get(ids, F.col("item"))
    else:
        names = spark.createDataFrame(list(enumerate(query.items)), "item int, item_id bigint")
        best, item_id = best.join(names, "item"), F.col("item_id")
    return cut(best.select(item_id.alias("item_id"), F.col("place").cast("int").alias("rank"), "doc_id", F.col("value").alias("score")))


def _item_terms(batches):
    for batch in batches:
        rows = [(i, t, term_hash(t)) for i, raw in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True) for t in set(terms_of(raw))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item_id", "word", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, word, term) of items (item_id, text); rows of one id together, rows without one left out."""
    rows = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].alias("text")).filter("item_id is not null")
    return rows.mapInArrow(_item_terms, "item_id bigint, word binary, term bigint").distinct()


def search(spark: SparkSession, path: str, items: DataFrame, *, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of a written index for each item, see rank()."""
    bounded_batches(spark)
    return _search(spark, path, cut(item_terms(items)), k)


def _search(spark: SparkSession, path: str, asked: DataFrame, k: int) -> DataFrame:
    index = spark.read.schema(INDEX).parquet(path)
    size = asked.agg(F.count("*").alias("pairs"), F.count_distinct("item_id").alias("items")).first()
    rounds = max(-(-size["pairs"] // ITEM_PAIRS), -(-size["items"] // ITEMS))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for r in range(rounds):
        pairs = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).select("item_id", "term").collect()  # about ITEM_PAIRS
        if pairs:
            out = out.unionAll(_answer(index, Query.of([tuple(p) for p in pairs]), k))
    return out


def rank(docs: DataFrame, items: DataFrame, *, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of highest score above 0, over all rows of `docs`.

    Rows without text have no terms and are never found; very long texts count whole; a row that is repeated is ranked each
    time; equal scores come by ascending doc_id, rows without a doc_id last, and rows that share one in any order.
    Items of one item_id are taken together, items without one or without terms have no rows; a term counts once an item.
    Empty tables give no rows; other columns, whatever their names, are not read.  Terms are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = cut(item_terms(items))
    words = asked.select("word", "term").distinct()
    # the index of one search needs no other terms, as long as those are few enough to be sent
    wanted = dict(map(tuple, words.collect())) if asked.count() <= ITEM_PAIRS else None
    path = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    write_index(docs, path, None if wanted is None else {bytes(w): t for w, t in wanted.items()})
    out = _search(spark, path, asked, k)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def oracle_sql(k: int = K) -> str:
    """rank() of `documents` for `benchmark` as DuckDB SQL."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""with d as (select row_number() over () as r, doc_id, {terms} as t from documents),
figures as (select count(*) as docs, sum(len(t)) as words from d where len(t) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) u group by all),
df as (select term, count(*) as df from tf group by term),
q as (select distinct item_id, unnest({terms}) as term from benchmark where item_id is not null),
w as (select item_id, term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from q join df using (term), figures),
s as (select item_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + cast((50 * len(t) * docs) // words as bigint))))) as bigint) as score
 from w join tf using (term) join d using (r), figures group by item_id, r),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last, r) as rank from s join d using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {k}"""
