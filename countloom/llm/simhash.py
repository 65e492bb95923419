"""SimHash near-duplicates: fingerprints, exact links within a Hamming radius, components.

Two fingerprints at most two bits apart agree on at least two of four 16-bit blocks.  So all fingerprints are sorted
into six tables, one for every two blocks: there those two come first, and the order is that of the Gray code, so that
near ones, and all that agree on both blocks, stand together.  The tables are cut into ranges between such
groups; over each range a hierarchical index (``gray_index``) factors shared bits into upper nodes and joins the range
with itself, leaving out whole groups as soon as their factored bits differ too much.  A range yields
at most one edge a member, never all pairs.  Groups of more than BLOCK members (families of near copies)
are sorted again, into tables that put two of four bytes of their other 32 bits next, after which at most
65,536 different fingerprints can form a group, whatever the input.  Equal fingerprints
are one node from the start, so exact copies cost nothing.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, cut, give_back, unused, utf8_list
from countloom.llm.components import components
from countloom.llm.gray_index import linked

#: Members above which a group is sorted again.
BLOCK = 4_096
#: Fingerprints of one index, but for the group that completes it.
RANGE = 8_192
LIMIT = 2


def fingerprint(raw: bytes, width: int = 3) -> int:
    """SimHash of a UTF-8 text over word shingles; 0 without words."""
    words = raw.lower().split()  # bytes: A-Z only, and breaks at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        words = np.array([fingerprint(t or b"") for t in utf8_list(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.view(np.int64))], ["doc_id", "fp"])
    give_back()


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer; 0 for null texts."""
    bounded_batches(docs.sparkSession)
    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _part(word: Column, at: int, bits: int) -> Column:
    """Bits of a word, from the `at`-th on, as the lowest."""
    return F.shiftrightunsigned(word, at).bitwiseAND((1 << bits) - 1)


def _two_first(word: Column, top: int, bits: int) -> list[Column]:
    """Of a word's four parts of `bits` bits below its `top` highest ones: for every two of them the word with those two next."""
    high = F.lit(0).cast("bigint") if not top else F.shiftleft(F.shiftrightunsigned(word, 64 - top), 64 - top)
    out = []
    for pair in itertools.combinations(range(4), 2):
        order = [*pair, *(k for k in range(4) if k not in pair)]
        parts = [F.shiftleft(_part(word, 64 - top - bits * (k + 1), bits), 64 - top - bits * (n + 1)) for n, k in enumerate(order)]
        out.append(functools.reduce(Column.bitwiseOR, parts, high))
    return out


def gray_rank(word: Column) -> Column:
    """Position of a 64-bit word in the reflected Gray sequence; the upper half counts as negative."""
    for shift in (1, 2, 4, 8, 16, 32):
        word = word.bitwiseXOR(F.shiftrightunsigned(word, shift))
    return word


def _edges(limit, batches):
    """Edges within ranges of each table; rows come by table and rank, and groups of equal prefix stay whole."""
    names = ("table", "prefix", "rank", "node")
    rest = None

    def close(rows):
        table, _, rank, node = rows
        a, b = [], []
        for start, stop in itertools.pairwise([0, *(np.flatnonzero(table[1:] != table[:-1]) + 1).tolist(), len(table)]):
            words = rank[start:stop].view(np.uint64)
            root = linked(words ^ (words >> np.uint64(1)), limit)
            own, least = node[start:stop], node[start:stop].copy()
            np.minimum.at(least, root, own)
            least = least[root]
            far = least != own
            a.append(least[far])
            b.append(own[far])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        rest = rows
        if len(rows[0]) >= RANGE:
            changes = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            if len(changes):
                last = int(changes[-1]) + 1
                rest = [x[last:] for x in rows]
                yield close([x[:last] for x in rows])
    if rest is not None and len(rest[0]):
        yield close(rest)
    give_back()


def near_edges(nodes: DataFrame, *, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(a, b) edges that join all of (node, fp) within `limit` (0 to 2) bits; `fp` must be distinct."""
    if not 0 <= limit <= 2:
        raise ValueError("four blocks find at most two differing bits")

    def sorted_in(rows: DataFrame, first: int, words: list[Column], prefix: int) -> DataFrame:
        tables = F.explode(F.array(*(F.struct(F.lit(first + k).alias("table"), w.alias("word")) for k, w in enumerate(words))))
        rows = rows.select("node", *(c for c in ("part",) if c in rows.columns), tables.alias("t")).select("node", *(c for c in ("part",) if c in rows.columns), "t.*")
        return rows.withColumn("prefix", F.shiftright(gray_rank(F.col("word")), 64 - prefix))

    once = sorted_in(nodes, 0, _two_first(F.col("fp"), 0, 16), 32)
    large = once.groupBy("table", "prefix").agg(F.count("*").alias("n")).filter(F.col("n") > block).drop("n")
    small = once.join(large, ["table", "prefix"], "left_anti")
    again = once.join(large, ["table", "prefix"]).select("node", F.col("table").alias("part"), "word")
    again = sorted_in(again, 0, _two_first(F.col("word"), 32, 8), 48).withColumn("table", 6 + 6 * F.col("part") + F.col("table"))
    every = small.select("table", "prefix", "word", "node").unionAll(again.select("table", "prefix", "word", "node")).withColumn("rank", gray_rank(F.col("word"))).drop("word")
    ordered = every.repartitionByRange("table", "prefix").sortWithinPartitions("table", "rank")
    return ordered.select("table", "prefix", "rank", "node").mapInArrow(functools.partial(_edges, limit), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, limit: int = LIMIT, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that a chain of links reaches.  Null, empty and
    blank texts have fingerprint zero and link like any other; very long texts count whole.  A repeated doc_id gives
    repeated rows; other columns, whatever their names, are not read.  Rows whose doc_id is null keep their
    fingerprint and get a null component unless others share it.  An empty table has no rows.
    """
    marked = cut(fingerprints(docs, key=key, text=text))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    joined = components(near_edges(nodes.filter("node is not null"), limit=limit, block=block))
    classes = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, *, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, all columns, without those whose component has a smaller doc_id.

    Rows without an id stay.  Of rows with one doc_id all or none stay.  All texts without a word share fingerprint
    zero, so one of them stays, with whatever else is near zero.
    """
    marked = near_duplicates(docs, limit=limit, block=block)
    name = unused(docs, "copy")
    copies = marked.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(copies, docs["doc_id"].cast("bigint") == F.col(name), "left_anti")
