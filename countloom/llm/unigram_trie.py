"""Token counts under a unigram model, over one trie of distinct pre-tokens.

A pre-token (a word with the mark for the blank before it) is cut into vocabulary pieces so that the sum of
their log-probabilities is greatest.  The forward score of a prefix depends on the prefix alone, so at
a trie node it is computed once for all words below; a terminal keeps how many pieces the best
cut has.  The vocabulary is a file's; the pieces' probabilities come from the corpus: the distinct words of all
documents, with their counts, are cut once with Zipf shares (the piece of rank r has 1 / (r + 1)), and the shares of
the pieces that this gives, with the Zipf shares as a prior, are the model.  Characters outside the vocabulary count
one piece a UTF-8 byte, at a score below that of every piece.
"""

from __future__ import annotations

import functools
import gc
import math
import uuid
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, give_back, utf8_list
from countloom.llm.endings import Endings, depth_first

MARK = "▁"
#: Words kept per worker; beyond it the cache starts anew (a matter of speed only).
CACHE_WORDS = 400_000
#: Text of one trie, and words of one where distinct words are counted.
BLOCK_BYTES, TRIE_WORDS = 4_000_000, 200_000
#: Pieces that the prior is worth, for each piece of the vocabulary.
PRIOR = 1.0


class Unigram:
    """`scores`: log-probability of each piece.  Of equal sums the cut with fewer pieces holds."""

    def __init__(self, scores: dict[str, float], byte_score: float | None = None):
        self.pieces = list(scores)
        self.byte_score = byte_score if byte_score is not None else min(scores.values(), default=0.0) - 1.0
        numbers = {p: k for k, p in enumerate(scores)}
        #: Of a state: width, score and number of the pieces that end there.
        self.endings = Endings(scores, lambda ends: [(len(e), scores[e], numbers[e]) for e in ends if e in scores])
        #: Of a word: the number of its pieces, and (where they were asked for) which, -1 for bytes.
        self.counts: dict[str, int] = {}
        self.cuts: dict[str, bytes] = {}

    def learn(self, words: set[str], cuts: bool = False) -> None:
        """Depth first over the trie of new words; time and room are in proportion to the letters."""
        endings, byte_score = self.endings, self.byte_score
        where, best, count, back = [endings.root], [0.0], [0], [(0, -1)]
        for word, shared in depth_first(MARK + w for w in words):
            del where[shared + 1 :], best[shared + 1 :], count[shared + 1 :], back[shared + 1 :]
            state, n = where[shared], shared
            for c in word[shared:]:
                width = len(c.encode())
                top, pieces, how = best[n] + width * byte_score, count[n] + width, (1, -1)
                n += 1
                state = state.moves.get(c) or endings.after(state, c)
                for w, s, number in state.ends:
                    total = best[n - w] + s
                    if total > top or total == top and count[n - w] < pieces - 1:
                        top, pieces, how = total, count[n - w] + 1, (w, number)
                where.append(state)
                best.append(top)
                count.append(pieces)
                back.append(how)
            self.counts[word[1:]] = count[n]
            if cuts:
                own = []
                while n:
                    w, number = back[n]
                    own.append(number)
                    n -= w
                self.cuts[word[1:]] = array("i", own).tobytes()

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, pieces) of each text; words stand between white space."""
        lists = [t.split() for t in texts]
        new: set[str] = set()
        for words in lists:
            new.update(words)
        if len(self.counts) > CACHE_WORDS:
            self.counts.clear()
        gc.disable()  # many objects and no cycles
        try:
            self.learn(new.difference(self.counts))
        finally:
            gc.enable()
        get = self.counts.__getitem__
        return [(len(words), sum(map(get, words))) for words in lists]

    def pieces_of(self, often: dict[str, int]) -> np.ndarray:
        """How often the best cuts of counted words have each piece."""
        gc.disable()
        try:
            self.learn(set(often), True)
        finally:
            gc.enable()
        total = np.zeros(len(self.pieces) + 1, np.int64)
        cuts = [np.frombuffer(self.cuts[w], np.int32) for w in often]
        if cuts:
            times = np.repeat(np.fromiter(often.values(), np.int64, len(cuts)), [len(c) for c in cuts])
            np.add.at(total, np.concatenate(cuts) + 1, times)
        self.counts.clear()
        self.cuts.clear()
        return total[1:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece file, by rank; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def scores_of(pieces: list[str], counts: dict[int, int]) -> dict[str, float]:
    """Log-probabilities from counts by rank, with the Zipf shares as prior."""
    zipf = sum(1 / (r + 1) for r in range(len(pieces)))
    whole = sum(counts.values()) + PRIOR * len(pieces)
    return {p: math.log((counts.get(r, 0) + PRIOR * len(pieces) / (r + 1) / zipf) / whole) for r, p in enumerate(pieces)}


@functools.lru_cache(maxsize=1)
def prior_model(path: str) -> Unigram:
    return Unigram(scores_of(vocabulary(path), {}))


#: The model of the pass at hand, kept from task to task of a worker.
_now: dict[str, Unigram] = {}


def forget() -> None:
    """Drop the models of passes before this one; their states name each other, so they wait for a collection."""
    _now.clear()
    prior_model.cache_clear()
    gc.collect()


def model_of(path: str, name: str, counts) -> Unigram:
    """The model of broadcast counts, made once a worker; one of another name, and the prior's, are forgotten."""
    if name not in _now:
        forget()
        _now[name] = Unigram(scores_of(vocabulary(path), counts.value))
    return _now[name]


def _blocks(raw: list[bytes | None]):
    """Slices of about BLOCK_BYTES, and their texts."""
    start = size = 0
    for i, t in enumerate(raw):
        size += len(t or b"")
        if size >= BLOCK_BYTES or i + 1 == len(raw):
            yield start, i + 1, [(t or b"").decode("utf-8", "replace") for t in raw[start : i + 1]]
            start, size = i + 1, 0


def _words(batches):
    """Words of a task with their counts, given out whenever there are many."""
    often: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(often.keys(), pa.string()), pa.array(often.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in utf8_list(batch.column(0)):
            if t:
                often.update(t.decode("utf-8", "replace").split())
            if len(often) > TRIE_WORDS:
                yield rows()
                often.clear()
    yield rows()
    give_back()


def _pieces(path, batches):
    """Pieces in the best cuts of counted distinct words."""
    if _now:
        forget()
    model = prior_model(path)
    total = np.zeros(len(model.pieces), np.int64)
    often: dict[str, int] = {}
    for batch in batches:
        often.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(often) > TRIE_WORDS:
            total += model.pieces_of(often)
            often = {}
    total += model.pieces_of(often)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["rank", "n"])
    give_back()


def _run(path, name, counts, batches):
    for batch in batches:
        model = model_of(path, name, counts)
        for start, stop, texts in _blocks(utf8_list(batch.column(1))):
            found = model.count(texts)
            columns = [batch.column(0).slice(start, stop - start), *(pa.array([c[k] for c in found], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_tokens"])
    give_back()


def piece_counts(docs: DataFrame, path: str) -> dict[int, int]:
    """How often all documents have each piece, by rank: one row a piece of the vocabulary at most."""
    bounded_batches(docs.sparkSession)
    words = docs.select(docs["text"].alias("text")).mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    parts = words.mapInArrow(functools.partial(_pieces, path), "rank int, n bigint")
    return {r["rank"]: r["n"] for r in parts.groupBy("rank").agg(F.sum("n").alias("n")).collect()}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row; `path` is the vocabulary file on every worker.

    Null, empty and blank texts have none; very long texts and words take time in proportion to their length;
    repeated rows count alike, each time, in the estimate too; other columns, whatever their names, are not read; an
    empty table has no rows, and nothing to estimate from.
    """
    counts = docs.sparkSession.sparkContext.broadcast(piece_counts(docs, path))  # as many numbers as pieces
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(functools.partial(_run, path, uuid.uuid4().hex, counts), "doc_id bigint, n_pretokens bigint, n_tokens bigint")
