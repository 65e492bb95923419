"""Byte-level byte-pair encoding of a whole corpus by replaying the merges over all distinct words at once.

The distinct words of a block of documents stand one after the other as one chain of tokens.  An inverted index
tells for every merge at which positions the pair of tokens stands that it joins; merges are applied in rank order, each at
all its positions, and only the pairs with the two neighbours of a merged token are looked up and indexed
anew.  Words met before keep their encodings, in a cache of bounded size, so hot words, long texts and lost
executors need no care: a document is encoded and decoded where it is read.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import itertools
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from countloom.llm.common import bounded_batches, give_back, utf8_list
from countloom.llm.trie_bpe import NEWER, UNLETTERED

#: Words kept per worker, of those the ones met first when there are more; text of one block: a matter of speed and memory only.
CACHE_WORDS, CACHE_KEPT, BLOCK_BYTES = 800_000, 300_000, 4 << 20
#: Pairs of tokens remembered per worker.
MOST_PAIRS = 2_000_000
NONE, SIDE = 1 << 62, 1 << 31

#: The pattern over ASCII and letters of the Latin blocks, spelled out: the same pieces, found faster.
LATIN = "\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{LATIN}]+| ?[0-9]+| ?[^A-Za-z{LATIN}0-9\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


class Merges:
    """A rank file: tokens by rank, and what two of them join to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.load({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})

    def load(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        joined = [[self.ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)]
        self.doubles = np.array(joined, np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        # every way to cut a token into two others, sorted
        cut = [(self.ranks[t[:k]] * SIDE + self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.cuts, self.cut_ranks = np.array(sorted(cut), np.int64).reshape(-1, 2).T.copy()

    def join_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """join() of arrays."""
        if not len(self.cuts):
            return np.full(len(left), NONE)
        key = left * SIDE + right
        at = np.minimum(np.searchsorted(self.cuts, key), len(self.cuts) - 1)
        return np.where(self.cuts[at] == key, self.cut_ranks[at], NONE)

    def join(self, left: int, right: int) -> int:
        """The rank of the merge of two tokens, NONE if there is none."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = self.ranks.get(self.tokens[left] + self.tokens[right], NONE)
        return found

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; words aren't empty."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        whole = [self.ranks.get(w) for w in words]
        open_ = [w for w, r in zip(words, whole, strict=True) if r is None]
        replayed = iter(self.replay(open_))
        return [next(replayed) if r is None else array("I", [r]).tobytes() for r in whole]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """All merges in rank order over the chain of all words."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1] = -1
        before[np.append(0, ends[:-1])] = -1
        merge = np.full(len(data), NONE, np.int64)
        merge[:-1] = self.doubles[data[:-1], data[1:]]
        merge[ends - 1] = NONE
        token = self.single[data]
        late = self._frequent(token, after, before, merge)
        token, after, before = token.tolist(), after.tolist(), before.tolist()
        self._rare(token, after, before, merge.tolist(), {r: own.tolist() for r, own in indexed(merge)})
        out = []
        for start in [0, *ends[:-1].tolist()]:
            ids = array("I")
            while start >= 0:
                ids.append(token[start])
                start = after[start]
            out.append(ids.tobytes())
        for k in np.unique(np.searchsorted(ends, late, side="right")).tolist():
            out[k] = self._alone(words[k])
        return out

    def _frequent(self, token: np.ndarray, after: np.ndarray, before: np.ndarray, merge: np.ndarray) -> np.ndarray:
        """The first merges, each at all its positions in one step, until they get rare; changes the arrays.

        Returns positions of words in which a merge made a pair of smaller rank: there the order of one step may matter.
        """
        index = {r: [own] for r, own in indexed(merge)}
        queue, rare, late = list(index), 0, [np.zeros(0, np.int64)]
        heapify(queue)
        while queue and rare < 64:
            rank = heappop(queue)
            at = np.sort(np.concatenate(index.pop(rank)))
            rare += len(at) < 16
            at = at[merge[at] == rank]
            at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
            # in a run of overlapping pairs every second one, from the left
            overlap = np.append(False, after[at[:-1]] == at[1:])[: len(at)]
            if overlap.any():
                n = np.arange(len(at))
                at = at[(n - np.maximum.accumulate(np.where(overlap, 0, n))) % 2 == 0]
            right, old = after[at], token[at]
            token[at], merge[right] = rank, NONE
            right = after[at] = after[right]
            near = np.flatnonzero(right[:-1] == at[1:])  # the next merge is right beside: between the two another pair stood there
            if len(near):
                late.append(at[near[self.join_all(np.full(len(near), rank), old[near + 1]) < rank]])
            before[right[right >= 0]] = at[right >= 0]
            left = before[at]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            right = after[touched]
            new = merge[touched] = np.where(right < 0, NONE, self.join_all(token[touched], token[right]))
            late.append(touched[new < rank])
            some = new != NONE
            touched, new = touched[some], new[some]
            order = np.argsort(new, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(new[order])) + 1) if len(order) else ():
                r = int(new[own[0]])
                if r not in index:
                    index[r] = []
                    heappush(queue, r)
                index[r].append(touched[own])
        return np.concatenate(late)

    def _rare(self, token: list[int], after: list[int], before: list[int], merge: list[int], index: dict[int, list[int]]) -> None:
        """All merges that are left, position by position; changes the lists."""
        queue, join = list(index), self.join
        heapify(queue)
        while queue:
            rank = heappop(queue)
            places = index.pop(rank)
            places.sort()  # of one pair in a word the leftmost goes first
            for n, at in enumerate(places):
                if merge[at] != rank:
                    continue  # a neighbour was merged meanwhile
                right = after[at]
                token[at], merge[right] = rank, NONE
                right = after[at] = after[right]
                lower = False
                if right < 0:
                    merge[at] = NONE
                else:
                    before[right] = at
                    new = merge[at] = join(rank, token[right])
                    if new != NONE:
                        lower = new < rank
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(queue, new)
                left = before[at]
                if left >= 0:
                    new = merge[left] = join(token[left], rank)
                    if new != NONE:
                        lower = lower or new < rank
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heappush(queue, new)
                if lower:  # a merge of smaller rank has come up; the other places wait for it
                    if rank not in index:
                        index[rank] = []
                        heappush(queue, rank)
                    index[rank].extend(places[n + 1 :])
                    break

    def _alone(self, word: bytes) -> bytes:
        """One word by itself, position by position."""
        n = len(word)
        token = [int(self.single[b]) for b in word]
        after, merge = [*range(1, n), -1], [*(int(self.doubles[a, b]) for a, b in zip(word, word[1:], strict=False)), NONE]
        index: dict[int, list[int]] = {}
        for at, rank in enumerate(merge):
            if rank != NONE:
                index.setdefault(rank, []).append(at)
        self._rare(token, after, list(range(-1, n - 1)), merge, index)
        at, ids = 0, array("I")
        while at >= 0:
            ids.append(token[at])
            at = after[at]
        return ids.tobytes()


def indexed(merge: np.ndarray):
    """The inverted index: (rank of a merge, the positions of its pair in order)."""
    order = np.argsort(merge, kind="stable")[: int((merge != NONE).sum())]
    for own in np.split(order, np.flatnonzero(np.diff(merge[order])) + 1) if len(order) else ():
        yield int(merge[own[0]]), own


class ByteEncoder:
    """Whole texts: cut by the pattern, each piece encoded by itself."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.plain, self.beyond = re.compile(PLAIN), re.compile(f"[^\x00-\x7f{LATIN}]")
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern; letters and digits that its library doesn't know yet are neither."""
        if text.isascii() or not self.beyond.search(text):
            return self.plain.findall(text)
        if NEWER.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(UNLETTERED))]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the decoded bytes, of each text."""
        lists = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = dict(itertools.islice(self.cache.items(), CACHE_KEPT))
        gc.disable()  # many small objects and no cycles
        try:
            new = list(set(itertools.chain.from_iterable(lists)).difference(self.cache))
            self.cache.update(zip(new, self.merges.encode_all([p.encode() for p in new]), strict=True))
        finally:
            gc.enable()
        out, get = [], self.cache.__getitem__
        for own in lists:
            ids = b"".join(map(get, own))
            out.append((ids, self.decode(ids)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes, one after the other."""
        return b"".join(map(self.merges.tokens.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder per worker process and file."""
    return ByteEncoder(path)


def _slices(texts: list[bytes | None]):
    """Ranges of texts of about BLOCK_BYTES together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BLOCK_BYTES or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def _run(path: str, with_ids: bool, batches):
    encoder = byte_encoder(path)
    for batch in batches:
        raw = utf8_list(batch.column(1))
        for start, stop in _slices(raw):
            done = encoder.encode_batch([(t or b"").decode("utf-8", "replace") for t in raw[start:stop]])
            columns = [
                batch.column(0).slice(start, stop - start),
                pa.array([len(i) // 4 for i, _ in done], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in done], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for _, d in done], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([memoryview(i).cast("I").tolist() for i, _ in done], pa.list_(pa.int32())), pa.array([d for _, d in done], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
    give_back()


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; with_ids adds the ids and the decoded bytes themselves.

    ``path`` is the rank file on every worker.  A null or empty text has no tokens and decodes to nothing; very long texts
    and words take time nearly in proportion to their length; repeated rows give repeated results, and a row without an id has
    one too; within a word the leftmost of equal pairs is merged first; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(functools.partial(_run, path, with_ids), schema)
