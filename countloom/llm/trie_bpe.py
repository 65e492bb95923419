"""Byte-pair encoding of a whole corpus over one trie of distinct words.

The last token of a word's encoding, together with the encoding of what stands
before that token, is the encoding: every prefix of a BPE encoding is itself the
encoding of the text it spells.  A trie node (a prefix of some word) therefore
needs only its *last token*; it is found from the states of nodes further up, and
is computed once however many words share the prefix.  Which tokens can end at a node
follows from the longest end of the prefix that begins a token, itself passed down the trie.

``encode(docs, path)`` works document by document and holds only a bounded cache
of finished words, so hot words, long texts and lost executors need no care.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
import re
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from countloom.llm.common import bounded_batches, give_back, utf8_list
from countloom.llm.endings import Endings, depth_first

#: Words kept per worker, of those the ones met first (the frequent ones) when there are more, and text of one trie: a matter
#: of speed and memory only.  The lean ones are for workers that serve other stages as well.
CACHE_WORDS, CACHE_KEPT, BLOCK_BYTES = 600_000, 240_000, 4_000_000
LEAN_WORDS, LEAN_KEPT, LEAN_BYTES = 250_000, 100_000, 1_500_000
#: Neighbour pairs of tokens remembered per worker; beyond it they are found anew (a matter of speed only).
MOST_PAIRS = 2_000_000


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if visible Latin-1, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Token:
    """A vocabulary entry that BPE spells as itself; `width`: its characters without the end mark."""

    __slots__ = ("id", "text", "width", "letters", "lefts")

    def __init__(self, number: int, text: str, letters: list[str]):
        self.id, self.text, self.width, self.letters = number, text, len(letters), letters
        #: For left neighbours met before: whether BPE leaves the boundary standing.
        self.lefts: dict[Token, bool] = {}


class WordEncoder:
    """BPE of single words (strings of the byte alphabet) by last-token states."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(pair): k for k, pair in enumerate(merges)}
        self.tokens: dict[str, Token | None] = {}
        self.pairs = 0
        #: Of a state: the tokens that may end there before further letters, and those with the end mark.
        self.endings = Endings((t.removesuffix(suffix) for t in vocab), self.ending)

    def merge(self, symbols: list[str]) -> list[str]:
        """The defining procedure, used on token pairs only."""
        symbols, rank, none = list(symbols), self.rank.get, 1 << 60
        while len(symbols) > 1:
            ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def token(self, text: str) -> Token | None:
        """The token of that spelling, if BPE ever makes it; the last letter carries the end mark if it does."""
        if text not in self.tokens:
            found, number = None, self.vocab.get(text)
            if number is not None:
                body = text.removesuffix(self.suffix) or text
                letters = [*body[:-1], body[-1] + text[len(body) :]]
                if self.merge(letters) == [text]:
                    found = Token(number, text, letters)
            self.tokens[text] = found
        return self.tokens[text]

    def ending(self, ends: list[str]) -> tuple[list[Token], list[Token]]:
        return tuple([t for e in ends if (t := self.token(e + mark)) is not None] for mark in ("", self.suffix))

    def fits(self, left: Token, token: Token) -> bool:
        """Whether BPE leaves the boundary between the two standing."""
        if self.pairs >= MOST_PAIRS:
            for known in self.tokens.values():
                if known is not None:
                    known.lefts.clear()
            self.pairs = 0
        self.pairs += 1
        found = token.lefts[left] = self.merge(left.letters + token.letters) == [left.text, token.text]
        return found

    def last(self, candidates: list[Token], lasts: list[Token], n: int) -> Token:
        """The one candidate that ends the encoding of n letters; lasts[i] ends that of the first i."""
        for token in candidates:
            start = n - token.width
            if not start:
                return token
            left = lasts[start]
            fits = token.lefts.get(left)
            if fits or fits is None and self.fits(left, token):
                return token
        raise ValueError("no token ends the word")

    def encode_all(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words, depth first over their trie, as 32-bit integers.

        Time and room are in proportion to the letters.
        """
        found: dict[str, bytes] = {}
        where, lasts, last, endings = [self.endings.root], [None], self.last, self.endings
        for word, shared in depth_first(words):
            del where[shared + 1 :], lasts[shared + 1 :]
            state, n = where[shared], shared
            for c in word[shared:]:
                n += 1
                state = state.moves.get(c) or endings.after(state, c)
                where.append(state)
                lasts.append(last(state.ends[0], lasts, n))
            token = last(state.ends[1], lasts, n)
            ids, at = [token.id], n - token.width
            while at:
                token = lasts[at]
                ids.append(token.id)
                at -= token.width
            ids.reverse()
            found[word] = array("I", ids).tobytes()
        return found


# Fixed values, by the Unicode versions of the library, of Python's str methods and of the regex module: letters and
# numbers that are newer than the library's character classes, and capital letters newer than Python's, with their small ones.
NEWER_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NEWER_CAPITALS = """
1C89:1C8A A7CB:0264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB
"""


def code_points(ranges: str) -> list[int]:
    """All code points of `a-b` and `a` in hexadecimal digits, between blanks."""
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return [c for r in ends for c in range(r[0], r[-1] + 1)]


#: Stands for a newer letter while a text is cut: unassigned in every version, so neither letter nor number.
STAND_IN = "\u0378"
SMALL = {c: code_points(low)[0] + k for high, low in (pair.split(":") for pair in NEWER_CAPITALS.split()) for k, c in enumerate(code_points(high))}
UNLETTERED = dict.fromkeys(code_points(NEWER_LETTERS), STAND_IN)
NEWER = frozenset(map(chr, {*SMALL, *UNLETTERED}))


class TextEncoder:
    """Whole texts, as the file's normaliser, splitter, model and decoder treat them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("the file describes another kind of tokenizer")
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
        self.words = WordEncoder(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        #: Unlike White_Space, str.split() also breaks at these four.
        self.separators = re.compile("[\x1c-\x1f]")
        self.white = regex.compile(r"\s+")
        self.newest = min(NEWER)
        self.token = {i: t for t, i in self.words.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cache: dict[str, bytes] = {}

    def chunk_words(self, chunk: str) -> list[str]:
        """Words of a text without white space, in the byte alphabet."""
        if chunk.isascii() and chunk.isprintable():
            return self.pieces.findall(chunk.lower())
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if max(chunk, default="") >= self.newest and not NEWER.isdisjoint(chunk):
            chunk = chunk.translate(SMALL)
            found = [chunk[m.start() : m.end()] for m in self.pieces.finditer(chunk.translate(UNLETTERED))]
        else:
            found = self.pieces.findall(chunk)
        return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.alphabet) for w in found]

    def learn(self, chunks: set[str]) -> None:
        """Put the encodings of chunks into the cache."""
        parts = {chunk: self.chunk_words(chunk) for chunk in chunks}
        packed = self.words.encode_all({w for ws in parts.values() for w in ws})
        for chunk, ws in parts.items():
            self.cache[chunk] = b"".join([packed[w] for w in ws]) if len(ws) != 1 else packed[ws[0]]

    def chunks(self, text: str) -> list[str]:
        """Maximal pieces between white space; special tokens stand alone."""
        if "<|" in text and self.split_special.search(text):
            out, at = [], 0
            for m in self.split_special.finditer(text):
                out += self.plain(text[at : m.start()]) + [m[0]]
                at = m.end()
            return out + self.plain(text[at:])
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if self.separators.search(text):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def encode_batch(self, texts: list[str], lean: bool = False) -> list[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each text."""
        lists = [self.chunks(t) for t in texts]
        new: set[str] = set()
        for chunks in lists:
            new.update(chunks)
        if len(self.cache) > (LEAN_WORDS if lean else CACHE_WORDS):
            self.trim(lean)
        gc.disable()  # a trie is many objects and no cycles: collections would only walk it again and again
        try:
            self.learn(new.difference(self.cache, self.special))
        finally:
            gc.enable()
        for token, i in self.special.items():
            self.cache[token] = array("I", [i]).tobytes()
        out, get = [], self.cache.__getitem__
        for chunks in lists:
            ids = b"".join(map(get, chunks))
            out.append((ids, self.decode(ids)))
        return out

    def trim(self, lean: bool) -> None:
        """Forget all but the words met first."""
        self.cache = dict(itertools.islice(self.cache.items(), LEAN_KEPT if lean else CACHE_KEPT))

    def decode(self, ids: bytes) -> str:
        """The tokens by id, with spaces between (what a file without a decoder means)."""
        return " ".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker process and file."""
    return TextEncoder(path)


def _blocks(texts: list[bytes | None], most: int):
    """Slices of about `most` bytes, so that the word lists of a batch stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _run(path: str, with_ids: bool, lean: bool, batches):
    encoder = text_encoder(path)
    for batch in batches:
        rest = batch.drop_columns(["__text"])
        raw = utf8_list(batch.column("__text"))
        for start, stop in _blocks(raw, LEAN_BYTES if lean else BLOCK_BYTES):
            ids = encoder.encode_batch([(t or b"").decode("utf-8", "replace") for t in raw[start:stop]], lean)
            columns = [
                pa.array([len(i) // 4 for i, _ in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in ids], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in ids], pa.string()),
            ]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([memoryview(i).cast("I").tolist() for i, _ in ids], pa.list_(pa.int32())), pa.array([d for _, d in ids], pa.string())]
                names += ["ids", "decoded"]
            kept = rest.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *names])
    if lean:
        encoder.trim(lean)
    give_back()


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False, lean: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, SHA-256 of ids and of the decoded text.

    ``path`` is the tokenizer's file on every worker.  A null or empty text has no
    tokens and decodes to the empty text; repeated rows give repeated results; very long texts and
    words take time in proportion to their length; other columns, whatever their names, are not read.  ``with_ids`` adds the ids and the decoded text themselves; ``lean`` lets workers keep fewer
    words between tasks.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    rows = docs.select(docs[key], docs[text].alias("__text"))
    return rows.mapInArrow(functools.partial(_run, path, with_ids, lean), schema)
