"""Toxicity: a linear-chain conditional random field tags tokens, its marginals score texts.

A chain is a sentence (up to . ! ? or a line's end); a token has the states plain and toxic.
With two states the forward and the backward messages are one log-odds number each, so
many chains advance together as arrays.  Training tokens get their states from document
labels: a token of a toxic document is toxic if its word, or a beginning of it, is far more frequent in
toxic documents than in others (lexicon()).  The text's score is a logistic function of its largest marginal
and of the expected number and share of its toxic tokens, fitted on the same bounded sample (TRAIN_ROWS).
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, held_out, utf8_list
from countloom.llm.samples import labelled

#: Bound of the training sample, half of it toxic if there are so many.
TRAIN_ROWS = 1_600
SIZE = 1 << 18
BEGINNINGS = (3, 4, 5, 6)
#: A lexicon's unit is at least so many times as frequent in toxic documents as in others, and in so many of them; of a document so many occurrences are evidence.
RATIO, LEAST_DOCS, BURST = 8, 3, 3
#: Entries of a worker's cache of word scores (a matter of speed only).
CACHE_WORDS = 400_000
TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[.!?\n]")
ENDS = frozenset((b".", b"!", b"?", b"\n"))


def units(word: bytes) -> list[bytes]:
    """A word in small letters and its beginnings."""
    word = word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()
    return [word, *[word[:k] + b"*" for k in BEGINNINGS if len(word) > k]]


def slots(word: bytes) -> list[int]:
    return [crc32(u) % SIZE for u in units(word)]


class Chains:
    """Sentences of unequal length, advanced together: the longest come first."""

    def __init__(self, ends: np.ndarray):
        """`ends`: for each token whether it closes a chain; such tokens belong to none."""
        stops = np.flatnonzero(np.append(ends, True))
        starts = np.concatenate([[0], stops[:-1] + 1])
        lengths = stops - starts
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        self.starts, lengths = starts[order], lengths[order]
        self.lengths = lengths
        #: How many chains have a token at each step.
        self.active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")

    def messages(self, unary: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds; t: start, plain-toxic, toxic-plain, toxic-toxic (plain-plain is 0)."""
        ahead, back = np.zeros(len(unary)), np.zeros(len(unary))
        start, t01, t10, t11 = t
        for step, k in enumerate(self.active):
            at = self.starts[:k] + step
            if not step:
                ahead[at] = unary[at] + start
            else:
                a = ahead[at - 1]
                ahead[at] = unary[at] + np.logaddexp(t01, a + t11) - np.logaddexp(0, a + t10)
        for step in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[step + 1]] + step
            x = unary[at + 1] + back[at + 1]
            back[at] = np.logaddexp(t10, t11 + x) - np.logaddexp(0, t01 + x)
        return ahead, back

    def firsts(self) -> np.ndarray:
        return self.starts


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _families(texts: list[list[bytes]]) -> list[int]:
    """A number for each text that copies, and most near copies, share: the least hash of three words in a row."""
    return [min((crc32(b" ".join(ws[i : i + 3]).lower()) for i in range(max(1, len(ws) - 2))), default=0) for ws in texts]


def lexicon(texts: list[list[bytes]], y: list[int]) -> set[bytes]:
    """Units that toxic documents have far more often than others, beyond what chance gives among so many units.

    Far more often: RATIO times as often a token.  Beyond chance: the likelihood ratio, to which a document adds
    at most BURST occurrences and copies of a text add nothing, passes what the likeliest of all units reaches by chance.
    """
    docs, heard, tokens, sizes = Counter(), (Counter(), Counter()), (Counter(), Counter()), [1, 1]
    first: dict[tuple[int, int], list[bytes]] = {}
    for words, label, family in zip(texts, y, _families(texts), strict=True):
        if first.setdefault((family, label), words) is not words:
            continue
        own: Counter = Counter()
        for w, c in Counter(words).items():
            sizes[label] += c
            if w not in ENDS:
                for u in units(w):
                    own[u] += c
        tokens[label].update(own)
        heard[label].update({u: min(c, BURST) for u, c in own.items()})
        if label:
            docs.update(own.keys())
    found = [u for u, n in docs.items() if n >= LEAST_DOCS]
    limit, expected = 2 * np.log(max(2, len(found))), sizes[1] / sum(sizes)
    out = set()
    for u in found:
        a, b = heard[1][u], heard[0][u]
        ratio = 2 * (a * np.log(a / (a + b) / expected) + (b * np.log(b / (a + b) / (1 - expected)) if b else 0))
        if ratio >= limit and tokens[1][u] / sizes[1] >= RATIO * (tokens[0][u] + 0.5) / sizes[0]:
            out.add(u)
    return out


def token_labels(texts: list[list[bytes]], y: list[int]) -> list[np.ndarray]:
    """States of the training tokens, from the labels of their documents."""
    toxic = lexicon(texts, y)
    known: dict[bytes, bool] = {}
    out = []
    for words, label in zip(texts, y, strict=True):
        if label:
            for w in words:
                if w not in known:
                    known[w] = w not in ENDS and not toxic.isdisjoint(units(w))
        out.append(np.array([label == 1 and known[w] for w in words], bool))
    return out


class Crf:
    """weights by slot, the constant, the transitions, and the weights of the text's score."""

    def __init__(self, weights, constant, transitions, top):
        self.weights, self.constant, self.transitions, self.top = weights, constant, transitions, top

    def marginals(self, unary: np.ndarray, ends: np.ndarray) -> np.ndarray:
        chains = Chains(ends)
        ahead, back = chains.messages(np.where(ends, 0.0, unary), self.transitions)
        return np.where(ends, 0.0, sigmoid(ahead + back))


#: What summary() says of a text without tokens.
NOTHING = (-12.0, -12.0, -12.0)


def summary(p: np.ndarray) -> tuple[float, float, float]:
    """Log-odds of the largest marginal, and logs of the expected toxic tokens and of their share of all."""
    if not len(p):
        return NOTHING
    most, total = min(max(float(p.max()), 6e-6), 1 - 6e-6), float(p.sum()) + 6e-6
    return float(np.log(most / (1 - most))), float(np.log(total)), float(np.log(total / len(p)))


def score_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Penalised logistic regression on the columns of x, the first of them constant, the others with no weight below 0.

    Newton steps, halved until they lower the loss; they end where the gradient does.  A column
    whose weight would be negative is left out.  Finite for separable and for one-sided samples.
    """
    columns = list(range(x.shape[1]))
    while True:
        own, w = x[:, columns], np.zeros(len(columns))
        penalty = np.full(len(columns), ridge)

        def loss(w, own=own, penalty=penalty):
            z = own @ w
            return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

        now = loss(w)
        for _ in range(200):
            q = sigmoid(own @ w)
            gradient = own.T @ (q - y) + penalty * w
            if np.abs(gradient).max() < 1e-6 * max(1, len(y)):
                break
            step = np.linalg.solve((own * (q * (1 - q))[:, None]).T @ own + np.diag(penalty), gradient)
            size = 1.0
            while size > 1e-9 and loss(w - size * step) > now:
                size /= 2
            if size <= 1e-9:
                break
            w = w - size * step
            now = loss(w)
        wrong = [k for k in range(1, len(columns)) if w[k] < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[columns] = w
            return out
        del columns[min(wrong, key=lambda k: w[k])]


def fit(texts: list[bytes], y: list[int], *, steps: int = 25, rate: float = 0.5, l2: float = 1e-6) -> Crf:
    """Train by adaptive gradient on the chains' conditional likelihood."""
    words = [TOKENS.findall(t) for t in texts]
    states = token_labels(words, y)
    if not any(s.any() for s in states):  # nothing to learn from: every text has the sample's share of toxic ones
        share = (sum(y) + 0.5) / (len(y) + 1)
        return Crf(np.zeros(SIZE, np.float32), -12.0, np.zeros(4), (min(float(np.log(share / (1 - share))), -0.01), 0.0, 0.0, 0.0))
    flat = [w for ws in words for w in (*ws, b"\n")]
    truth = np.concatenate([x for s in states for x in (s, [False])]).astype(float)
    kinds = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    kind = np.fromiter((kinds[w] for w in flat), np.int64, len(flat))
    ends = np.fromiter((w in ENDS for w in flat), bool, len(flat))
    own = [[] if w in ENDS else slots(w) for w in kinds]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    col = np.fromiter((s for x in own for s in x), np.int64, len(row))
    chains = Chains(ends)
    inner = ~ends[1:] & ~ends[:-1]
    firsts = chains.firsts()
    weights, gw = np.zeros(SIZE), np.full(SIZE, 1e-8)
    rest, gr = np.array([-3.0, 0.0, 0.0, 0.0, 0.0]), np.full(5, 1e-8)  # constant and transitions
    scale = 1.0 / max(1.0, truth.sum())
    true_pairs = [(truth[:-1] * (1 - truth[1:]) * inner).sum(), ((1 - truth[:-1]) * truth[1:] * inner).sum(), (truth[:-1] * truth[1:] * inner).sum()]
    for _ in range(steps):
        by_kind = np.bincount(row, weights[col], minlength=len(own)) + rest[0]
        unary = np.where(ends, 0.0, by_kind[kind])
        ahead, back = chains.messages(unary, rest[1:])
        p = np.where(ends, 0.0, sigmoid(ahead + back))
        # joint of neighbours, from the messages: states (1,0), (0,1), (1,1) against (0,0)
        x, z = ahead[:-1], unary[1:] + back[1:]
        logs = np.stack([x + rest[3], z + rest[2], x + z + rest[4]])
        joint = np.exp(logs - np.logaddexp.reduce(np.concatenate([logs, np.zeros((1, len(x)))]), axis=0)) * inner
        miss = truth - p
        g = np.bincount(col, np.bincount(kind, miss, minlength=len(own))[row], minlength=SIZE) * scale - l2 * weights
        h = np.array([miss.sum(), miss[firsts].sum(), true_pairs[1] - joint[1].sum(), true_pairs[0] - joint[0].sum(), true_pairs[2] - joint[2].sum()]) * scale
        gw += g * g
        gr += h * h
        weights += rate * g / np.sqrt(gw)
        rest += rate * h / np.sqrt(gr)
    model = Crf(weights.astype(np.float32), float(rest[0]), rest[1:].copy(), None)
    cuts = np.cumsum([len(w) + 1 for w in words])[:-1]
    x = np.array([(1.0, *summary(part)) for part in np.split(p, cuts)])
    model.top = tuple(score_weights(x, np.array(y, float)).tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = TRAIN_ROWS) -> Crf:
    """Fit on at most `rows` labelled documents outside the evaluation fold."""
    got = labelled(docs, labels, label, rows, per_class=True).toArrow().sort_by("doc_id")
    return fit([t or b"" for t in utf8_list(got.column("text"))], got.column("y").to_pylist())


class WordScores(dict):
    """Unary log-odds by word; not a number for a chain's end."""

    def __init__(self, model: Crf):
        super().__init__({e: np.nan for e in ENDS})
        self.model = model

    def __missing__(self, word: bytes) -> float:
        value = self[word] = float(self.model.weights[slots(word)].sum()) + self.model.constant
        return value


def _spans(raw: bytes, hit: np.ndarray) -> list[dict]:
    """Code-point offsets of runs of toxic tokens."""
    out, last = [], None
    for k, m in enumerate(TOKENS.finditer(raw)):
        if hit[k]:
            if last is not None and last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    at = {0: 0}
    done = 0
    for x in sorted({x for s in out for x in s}):
        at[x] = at[done] + len(raw[done:x].decode("utf-8", "replace"))
        done = x
    return [{"start": at[a], "end": at[b]} for a, b in out]


def _run(bc, batches):
    model = bc.value
    scores = WordScores(model)
    for batch in batches:
        raw = [t or b"" for t in utf8_list(batch.column(1))]
        total, spans = np.zeros(len(raw)), [[] for _ in raw]
        start = size = 0
        for i, t in enumerate(raw):
            size += len(t)
            if size < 2_000_000 and i + 1 < len(raw):
                continue
            if len(scores) > CACHE_WORDS:
                scores = WordScores(model)
            lists = [TOKENS.findall(t) for t in raw[start : i + 1]]
            parts = [np.fromiter(map(scores.__getitem__, ws), float, len(ws)) for ws in lists]
            unary = np.concatenate([x for part in parts for x in (part, [np.nan])])
            p = model.marginals(unary, np.isnan(unary))
            cuts = np.cumsum([len(w) + 1 for w in lists])[:-1]
            for k, part in enumerate(np.split(p, cuts)):
                total[start + k] = sigmoid(np.dot(model.top, (1.0, *summary(part))))
                if (part >= 0.5).any():
                    spans[start + k] = _spans(raw[start + k], part >= 0.5)
            start, size = i + 1, 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"])


def score(docs: DataFrame, model: Crf, *, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row.

    spans: code-point offsets of the toxic tokens' runs.  Null and empty texts have no
    token and get the score of none.  Repeated rows get equal results; very long texts are scored whole; other
    columns, whatever their names, are not read.  If the sample has no toxic token, every text gets the sample's
    share of toxic documents as its score, or one just below 0.5 if that is higher; an empty table has no rows.  Ties: a
    score of the threshold is predicted 1, equal scores are no order.
    """
    bounded_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights, whatever the input
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    scored = rows.mapInArrow(lambda batches: _run(bc, batches), "doc_id bigint, score double, spans array<struct<start:int,end:int>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
