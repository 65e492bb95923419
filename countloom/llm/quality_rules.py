"""Quality rules: countable base rules, then a hashed n-gram log-likelihood ratio.

Tokens (runs of letters and digits, or of other visible characters) and their bigrams are
hashed into BUCKETS.  Two multinomials are estimated over the buckets: the raw corpus (every
document) and the trusted target (every document labelled good).  A document's score is the mean
over its n-grams of log P(target) - log P(raw); at THRESHOLD or above it is kept.  All of it is
DataFrame expressions: one scan counts, one scan scores.  The counts' shuffle is of BUCKETS rows a task at most;
the ids of good documents are broadcast while they are few (BROADCAST_IDS), else joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.15
#: Ids that may be broadcast, 8 bytes each; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Observations that each bucket is given in advance, in either multinomial.
PRIOR = 0.5
MIN_WORDS, WINDOW, MAX_REPEAT = 10, 5, 20

SPLIT, VISIBLE = "[ \\t-\\r]+", "[^ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"
TOKEN = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]+"


def _buckets(hashes: Column) -> Column:
    """Buckets of all unigrams and bigrams, from the tokens' hashes."""
    one = F.transform(hashes, lambda h: h.bitwiseAND(BUCKETS - 1).cast("int"))
    two = F.zip_with(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda a, b: F.shiftrightunsigned(F.shiftleft(a, 5).bitwiseXOR(b), 17).bitwiseAND(BUCKETS - 1).cast("int"),
    )
    return F.concat(one, two)


def _with_buckets(rows: DataFrame) -> DataFrame:
    hashes = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return rows.withColumn("hashes", hashes).withColumn("buckets", _buckets(F.col("hashes"))).drop("hashes")


def bucket_weights(docs: DataFrame, labels: DataFrame, *, label: str = "quality") -> list[float]:
    """log P(target) - log P(raw) of each bucket; 0 if it never occurs.

    Raw counts cover all documents, the target's all documents with a label of 1, each as often as it is there;
    if there are none, all weights are 0.
    """
    good = labels.filter(F.col(label) == 1).select(labels["doc_id"].cast("bigint").alias("good")).filter("good is not null").distinct()
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    own = docs.select(docs["doc_id"].cast("bigint").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    marked = _with_buckets(own.join(good, F.col("id") == F.col("good"), "left"))
    # explode() would first test whether the array is empty, and for that make it once more, with all it is made of
    grams = marked.select(F.col("good").isNotNull().cast("bigint").alias("t"), F.explode_outer("buckets").alias("bucket"))
    counts = grams.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect()  # BUCKETS rows at most
    n, t = sum(r["n"] for r in counts), sum(r["t"] for r in counts)
    weights = [0.0] * BUCKETS
    for r in counts if t else ():
        weights[r["bucket"]] = math.log((r["t"] + PRIOR) / (t + PRIOR * BUCKETS)) - math.log((r["n"] + PRIOR) / (n + PRIOR * BUCKETS))
    return weights


def _repeated(rows: DataFrame) -> DataFrame:
    """Adds repeat: words in windows of WINDOW words that the text has twice or more."""
    n = F.size("words")
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("of_words", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("windows", F.transform(at, lambda i: F.xxhash64(*(F.get("of_words", i + k) for k in range(WINDOW)))))
    rows = rows.withColumn("twice", F.size("windows") > F.size(F.array_distinct("windows")))
    # equal windows stand together after sorting; documents without any skip this
    pairs = F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.withColumn("sorted", F.when(F.col("twice"), F.sort_array(pairs)))
    found = F.filter(
        "sorted",
        lambda x, k: (x["w"] == F.get("sorted", k - 1)["w"]) | (x["w"] == F.get("sorted", k + 1)["w"]),
    )
    rows = rows.withColumn("at", F.sort_array(F.transform(found, lambda x: x["i"])))
    new = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(new, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = rows.withColumn("repeat", F.coalesce(total, F.lit(0).cast("bigint")))
    return rows.drop("of_words", "windows", "twice", "sorted", "at")


def judge(docs: DataFrame, weights: list[float], *, threshold: float = THRESHOLD) -> DataFrame:
    """(row, verdict) of every row of `docs`: struct of all its columns, and struct of what is found.

    verdict: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score (null without n-grams) and kept.  Null and empty texts have no words and fail the
    base rules; very long texts are judged whole; repeated rows are judged alike; columns of `docs` may have any names.  Ties: a
    score of the threshold is kept, and shares of exactly the base rules' limits don't fail.
    """
    vector = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one array by the optimizer
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPLIT), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(VISIBLE)))
    rows = _with_buckets(_repeated(rows))
    total = F.aggregate("buckets", F.lit(0.0), lambda s, b: s + F.get(vector, b))
    rows = rows.withColumn("score", F.when(F.size("buckets") > 0, total / F.size("buckets")))
    n = F.size("words").cast("bigint")
    failed = (n < MIN_WORDS) | (F.lit(100) * F.col("repeat") > MAX_REPEAT * n)
    verdict = F.struct(
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("score"),
        (~failed & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"),
    )
    # as a generated row: a later filter stays above it, where it would otherwise go below every step and write out
    # again, each time, what its column is made of
    return rows.select("row", F.explode_outer(F.array(verdict)).alias("verdict"))


def rules(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row."""
    own = docs.select("doc_id", "text")
    return judge(own, bucket_weights(own, labels), threshold=threshold).select("row.doc_id", "verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that pass, with their columns, of whatever names, as they are; see judge()."""
    judged = judge(docs, bucket_weights(docs, labels), threshold=threshold)
    return judged.filter("verdict.kept").select("row.*")
