"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import held_out

#: Longer texts are not sampled, so that a sample of so many rows has a bound in bytes too.
MOST_BYTES = 128 << 10


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, *, per_class: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents outside the evaluation fold, of up to `most_bytes` each.

    The sample is the documents whose ids hash lowest, so it depends on nothing but the
    labels; with ``per_class`` half of it comes from either class.  Rows without an id or
    a label are left out; of contradicting labels the larger counts; a document given
    several times counts once.  Only this bounded sample is broadcast.
    """
    own = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("y"))
    own = own.filter("doc_id is not null and y is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id")), F.col("doc_id")
    if per_class:
        parts = [own.filter(f"y = {y}").orderBy(*order).limit(most // 2) for y in (0, 1)]
        chosen = parts[0].unionAll(parts[1])
    else:
        chosen = own.orderBy(*order).limit(most)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    found = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
