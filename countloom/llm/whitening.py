"""Whitening of embeddings by MLlib's singular value decomposition of the centred rows.

Entries become integers, so means and deviations are exact: with n vectors of sums S, a vector deviates by n * x - S.  The
deviations over n are the rows of a RowMatrix; its right singular vectors are the components, and a singular
value s belongs to the variance s * s / n (divisor n).  The whole variance comes from the exact
deviations, not from the singular values.  Only per-dimension sums and the components pass through the driver.
"""

from __future__ import annotations

import functools
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import bounded_batches, cut

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on (after scaling) have no exact integer of their own.
LARGEST = float(1 << 53)
#: Components with less of the first one's variance than this have none that doubles could tell.
FLOOR = 1e-13


def quantised(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each vector, whether it counts, vector of each entry, entries as exact integers).

    Vectors count that aren't null or empty, nor hold null, non-finite or too large entries; entries of others are anything.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.abs(entries) < LARGEST / SCALE  # not a number: no
    x = np.floor(np.where(good, entries, 0.0) * SCALE).astype(np.int64) + SHIFT
    return lengths, (lengths > 0) & (np.bincount(row[~good], minlength=len(lengths)) == 0), row, x


def of_length(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors count and have d entries, their integers as rows)."""
    lengths, counts, row, x = quantised(column)
    keep = counts & (lengths == d)
    return np.flatnonzero(keep), x[keep[row]].reshape(-1, d)


SUMS = "d int, at int, n bigint, s decimal(38,0)"


def _sums(batches):
    """A task's vectors by length, and the sums of their entries."""
    total: dict[int, list] = {}
    for batch in batches:
        lengths, counts, row, x = quantised(batch.column(0))
        for d in np.unique(lengths[counts]).tolist():
            keep = counts & (lengths == d)
            own = x[keep[row]].reshape(-1, d)
            if int(np.abs(own).max()) * len(own) >= 1 << 62:
                own = own.astype(object)
            n, s = total.get(d, (0, 0))
            total[d] = [n + len(own), own.sum(axis=0).astype(object) + s]
    rows = [(d, at, n, Decimal(int(v))) for d, (n, s) in total.items() for at, v in enumerate(s)]
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["d", "at", "n", "s"])


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of the vectors (vec_id, v) of the commonest length (of equally common ones the largest)."""
    found = cut(vectors.select("v").mapInArrow(_sums, SUMS).groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    first = found.filter("at = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return 0, []
    return first["n"], [int(r["s"]) for r in found.filter(F.col("d") == first["d"]).orderBy("at").collect()]  # a row a dimension


def _centred(n, total, batches):
    whole, part = means(n, total)
    for batch in batches:
        x = of_length(batch.column(0), len(total))[1]
        yield pa.RecordBatch.from_arrays([pa.array(list((x - whole) - part), pa.list_(pa.float64()))], ["v"])


def components(vectors: DataFrame, n: int, total: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit components as columns, their variances), by falling variance; those without any left out.

    All d are asked for, so that MLlib solves the Gramian by LAPACK to double precision; k of them are kept.
    """
    centred = vectors.select("v").mapInArrow(functools.partial(_centred, n, total), "v array<double>")
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("v").alias("v")), "v"), n, len(total))
    found = matrix.computeSVD(len(total), computeU=False)
    variance = np.asarray(found.s.toArray()) ** 2 / n
    some = (variance > 0) & (variance > FLOOR * variance.max(initial=0))
    return found.V.toArray()[:, : len(variance)][:, some][:, :k], variance[some][:k]


def means(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The means S / n as whole numbers and parts below 1, so that centring rounds once only."""
    return np.array([s // n for s in total], np.int64), np.array([s % n / n for s in total], np.float64)


def deviations(off: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """Each row's sum of squares of n * x - S, exactly; off: x less the whole mean, rest: S less n whole means."""
    if off.size and off.shape[1] * (n * (int(np.abs(off).max()) + 1)) ** 2 < 1 << 63:
        return ((n * off - rest) ** 2).sum(axis=1).tolist()
    return ((n * off.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist() if off.size else []


def _project(n, total, basis, batches):
    whole, part = means(n, total)
    rest = np.array([s % n for s in total], np.int64)
    for batch in batches:
        which, x = of_length(batch.column(1), len(total))
        off = x - whole
        exact = deviations(off, rest, n)
        white = (off - part) @ basis
        columns = [
            batch.column(0).take(pa.array(which)),
            pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
            pa.array([v / (n * n) for v in exact], pa.float64()),
            pa.array(list(white), pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "square", "white"])


def whiten(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component up to k.

    Rows go whose vector is null or holds null, non-finite or (2 ** 53 and more after scaling) too large entries, and so do empty
    vectors and those of another length than most; all others, repeated ones and null ids included, are in the fit
    and in the result.  Components without variance are left out, so there are fewer than k where the vectors span less, and
    none, with no rows, where all vectors are equal; of equal variances either comes first.  A deviation that no BIGINT holds is null.  Empty tables
    give no rows; other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = vectors.select(vectors[key].cast("bigint").alias("vec_id"), vectors[vector].alias("v"))
    n, total = sums(rows)
    basis, variance = components(rows, n, total, k) if n else (np.zeros((0, 0)), np.zeros(0))
    if not len(variance):
        return spark.createDataFrame([], schema)
    basis = basis / np.sqrt(variance)
    done = cut(rows.mapInArrow(functools.partial(_project, n, total, basis), "vec_id bigint, deviation bigint, square double, white array<double>"))
    # whitened's covariance, one row of sums
    place = range(len(variance))
    pairs = [(i, j) for i in place for j in place if i <= j]
    found = done.agg(F.sum("square"), *(F.sum(F.get("white", i)) for i in place), *(F.sum(F.get("white", i) * F.get("white", j)) for i, j in pairs)).first()
    mean = [found[1 + i] / n for i in place]
    error = max(abs(found[1 + len(mean) + c] / n - mean[i] * mean[j] - (i == j)) for c, (i, j) in enumerate(pairs))
    share = variance / (found[0] / n)
    each = done.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(share), F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
