"""Embedding whitening by TSQR: no covariance matrix is ever formed to find the components.

1. Sums: entries become whole numbers, and their sums are exact, whatever the order of rows.
2. TSQR: each task centres its rows by the exact sums and keeps one R factor, into which it folds rows block by
   block; R factors are merged sixteen at a time in a tree of Spark jobs until one is left.
3. The SVD of the last R (dimension x dimension, the only thing the driver sees) gives right vectors and singular
   values, which whiten each row on its own.
4. The covariance of the whitened rows is measured by Spark's mergeable central moments and held against the identity.

Memory of a task: some thousand rows and one factor.  Tasks are named by their partition, so a lost executor's tasks
are simply run again.

Defined cases: rows whose vector is null, or holds a null, a non-finite entry or one of 2^43 or more (``SCALE`` times
it is no longer a whole number of double precision), are dropped; of vectors of several lengths those of the most
frequent one stay (the longest of several).  Null and repeated ids and repeated vectors are rows like any other.
Components whose singular value is rounding noise (constant tables, a single row, fewer rows than components) have no
whitened value and are left out; an empty table, or one of empty vectors, gives no rows.  ``deviation`` is null where
it needs more than 38 digits.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import discard, materialise, prepare

SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more are not usable.
LARGEST = 2.0**43
#: Rows that are folded into a factor at once.
BLOCK_ROWS = 4096
#: Factors merged by one task.
FAN_IN = 16


@dataclass(frozen=True)
class Whitening:
    """What whitens a row: exact sums, and components with their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray  # a row each, of unit length
    eigenvalues: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once: the whole part of the mean is taken off as a whole number."""
        return _centred(x, self.n, self.sums)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """sum of (n x - sums)^2 by row, exact."""
        whole = [s // self.n for s in self.sums]
        y = x - np.array(whole, np.int64)
        rest = [s - q * self.n for s, q in zip(self.sums, whole, strict=True)]
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < math.isqrt((1 << 62) // max(len(whole), 1)):
            d = self.n * y - np.array(rest, np.int64)
            return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
        values = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
        return pa.array([v if v < 10**38 else None for v in values], pa.decimal128(38, 0))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = [s // n for s in sums]
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([(s - q * n) / n for s, q in zip(sums, whole, strict=True)])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): rows with a vector whose entries are all there, finite and not too large."""
    v = F.col(vector_column).cast("array<double>")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(LARGEST)))
    return vectors.select(F.col(id_column).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~odd)


def _whole(b: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, whole-number rows) of a batch, for each length of vector in it."""
    column = b.column("v")
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64) + shift
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat.reshape(-1, d) if len(at) == len(lengths) and d else flat[starts[at][:, None] + np.arange(d)]


def exact_sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]] | None:
    """(n, sums by dimension) of the vectors of the most frequent length; None if there are no rows.

    A row for each batch and dimension is summed by Spark; one row of the dimension's size reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _whole(b, scale, shift):
                d = x.shape[1]
                sums = x.sum(axis=0) if d else np.zeros(1, np.int64)
                # halves, so that no sum of a task's batches leaves 64 bits
                yield pa.RecordBatch.from_pydict({"d": np.full(len(sums), d, np.int32), "k": np.arange(len(sums), dtype=np.int32), "s": sums, "n": np.full(len(sums), len(at))})

    by_batch = rows.select("v").mapInArrow(run, "d int, k int, s long, n long")
    by_place = by_batch.groupBy("d", "k").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n"))
    best = by_place.groupBy("d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("d")).first()
    return (best["n"], [int(x["s"]) for x in best["sums"]][: best["d"]]) if best else None


def _folded(r: np.ndarray | None, rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack([*([] if r is None else [r]), *rows]), mode="r")


def tsqr(rows: DataFrame, n: int, sums: list[int], scale: int, shift: int) -> np.ndarray:
    """The R factor of all centred rows."""
    d = len(sums)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, waiting = None, [], 0
        for b in batches:
            for _, x in _whole(b, scale, shift):
                if x.shape[1] == d:
                    held.append(_centred(x, n, sums))
                    waiting += len(x)
            if waiting >= BLOCK_ROWS:
                r, held, waiting = _folded(r, held), [], 0
        if held:
            r = _folded(r, held)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        k = table.column("k").to_pylist()
        parts = [np.frombuffer(x, np.float64).reshape(-1, d) for _, x in sorted(zip(k, table.column("r").to_pylist(), strict=True))]
        return pa.table({"k": pa.array([k[0] // FAN_IN], pa.int64()), "r": pa.array([_folded(None, parts).tobytes()], pa.binary())})

    level = materialise(rows.select("v").mapInArrow(factor, "k long, r binary"), "factors")
    span = level.agg(F.max("k")).first()[0] + 1
    while span > 1:
        merged = materialise(level.groupBy((F.col("k") / FAN_IN).cast("long").alias("g")).applyInArrow(merge, "k long, r binary"), "factors")
        discard(level)
        level, span = merged, -(-span // FAN_IN)
    r = np.frombuffer(level.first()["r"], np.float64).reshape(-1, d)
    discard(level)
    return r


def fit(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of a table's usable vectors; None if there are none."""
    prepare(vectors.sparkSession)
    rows = usable(vectors, id_column, vector_column)
    found = exact_sums(rows, scale, shift)
    if found is None or not found[1]:
        return None
    n, sums = found
    _, s, right = np.linalg.svd(tsqr(rows, n, sums, scale, shift))
    s = np.concatenate([s, np.zeros(len(sums) - len(s))])
    real = int((s > s[0] * max(n, len(sums)) * np.finfo(float).eps).sum())
    k = min(components, real)
    e = s[:k] ** 2 / n
    return Whitening(n, sums, right[:k], e, e / max(float((s**2).sum() / n), np.finfo(float).tiny))


def apply(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, deviation decimal, whitened array): each usable row of the model's length."""
    d, by = len(model.sums), (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _whole(b, scale, shift):
                if x.shape[1] == d:
                    w = model.centred(x) @ by
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), model.deviations(x), lists], names=["id", "deviation", "whitened"])

    rows = usable(vectors, id_column, vector_column)
    prepare(vectors.sparkSession)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (divisor n, centred) minus the identity."""
    at = lambda i: F.col("whitened")[i]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max((abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs), default=0.0)


def whitened_components(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each usable vector and component.

    id_column, component (from 1), n, deviation (decimal), whitened, explained, identity_error (one value).
    """
    model = fit(vectors, id_column, vector_column, components, scale, shift)
    kind = vectors.schema[id_column].dataType.simpleString()
    if model is None or not len(model.eigenvalues):
        schema = f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    rows = materialise(apply(vectors, model, id_column, vector_column, scale, shift), "whitened")
    error = identity_error(rows, len(model.eigenvalues))
    shares: Column = F.array(*[F.lit(float(x)) for x in model.explained])
    long = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
