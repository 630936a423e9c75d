"""Whitening of embeddings by a randomised range finder over all rows.

Each component c of a vector becomes the integer x = floor(64 c) + 1,000,000, so sums are exact. The fit reads all vectors
in every pass: tasks centre their rows and multiply them with a narrow matrix Q, and partial products, a matrix of
dimensions x columns of each task, are added up by shuffled row of the matrix. The driver holds matrices of that size only.

    Q = orthonormal random columns, MOST + OVERSAMPLE of them;  POWER times: Q = orthonormal V Q
    Rayleigh-Ritz: eigenvectors of Q' V Q, taken back by Q;  residual |V u - e u| of each component

Where a residual is above TOLERANCE times the largest eigenvalue, the columns are doubled, up to the full dimension, in which
Q is the identity and the result is exact up to rounding. A flat spectrum ends there.

Vectors that are null or hold null or non-finite components take no part; nor do empty ones, those of another length than
the most common one (of several, the longest), and those with a component of 2^46 or more, which has no exact x. Repeated rows
count each. Components without variance (at most TOLERANCE of the largest) are left out, so a table of equal vectors gives no
row. `deviation` is null where it doesn't fit a long. Null ids are kept; columns of any other name are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.tables import written

#: Components; columns of the range finder besides them; power passes of a try.
MOST, OVERSAMPLE, POWER = 32, 16, 3

#: Residual and least eigenvalue, as shares of the largest eigenvalue.
TOLERANCE = 1e-12

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, float(1 << 52)

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Whitening(NamedTuple):
    """A fit. sums: of x over n rows, exact; components: unit columns; values: their eigenvalues; trace: of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def integers(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part, as a written table."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
            values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE  # null becomes NaN
            start = np.cumsum(lengths) - lengths
            good = np.logical_and.reduceat(np.abs(values) < LARGEST, start)
            keep = np.repeat(good, lengths)
            x = np.floor(values[keep]).astype(np.int64) + SHIFT
            offsets = np.concatenate([[0], np.cumsum(lengths[good])]).astype(np.int32)
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["vec_id", "x"])

    rows = written(embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).mapInArrow(scaled, "vec_id long, x array<long>"))
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _total(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all batches of rows of the matrix that `part` makes of a batch of x; by the matrix' rows to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(_matrix(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64() if kind == "double" else pa.int64()))], names=["i", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, out = None, None, []
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), _matrix(batch.column("v")) if batch.num_rows else [], strict=True):
                if i == at:
                    total = total + v
                else:
                    if at is not None:
                        out.append((at, total))
                    at, total = i, v
        if at is not None:
            out.append((at, total))
            yield pa.record_batch([pa.array([i for i, _ in out]), pa.array([v for _, v in out], batch.schema.field("v").type)], names=["i", "v"])

    schema = f"i long, v array<{kind}>"
    parts = rows.select("x").mapInArrow(each, schema).withColumn("part", F.spark_partition_id())
    sums = parts.repartition("i").sortWithinPartitions("i", "part").select("i", "v").mapInArrow(added, schema)
    return np.array([r["v"] for r in sums.orderBy("i").collect()])


def _centred(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """x -> x - S / n, rounded once: whole parts of the mean go first, in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    return lambda x: (n * (x - whole) - rest).astype(np.float64) / n


def fit(rows: DataFrame, most: int = MOST, seed: int = 13) -> Whitening | None:
    """The components of rows (x), the result of `integers`; None without rows."""
    counted = _total(rows, lambda x: np.concatenate([[len(x)], x.sum(0)])[None, :], "long")
    if not len(counted):
        return None
    n, sums = int(counted[0][0]), tuple(map(int, counted[0][1:]))
    dims, centred = len(sums), _centred(n, sums)

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and V's trace."""

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return np.concatenate([c.T @ (c @ q), np.full((1, q.shape[1]), np.einsum("ij,ij->", c, c))])

        got = _total(rows, part) / n
        return got[:-1], float(got[-1][0])

    columns = min(dims, most + OVERSAMPLE)
    while True:
        if columns == dims:
            q = np.eye(dims)
        else:
            q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, columns)))[0]
            for _ in range(POWER):
                q = np.linalg.qr(times(q)[0])[0]
        z, trace = times(q)
        small = q.T @ z
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
        u = q @ turn
        residual = np.linalg.norm(z @ turn - u * values, axis=0)
        if columns == dims or residual.max() <= TOLERANCE * max(values[0], 0):
            break
        columns = min(dims, 2 * columns)
    keep = values > TOLERANCE * max(values[0], 0)
    return Whitening(n, sums, np.ascontiguousarray(u[:, keep] / np.linalg.norm(u[:, keep], axis=0)), values[keep], trace)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Of each row, the sum of (n x - S)^2; None where it is no long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    away = x - whole
    if float(n) * (np.abs(away).max(initial=0) + 1) < 2**31 and x.shape[1] * (float(n) * (np.abs(away).max(initial=0) + 1)) ** 2 < 2**63:
        d = n * away - rest
        return (d * d).sum(1).tolist()
    exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in away]
    return [v if v < 2**63 else None for v in exact]


def whitened(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """One row for each row of `integers` and component: SCHEMA.

    identity_error is the largest absolute entry of the whitened vectors' covariance minus the identity, from two more passes.
    """
    n, sums, trace = fitted.n, fitted.sums, fitted.trace
    centred, project = _centred(n, sums), fitted.components / np.sqrt(fitted.values)
    k = project.shape[1]
    mean = _total(rows, lambda x: (centred(x) @ project).sum(0)[None, :])[0] / n

    def scatter(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ project - mean
        return w.T @ w

    error = float(np.abs(_total(rows, scatter) / n - np.eye(k)).max())
    explained = fitted.values / trace

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1))
            w = centred(x) @ project
            every = pa.array(np.repeat(np.arange(m), k))
            full = lambda v, t: pa.array(np.full(m * k, v), t)
            yield pa.record_batch(
                [
                    batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), full(n, pa.int64()), pa.array(_deviations(x, n, sums), pa.int64()).take(every),
                    pa.array(w.ravel()), pa.array(np.tile(explained, m)), full(error, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(spread, SCHEMA)


def whiten(embeddings: DataFrame, most: int = MOST) -> DataFrame:
    """SCHEMA for every vector that takes part and up to `most` components."""
    rows = integers(embeddings)
    fitted = fit(rows, most)
    if fitted is None or not len(fitted.values):
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    return whitened(rows, fitted)
