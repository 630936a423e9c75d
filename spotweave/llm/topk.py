"""Exact top-k by inner product: a pivot-distance index (iDistance) with bounds by the triangle inequality.

Components x become floor(64 x); the score is the integer inner product. With M the largest norm, a vector v
gets one more component sqrt(M^2 - |v|^2) and a query q gets 0: then all vectors are M long, and the distance
d(q, v)^2 = |q|^2 + M^2 - 2 q.v orders as the score does, so bounds for distances hold for scores.

Index: each vector is keyed by its nearest pivot (a bounded sample, PIVOTS, fixed by hash) and its distance to
it, sorted by that key over the cluster, and cut into blocks of at most BLOCK vectors: annuli around a pivot,
each with its least and greatest distance. Every vector is indexed.

Search: a query starts in its own block, which gives its k-th distance so far. It then needs an annulus
[lo, hi] of pivot p only if [d(q,p) - dk, d(q,p) + dk] meets it. Queries are held in blocks, too; a block of queries
visits an annulus once, with the queries that need it, and returns those of the annulus's k best that can still be among the k
best of all. Blocks are joined by pivot, which keeps both sides as block rows, never pairs of vectors.

Ties go to the smaller id. Null vectors and those with null or non-finite components take no part. Vectors of
different lengths count as filled up with zeros. Scores are exact while their absolute values stay below 2^63;
below 2^53 they are computed in floating point without rounding. Rows that repeat an id with other vectors are
candidates of that id each; a query id asks with each of its rows. Fewer than k candidates give all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.tables import written

SCALE = 64
K = 20
#: Pivots: a sample whose size does not depend on the data.
PIVOTS = 64
BLOCK = 4096
#: Queries that are searched for together.
ASKS = 4096


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): integer vectors of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    source = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.col(vector_col)).where(fine & F.col("id").isNotNull())
    return source.select("id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(column)), size), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(q: np.ndarray, v: np.ndarray, norm2: int) -> np.ndarray:
    if norm2 < 1 << 53:  # no sum of products can be longer
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _lifted(v: np.ndarray, norm2: int) -> np.ndarray:
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, float(norm2) - (x * x).sum(1)))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _reach(q: np.ndarray, least: np.ndarray, norm2: int, slack: float) -> np.ndarray:
    """The distance within which a query's k best lie, given a score that the k-th has at least."""
    square = np.maximum(0.0, (q * q).sum(1) + float(norm2) - 2.0 * least.astype(np.float64))
    return np.where(least == np.iinfo(np.int64).min, np.inf, np.sqrt(square)) + slack


def top_k(vectors: DataFrame, k: int = K, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (id divisible by `every`) its k best of all other rows."""
    table = written(quantised(vectors, id_col, vector_col))
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, e: (a + e.cast("decimal(38,0)") * e).cast("decimal(38,0)"))
    found = table.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("norm2"), F.count("*").alias("n")).first()
    width, norm2 = max(1, found.width or 0), int(found.norm2 or 0)
    sample = table.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivot_rows = np.array([(list(r.v) + [0] * width)[:width] for r in sample] or [[0] * width], np.int64)
    pivots = _lifted(pivot_rows, norm2)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if norm2 <= np.iinfo(t).max ** 2)  # holds every component
    slack = 1e-6 * (float(norm2) ** 0.5 + 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_lifted(_matrix(b.column("v"), width), norm2), pivots)
            at = d.argmin(1)
            yield pa.record_batch([b.column("id"), b.column("v"), pa.array(at, pa.int64()), pa.array(d[np.arange(len(d)), at])], names=["id", "v", "pivot", "distance"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            pivot, r = t.column("pivot").to_numpy(), t.column("distance").to_numpy()
            ids, v = t.column("id").to_numpy(), _matrix(t.column("v").combine_chunks(), width)
            for a in np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]])):
                end = int(np.searchsorted(pivot, pivot[a], "right"))
                yield pa.record_batch(
                    [pa.array([int(pivot[a])]), pa.array([r[a]]), pa.array([r[end - 1]]), pa.array([ids[a:end].tobytes()]), pa.array([v[a:end].astype(kind).tobytes()])],
                    names=["pivot", "lo", "hi", "ids", "vectors"],
                )

        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                if held and sum(x.num_rows for x in held) + part.num_rows > BLOCK:
                    yield from flush()
                    held = []
                held.append(part)
        if held and sum(x.num_rows for x in held):
            yield from flush()

    parts = max(1, -(-found.n // (4 * BLOCK)))
    index = table.mapInArrow(keyed, "id long, v array<long>, pivot long, distance double")
    index = index.repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    index = index.mapInArrow(blocks, "pivot long, lo double, hi double, ids binary, vectors binary")
    index = written(index.withColumn("block", F.monotonically_increasing_id()))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their k-th score in their own block, and for each pivot the distances that they need."""
        held, size, first = [], 0, 0

        def flush() -> pa.RecordBatch:
            ids, v, least, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            values = [first, ids.tobytes(), v.tobytes(), least.tobytes(), low.min(0).tolist(), high.max(0).tolist()]
            return pa.record_batch([pa.array([x]) for x in values], names=["asks", "q_ids", "q_vectors", "least", "from", "to"])

        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                v = np.frombuffer(r["vectors"], kind).reshape(-1, width)
                ask = np.flatnonzero(ids % every == 0)
                if not len(ask):
                    continue
                s = _scores(v[ask].astype(np.int64), v.astype(np.int64), norm2)
                s = np.where(ids[ask][:, None] == ids, np.iinfo(np.int64).min, s)
                least = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(ask), np.iinfo(np.int64).min)
                q = v[ask].astype(np.float64)
                d = _distances(np.column_stack([q, np.zeros(len(q))]), pivots)
                reach = _reach(q, least, norm2, slack)[:, None]
                if size and size + len(ask) > ASKS:
                    yield flush()
                    held, size = [], 0
                if not size:
                    first = r["block"]
                held.append((ids[ask], v[ask], least, d - reach, d + reach))
                size += len(ask)
        if size:
            yield flush()

    asks = written(index.mapInArrow(start, "asks long, q_ids binary, q_vectors binary, least binary, `from` array<double>, `to` array<double>"))
    # Which annuli does a block of queries need? Rows here are blocks and pivots, without vectors.
    zones = asks.select("asks", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(pivots) - 1)).alias("pivot"), F.col("from").alias("a"), F.col("to").alias("b"))).alias("z"))
    zones = zones.select("asks", F.col("z.pivot").cast("long").alias("pivot"), "z.a", "z.b")
    visits = index.select("pivot", "lo", "hi", "block").join(zones, "pivot").where("lo <= b and hi >= a").select("block", "asks")
    joined = visits.join(index, "block").join(asks.select("asks", "q_ids", "q_vectors", "least"), "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], kind).reshape(-1, width).astype(np.int64)
                q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"], kind).reshape(-1, width).astype(np.int64)
                least = np.frombuffer(r["least"], np.int64)
                x = q.astype(np.float64)
                to = _distances(np.column_stack([x, np.zeros(len(x))]), pivots[r["pivot"]][None])[:, 0]
                reach = _reach(x, least, norm2, slack)
                need = np.flatnonzero((to - reach <= r["hi"]) & (to + reach >= r["lo"]))
                if not len(need):
                    continue
                s = _scores(q[need], v, norm2)
                other = q_ids[need][:, None] != ids
                at = np.argwhere((s >= least[need][:, None]) & other)
                score = s[at[:, 0], at[:, 1]]
                order = np.lexsort((ids[at[:, 1]], -score, at[:, 0]))  # the k best of the annulus for each query
                at, score = at[order], score[order]
                first = np.searchsorted(at[:, 0], at[:, 0])
                good = np.arange(len(at)) - first < k
                yield pa.record_batch([pa.array(q_ids[need][at[good, 0]]), pa.array(ids[at[good, 1]]), pa.array(score[good])], names=["query_id", "vec_id", "score"])

    near = joined.select("pivot", "lo", "hi", "ids", "vectors", "q_ids", "q_vectors", "least").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
