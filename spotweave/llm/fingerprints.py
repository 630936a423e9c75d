"""Order MinHash fingerprints of texts, sensitive to edits and to the order of what is kept.

A text's k-mers of code points (the whole text, if it is shorter) are numbered by occurrence, so repeats differ.
Their hashes fall into BUCKETS parts of the hash range; of each part the TUPLE smallest are taken, put in text
order, and hashed as a tuple of k-mers: 16 bits, four hex digits, `----` for an empty part. Two fingerprints'
likeness is the share of equal tuples among the parts that are filled in one of them; texts of which
neither has a k-mer (empty texts) are alike. Equal texts have equal fingerprints.

Null texts are empty. The next document of each is found by cutting the id range at quantiles into ranges of
bounded size, sorted descending each; a range's last document gets a copy of the first of the range below it,
and the very last that of the very first. So texts are dealt once, and no task holds a range. Null ids come
last. Rows that repeat an id are neighbours, ordered by a hash of their text. A single document is its own
next one. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.text import mix, slices

K = 5
BUCKETS = 128
TUPLE = 2
#: Code points of text for each range of ids, and how many ranges there can be; beyond that they grow. Tasks stream ranges.
RANGE_CHARS = 4_000_000
MAX_RANGES = 1 << 16

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BITS = BUCKETS.bit_length() - 1


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kmers(x: np.ndarray) -> np.ndarray:
    """A hash of each k-mer, in text order."""
    if not len(x):
        return np.zeros(0, _U)
    k = min(K, len(x))
    h = np.zeros(len(x) - k + 1, _U)
    x = x.astype(_U)
    for i in range(k):
        h *= _BASE
        h += x[i : len(x) - k + 1 + i]
    return mix(h + _U(k))


def _occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return np.zeros(len(h), _U)
    start = np.flatnonzero(new)
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return out.astype(_U)


def fingerprint(x: np.ndarray) -> np.ndarray:
    """A tuple's hash for each part of the range, -1 where it is empty."""
    out = np.full(BUCKETS, -1, np.int64)
    h = _kmers(x)
    if not len(h):
        return out
    key = mix(h ^ mix(_occurrences(h) + _U(1)))
    small = np.arange(len(key))
    low = key << _U(_BITS)
    if len(key) > 40 * BUCKETS:  # most are too large to be taken: enough are left, or all are looked at
        some = np.flatnonzero(low < _U(int(2**64 * 16 * BUCKETS / len(key))))
        if (np.bincount((key[some] >> _U(64 - _BITS)).astype(np.int64), minlength=BUCKETS) >= TUPLE).all():
            small = some
    order = small[np.argsort(key[small], kind="stable")]
    bucket = (key[order] >> _U(64 - _BITS)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.append(start[1:], len(bucket))
    taken = np.stack([np.where(start + i < end, order[np.minimum(start + i, len(order) - 1)], len(h)) for i in range(TUPLE)], 1)
    taken.sort(1)  # text order; a missing one last
    parts = np.append(h, _U(0))[taken]
    total = np.zeros(len(parts), _U)
    for i in range(TUPLE):
        total = mix(total * _U(31) + parts[:, i] + _U(i + 1))
    out[bucket[start]] = (total >> _U(48)).astype(np.int64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a >= 0) | (b >= 0)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def as_string(f: np.ndarray) -> str:
    return "".join("----" if x < 0 else f"{x:04x}" for x in f.tolist())


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _above(marks: list[int]) -> Column:
    """How many of the ascending marks are at least the id: a binary search in the plan."""
    if not marks:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")  # folded to one constant
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(marks).bit_length()))])
    below = F.reduce(steps, F.lit(0), lambda at, step: F.when((at + step <= len(marks)) & (F.get(held, at + step - 1) < F.col("id")), at + step).otherwise(at))
    return F.lit(len(marks)) - below


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """(range, extra, id, text): each range's documents by descending id, then, marked extra, the one that follows its last."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.length("text")).alias("chars")).first().chars or 0
    n = min(MAX_RANGES, max(1, -(-size // range_chars)))
    marks = source.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("m")).first().m if n > 1 else []
    marks = sorted(set(marks or []))
    ranged = source.withColumn("range", F.when(F.col("id").isNull(), F.lit(len(marks) + 1)).otherwise(_above(marks)))
    # The first row of each range: the greatest id, then the smallest hash. At most MAX_RANGES + 1 rows.
    keys = [F.coalesce("id", F.lit(-(1 << 63))).alias("first_id"), F.bitwise_not(F.xxhash64("text")).alias("first_tie")]
    heads = sorted((r.range, r.first.first_id, r.first.first_tie) for r in ranged.groupBy("range").agg(F.max(F.struct(*keys)).alias("first")).collect())
    following = [(of, *heads[i][1:], heads[i - 1][0]) for i, (of, *_) in enumerate(heads)]
    heads = docs.sparkSession.createDataFrame(following, "range int, first_id long, first_tie long, to int")
    extra = ranged.select("*", *keys).join(F.broadcast(heads), ["range", "first_id", "first_tie"]).dropDuplicates(["range"])
    return ranged.select("range", F.lit(False).alias("extra"), "id", "text").unionByName(extra.select(F.col("to").alias("range"), F.lit(True).alias("extra"), "id", "text"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None
        for batch in slices(batches, "text"):
            rows = []
            for of, extra, i, text in zip(*(batch.column(c).to_pylist() for c in ("range", "extra", "id", "text")), strict=True):
                own = fingerprint(points(text))
                if previous is not None and previous[0] == of:
                    _, j, body, before = previous
                    new = edited(body, text)
                    changed = fingerprint(points(new))
                    rows.append((j, len(body), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_string(before), as_string(changed), likeness(before, changed), likeness(before, own)))
                previous = None if extra else (of, i, text, own)
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = with_next(docs, id_col, text_col)
    dealt = dealt.repartition("range").sortWithinPartitions("range", "extra", F.desc_nulls_last("id"), F.xxhash64("text"))
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
