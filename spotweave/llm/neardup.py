"""Near-duplicate documents by HyperMinHash registers, banding, and verification on full shingle sets.

A document's set is that of its distinct 5-word shingles (words: `[^\\x20\\x09-\\x0D]+`, A-Z in lower case); a
shorter text has its whole word sequence as its one element; a text without words has the empty set and links
with nothing. Two documents are linked if 100 * intersection >= 75 * union; a component is what links reach.

1. One scan gives each document its set's size, two hashes of its set, 128 bits in all, and HyperMinHash registers: element
   hashes fall into 128 buckets, each keeps its least hash as a leading-zero count and mantissa bits. An empty
   bucket takes the register of the full bucket with the least fixed priority, so small sets fill all buckets.
2. Documents with the same set become one class before anything is compared.
3. Bands of 4 registers (32 of them) join classes; a pair at similarity 0.75 shares no band once in 10^5.
4. `linking` compares full sets within the bands' groups: each class with the least one of its bands, then what
   is not connected by that, of the first bands and then of the others. The collision-corrected estimate drops pairs
   that are far from the threshold; every other pair is intersected exactly, unless its ends are connected already.
   A failed pair hides no other, and groups of any size go by the same blocks.

Null ids: such a row gets a null component, is kept and links with nothing. Rows that repeat an id are separate
rows of that id. Ties go to the smaller id. An empty table gives an empty result. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.linking import connect
from spotweave.llm.tables import written
from spotweave.llm.text import hashes, mix, shingles, signed, slices, words

WIDTH = 5
#: Linked if THRESHOLD[1] * intersection >= THRESHOLD[0] * union.
THRESHOLD = (75, 100)
BUCKETS = 128
ROWS = 4
#: What the estimate may lack of the threshold before a pair is dropped: more than six standard deviations.
SLACK = 0.25
#: Bands whose groups are settled before those of the others: a pair at the threshold is in one of them nine times of ten.
FIRST_BANDS = 8
#: Classes of a band's group that are compared in one block.
GROUP = 512

_U = np.uint64
_MANTISSA, _SMALL_MANTISSA = 10, 3
_PRIORITY = mix(np.arange(BUCKETS * BUCKETS, dtype=_U) + _U(77)).reshape(BUCKETS, BUCKETS)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(texts)
    h = hashes(w.vocabulary)[w.codes]
    for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True):
        s = shingles(h[a:b], width)
        s.sort()
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _registers(s: np.ndarray) -> np.ndarray:
    """A 16-bit register a bucket for a sorted, non-empty set: 6 bits leading zeros, 10 bits mantissa."""
    bucket = (s >> _U(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = s[first] << _U(7)
    zeros = np.full(len(rest), 63, np.int64)
    full = rest != 0
    zeros[full] = 64 - np.frexp(rest[full].astype(np.float64))[1]
    mantissa = ((rest << np.minimum(zeros + 1, 63).astype(_U)) >> _U(64 - _MANTISSA)).astype(np.int64)
    have = bucket[first]
    out = np.empty(BUCKETS, np.uint16)
    values = (zeros << _MANTISSA | mantissa).astype(np.uint16)
    if len(have) == BUCKETS:
        return values
    out[:] = values[np.argmin(_PRIORITY[:, have], axis=1)]
    out[have] = values
    return out


def _compress(registers: np.ndarray) -> np.ndarray:
    """8-bit registers: 5 bits leading zeros, 3 bits mantissa."""
    zeros = np.minimum(registers >> _MANTISSA, 31)
    return (zeros << _SMALL_MANTISSA | (registers & ((1 << _MANTISSA) - 1)) >> (_MANTISSA - _SMALL_MANTISSA)).astype(np.uint8)


def _accidental(bits: int) -> float:
    """Chance that registers of different minima agree: equal leading zeros, then an equal mantissa."""
    return sum(0.25 ** (k + 1) for k in range(32)) / 2**bits


def estimated_jaccard(equal: np.ndarray, buckets: int = BUCKETS, bits: int = _SMALL_MANTISSA) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for accidental agreement."""
    e = _accidental(bits)
    return (equal / buckets - e) / (1 - e)


def _needed(threshold: tuple[int, int]) -> int:
    """Equal registers that a candidate pair has at least."""
    e = _accidental(_SMALL_MANTISSA)
    return int(np.ceil(((threshold[0] / threshold[1] - SLACK) * (1 - e) + e) * BUCKETS))


_BAND = (_U(0x9E3779B97F4A7C15) * np.arange(1, BUCKETS // ROWS + 1, dtype=_U))


def _bands(registers: np.ndarray) -> np.ndarray:
    r = registers.reshape(-1, ROWS).astype(_U)
    return mix((r[:, 0] | r[:, 1] << _U(16) | r[:, 2] << _U(32) | r[:, 3] << _U(48)) + _BAND)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, class, check, registers, bands): one row a document; class and check, two hashes of the set, are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, key, check, registers, bands = [], [], [], [], []
            for s in _sets(batch.column("text"), width):
                n.append(len(s))
                if not len(s):
                    key.append(None), check.append(None), registers.append(None), bands.append(None)
                    continue
                r = _registers(s)
                one, other = _class(s)
                key.append(one), check.append(other), registers.append(_compress(r).tobytes()), bands.append(signed(_bands(r)))
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class", "check", "registers", "bands"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, class long, check long, registers binary, bands array<long>")


def _class(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set, which don't depend on each other."""
    a, b = np.add.reduce(mix(s + _U(1))), np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D)))
    one, other = signed(mix(np.array([a + _U(len(s)), b ^ _U(len(s))])))
    return int(one), int(other)


def _full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, elements) of the classes `nodes` (node, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(_class(s)[0], s.tobytes()) if len(s) else (0, b"") for s in _sets(batch.column("text"), width)]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["node", "elements"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(nodes.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return source.select("text").mapInArrow(run, "node long, elements binary").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _similar(threshold: tuple[int, int]):
    part, whole = threshold

    def similar(x: bytes, y: bytes) -> bool:
        """Whether sets are similar enough; their registers come first."""
        both = np.concatenate([np.frombuffer(x, _U, offset=BUCKETS), np.frombuffer(y, _U, offset=BUCKETS)])
        n = len(both)
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        return whole * same >= part * (n - same)

    return similar


def _sketches(bodies: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8, BUCKETS) for x in bodies.to_pylist()])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    needed = _needed(threshold)
    signed_docs = written(signatures(docs, id_col, text_col, width))
    filled = signed_docs.where("class is not null and doc_id is not null")
    classes = filled.groupBy("class").agg(F.min(F.struct("check", "doc_id")).alias("least")).select("class", "least.*")  # sets of another check are alone
    nodes = written(classes.join(filled, ["class", "check", "doc_id"]).select(F.col("class").alias("node"), "check", "doc_id", "registers", "bands").dropDuplicates(["node"]))
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("key", "node", (F.col("band") >= FIRST_BANDS).cast("int").alias("round"))

    def bodies(asked: DataFrame) -> DataFrame:
        mine = nodes.join(asked, "node", "left_semi").select("node", "doc_id", "registers")
        sets = _full_sets(docs, mine, id_col, text_col, width)
        return sets.join(mine.select("node", "registers"), "node").select("node", F.concat("registers", "elements").alias("body"))

    def alike(registers: np.ndarray, i: int, other: np.ndarray) -> np.ndarray:
        return (registers[other] == registers[i]).sum(1) >= needed

    found = connect(keys, bodies, _similar(threshold), _sketches, alike, rounds=2, group=GROUP)

    named = nodes.select("node", "check", F.col("doc_id").alias("least")).join(found, "node", "left").select("node", "check", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "component").select(F.col("node").alias("class"), "check", "component_id")
    out = signed_docs.select("doc_id", "n_shingles", "class", "check").join(by_class, ["class", "check"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Documents but for all but one (the smallest id) of each group of near-duplicates. Columns stay as they are.

    Rows that repeat a kept id all stay.
    """
    drop = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
