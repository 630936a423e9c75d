"""Language ID by rank-order n-gram profiles and out-of-place distance (Cavnar and Trenkle).

Letters are Unicode letters in lower case; every run of other characters is one word boundary, and texts
begin and end with one. The n-grams are those of 1 to 3 characters that hold a letter. A language's profile
ranks its `depth` most frequent n-grams over all training texts; a document is ranked the same way over its
whole text. Its distance to a language is the sum of rank differences, `depth` for an n-gram that the
profile lacks; the score is 1 - distance / (depth * n-grams of the document).

Null texts and texts without letters get `und` and score 0. Equal counts rank by n-gram code, equal distances
by language name. Rows without a language teach nothing but are predicted. Without any training row, every
text gets `und`. Repeated rows count as often as they occur. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spotweave.llm.text import plain, slices

#: n-grams that a profile ranks.
DEPTH = 400
UNKNOWN = "und"
#: Languages whose profiles go to every task.
MOST_LANGUAGES = 5_000
#: Texts scoring less are rejected as being in none of the languages.
LEAST_SCORE = 0.1
_FLUSH = 1 << 22
_BITS = 21


def _letter_table() -> np.ndarray:
    """Code point of the lower-case letter for each code point below 0x3000; 0 for what is not a letter."""
    out = np.zeros(0x3000, np.int64)
    for i in range(len(out)):
        c = chr(i).lower()
        if chr(i).isalpha():
            out[i] = ord(c[0])
    return out


_LETTERS: list[np.ndarray] = []


def _grams(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams of text."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    far = points >= 0x3000
    x = _LETTERS[0][np.where(far, 0, points)]
    if far.any():  # scripts beyond the table
        for p in np.unique(points[far]):
            if chr(p).isalpha():
                x[points == p] = ord(chr(p).lower()[0])
    x = np.concatenate([[0], x, [0]])
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
    if len(x) < 3:
        return x[:0]
    two = (x[:-1] << _BITS) | x[1:]
    three = (two[:-1] << _BITS) | x[2:]
    # The last two bits of a code tell the gram's length.
    return np.concatenate([x[x != 0] * 4 + 1, two * 4 + 2, three * 4 + 3])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of some documents at a time."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in slices(batches, "text"):
        for text, lang in zip(plain(batch.column("text")).to_pylist(), batch.column("lang").to_pylist(), strict=True):
            g = _grams(text)
            held.setdefault(lang, []).append(g)
            size += len(g)
            if size > _FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH) -> DataFrame:
    """(lang, gram, place): each language's most frequent n-grams, place from 0.

    One scan; tasks send partial counts, which are summed by (lang, gram). Only `depth` rows for each
    language are left, so the result has a bound by the number of languages.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < depth).select("lang", "gram", "place")


def _predictor(profiles: list[tuple[str, int, int]], depth: int):
    langs = sorted({p[0] for p in profiles})
    grams = np.unique(np.array([p[1] for p in profiles], np.int64))
    table = np.full((len(grams) + 1, len(langs)), -1, np.int32)
    for lang, gram, place in profiles:
        table[np.searchsorted(grams, gram), langs.index(lang)] = place

    def predict(text: str) -> tuple[str, float]:
        g = _grams(text)
        if not len(g) or not langs:
            return UNKNOWN, 0.0
        g.sort()
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        n = np.diff(np.concatenate([first, [len(g)]]))
        top = np.argsort(-n, kind="stable")[:depth]
        own = g[first[top]]
        at = np.searchsorted(grams, own)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != own)] = len(grams)
        places = table[at]
        out = np.where(places < 0, depth, np.abs(places - np.arange(len(own), dtype=np.int32)[:, None])).sum(0)
        best = int(np.argmin(out))
        return langs[best], float(1 - out[best] / (depth * len(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [predict(t) for t in plain(batch.column("text")).to_pylist()]
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*rest, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    return run


def _collected(profiles: DataFrame) -> list[tuple[str, int, int]]:
    """The profiles' rows: DEPTH a language at most, for no more than MOST_LANGUAGES."""
    found = profiles.limit(DEPTH * MOST_LANGUAGES + 1).collect()
    if len(found) > DEPTH * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return [(r.lang, r.gram, r.place) for r in found]


def predict_language(docs: DataFrame, profiles: DataFrame, keep: list[str], text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """The columns `keep`, lang_pred and score of each document, in one scan without a shuffle.

    `profiles` goes to every task: `depth` rows a language.
    """
    rows = _collected(profiles)
    source = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    kinds = [T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*kinds, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = source.mapInArrow(_predictor(rows, depth), schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; profiles from those not held out."""
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))), depth=depth)
    out = predict_language(docs, profiles, ["doc_id"], depth=depth)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents with a recognised language; what is `und` or scores less than `least` goes. Columns stay as they are."""
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    rows = _collected(profiles)

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _predictor(rows, DEPTH)
        for batch in slices(batches, "text"):
            alone = pa.record_batch([batch.column("text")], names=["text"])  # other columns may have any name
            scored = [x for found in run(iter([alone])) for x in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist(), strict=True)]
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in scored], pa.bool_()))

    return docs.mapInArrow(with_text, docs.schema)
