"""Packing token sequences into windows: best-fit decreasing with a segment tree over remaining capacity.

A document's ids are those of its whole text (null: empty) and an end id. Documents of more than a window are
first cut into full windows; what is left of them, and all shorter documents, are packed longest first, each
into the open window that it fills most tightly, else into a new one. Equal lengths go in the order of their
ids' checksum and the row's number.

Pieces are dealt at random, by row number and not by any column, into groups of about GROUP_PIECES, and each
group is packed by itself: a group has too many pieces for its few open windows to matter, and no task grows
with the table. Sequence ids are unique over all groups, not gapless. Repeated rows are packed as often as they
occur; an empty table gives no pieces. Rows with a null id are packed like others.

Each worker keeps the ids of up to WORD_CACHE words: words are split at ASCII white space, across which the
tokenizer merges nothing, so a word's ids do not depend on its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.llm.tables import written
from spotweave.llm.text import slices, words

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 20_000
WORD_CACHE = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids:
    """The ids of words, kept between the tasks of a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, np.ndarray] = {}
        #: Lower-case ASCII words are one pre-token, which the model takes as it is.
        self.plain = self.whole.model if path.endswith("word_bpe_49k.json") else None

    def of(self, word: str) -> np.ndarray:
        ids = self.known.get(word)
        if ids is None:
            ids = self._encode(word)
            if len(self.known) < WORD_CACHE:
                self.known[word] = ids
        return ids

    def _encode(self, word: str) -> np.ndarray:
        if self.plain is not None and word.isascii():
            low = word.lower()
            if low.isalpha():
                return np.array([t.id for t in self.plain.tokenize(low)], np.uint32)
            stem = low[:-1]
            if word[-1] in ".,!?;:" and stem.isalpha():
                return np.concatenate([self.of(stem), self.of(word[-1])])
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, np.uint32)


_ids: dict[str, _Ids] = {}


def _documents(batch: pa.RecordBatch, path: str) -> Iterator[np.ndarray]:
    """The ids of each text and END_ID."""
    if path not in _ids:
        _ids[path] = _Ids(path)
    w = words(batch.column("text"), lower=False)
    each = [_ids[path].of(x) for x in w.vocabulary.to_pylist()]
    n = np.array([len(x) for x in each], np.int64)
    pool = np.concatenate(each) if each else np.zeros(0, np.uint32)
    start = np.cumsum(n) - n
    for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True):
        codes = w.codes[a:b]
        size = n[codes]
        total = int(size.sum())
        out = np.empty(total + 1, np.uint32)
        out[:total] = pool[np.repeat(start[codes] - (np.cumsum(size) - size), size) + np.arange(total)]
        out[total] = END_ID
        yield out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, ids): full windows and what is left of each document; ids are null unless asked for."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, start, length, crc, tokens, data = [], [], [], [], [], []
            for i, ids in enumerate(_documents(batch, path)):
                for a in range(0, len(ids), WINDOW):
                    piece = ids[a : a + WINDOW].astype("<u4").tobytes()
                    row.append(i), start.append(a), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), tokens.append(len(ids)), data.append(piece if with_ids else None)
            ints = [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
            yield pa.record_batch([batch.column("id").take(pa.array(row, pa.int64())), *ints, pa.array(data, pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


class OpenWindows:
    """Open windows in a segment tree indexed by remaining capacity: node 1 covers all, a node's count is its windows."""

    def __init__(self, window: int = WINDOW):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: dict[int, list[int]] = {}

    def add(self, capacity: int, name: int) -> None:
        self.at.setdefault(capacity, []).append(name)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The capacity and name of a window with the least capacity of at least `least`, which leaves the tree."""
        i = self.size + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity, name = i - self.size, self.at[i - self.size].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, name


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """For each window, the positions of the lengths that it takes; lengths are packed in the order given."""
    tree, windows = OpenWindows(window), []
    for i, n in enumerate(lengths):
        found = tree.take(n) if n < window else None
        if found is None:
            windows.append([i])
            left, name = window - n, len(windows) - 1
        else:
            left, name = found[0] - n, found[1]
            windows[name].append(i)
        if left:
            tree.add(left, name)
    return windows


def _pack_group(rows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(row, window, offset) of rows (length, checksum, number)."""
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][0], rows[i][1], rows[i][2]))
    for name, window in enumerate(best_fit([rows[i][0] for i in order])):
        offset = 0
        for i in window:
            yield order[i], name, offset
            offset += rows[order[i]][0]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece, and its ids if asked."""
    cut = written(pieces(docs, id_col, text_col, tokenizer, with_ids).withColumn("n", F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("n"), F.lit(groups)))

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    names = [*kept[:5], "sequence_id", "offset", *kept[5:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            rows = list(zip(*(t.column(c).to_pylist() for c in ("length", "ids_crc32", "n")), strict=True))
            row, window, offset = zip(*_pack_group(rows), strict=True)
            sequence = np.array(window, np.int64) + (t.column("group")[0].as_py() << 32)
            placed = t.take(pa.array(row)).select(kept).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset, pa.int64()))
            return placed.select(names).combine_chunks().to_batches()[0]

        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column("group")[0].as_py() != group[a]:
                    yield flush()
                    held.clear()
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)
