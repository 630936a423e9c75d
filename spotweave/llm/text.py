"""Word arrays of Arrow text columns, and the stable 64-bit hashes that the operators share.

A word is a run of `[^\\x20\\x09-\\x0D]`, the characters that ASCII calls space being the separators.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are turned into arrays at once; a longer text is handled alone, whole.
SLICE_BYTES = 8 << 20

_U = np.uint64


class Words(NamedTuple):
    """codes[offsets[i]:offsets[i + 1]] are the words of text i, as positions in vocabulary."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array


def plain(column: pa.Array) -> pa.Array:
    """The column as strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text in `column`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size + 64) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.take(pa.array(np.arange(a, b)))  # a copy: some Arrow kernels misread string slices


def words(texts: pa.Array, lower: bool = True) -> Words:
    """The words of every text, A-Z in lower case if `lower`."""
    texts = plain(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat, offsets = lists.flatten(), offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary)


def hashes(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, the same on every machine."""
    of = xxhash.xxh3_64_intdigest
    return np.fromiter((of(w, seed) for w in vocabulary.to_pylist()), _U, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation with good low and high bits (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes; with fewer words, of the whole sequence."""
    n = len(hashed)
    if not n:
        return hashed
    width = min(width, n)
    total = np.zeros(n - width + 1, _U)
    for k in range(width):
        total = mix(total + hashed[k : n - width + 1 + k])
    return total


def free_name(taken: list[str], name: str) -> str:
    """`name`, with as many underscores as keep it apart from the columns taken, in any case of letters."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name
