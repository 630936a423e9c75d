"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text's tokens are its words (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case) and one end. As in the base score, all words
that training lacks are one symbol, so both are probabilities of the same events and can be compared. The model
codes a token in bits: the SYMBOLS most frequent training words, the end and an escape have a Huffman code. An
escaped word is told by its discounted training count, and what discounting takes is the unknown word's.

Each bit is predicted in several contexts at once: its code node alone, with the last common word, with the last two,
and with the word before. A context's predictor is a hashed slot with counts of zeros and ones over all
training texts, summed by tasks and then by a tree of shuffles. A logistic mixer, with weights gated by the place in
the code, combines the predictors; a refinement map corrects its output. Both start from all training texts: each task that counts
them first predicts every run of them from what it has counted before and learns from that, and the tasks' weights are averaged by
their bits. In scoring, each text's mixer goes on learning after every STEP of its bits.

Passages: texts are cut behind every token at which a hash of the last three tokens says so (one of ANCHOR). One more bit
asks whether the tokens up to the next cut are the passage that most training texts have there. It is predicted
from the counts of the passage and of its rivals, from how often the text has agreed so far and from its last
answer, mixed with weights that learn from each answer and are gated by the count; if it is a yes, the passage's other bits are free. These
counts are a table keyed by context that grows with the corpus and is joined, not broadcast. A training text's own
passages don't count for itself, so texts that occur twice stand out from those that occur once.

The base score is that of add-half unigrams with exact counts: frequent words (at most FREQUENT of them, a bounded
table) are looked up in tasks, all others by a join on the word's 64-bit hash.

Null texts are empty: one token. Repeated rows are scored and learnt from each. With no training text, all
counts are 0 and all predictions even; base_score is then log10(0.5 / 0.5) a token. Only the named columns are
read. Ids may be null; such texts are trained on.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.tables import written
from spotweave.llm.text import hashes, mix, signed, slices, words

#: Words with a code of their own.
SYMBOLS = 16_382
#: Words whose counts every task has at hand.
FREQUENT = 262_144
#: Slots of a context's table: 2 ** SLOT_BITS.
SLOT_BITS = 20
#: Words that a counting task predicts at first before it has counted them; twice as many each time, up to _WORDS_AT_ONCE.
FIRST_WORDS = 1024
#: Commonest words, and previous words, that make contexts of their own.
COMMON, LAST = 64, 4096
GATES = 16
BINS = 33
#: Bits of a text between two lessons of its mixer, and how fast it learns.
STEP, RATE = 128, 0.02
#: Bits between two lessons while counting.
LESSON = 2048
#: Passages end at one in so many tokens on average.
ANCHOR = 16
#: Partial tables that one task adds up.
FAN = 64

_U = np.uint64
_SLOTS = 1 << SLOT_BITS
_CHUNK = 1 << 15
_WORDS_AT_ONCE = 50_000
#: Contexts of words.
TABLES = 4
#: The chunk of a mixer's sums.
FITTED = -1


class Code(NamedTuple):
    """Huffman codes: symbol s has the (node, bit) pairs from start[s] on, size[s] of them."""

    start: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(weights: list[int]) -> Code:
    number = count()
    heap = [(w, next(number), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    node = len(weights)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, next(number), node))
        node += 1
    paths = []
    for s in range(len(weights)):
        path, at = [], s
        while at in parent:
            at, bit = parent[at]
            path.append((node - 1 - at, bit))
        paths.append(path[::-1])
    size = np.array([len(p) for p in paths], np.int64)
    flat = [x for p in paths for x in p]
    return Code(np.cumsum(size) - size, size, np.array([x[0] for x in flat], np.int32), np.array([x[1] for x in flat], np.uint8))


def _bits(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each bit of the symbols: the symbol's place, the bit's place in its code, code node and value."""
    size = code.size[symbols]
    owner = np.repeat(np.arange(len(symbols), dtype=np.int32), size)
    depth = (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    at = code.start[symbols][owner] + depth
    return owner, depth, code.node[at], code.bit[at]


class Vocabulary(NamedTuple):
    """Frequent words' hashes in order, with counts and symbols (-1: none), and the code of symbols."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    code: Code
    end: int
    escape: int


def _slot(context: np.ndarray, owner: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slots of contexts (64-bit hashes of the owners) at code nodes."""
    x = (context[owner] + node.astype(_U)) * _U(0x9E3779B97F4A7C15)
    return (x >> _U(64 - SLOT_BITS)).astype(np.int32)


def _spread(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x.astype(_U) + _U(seed << 40)) << _U(16)


def _word_slots(symbols: np.ndarray, first: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, depth, bit and slots [TABLES, bits] of tokens; `first` marks a text's first token."""
    before = np.concatenate([[0], symbols[:-1]]).astype(np.int64)
    before = np.where(before < LAST, before + 1, 0)
    before[first] = 0
    common = np.where((symbols < COMMON), np.arange(1, len(symbols) + 1), 0)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(symbols)), 0))
    seen = np.concatenate([[0], np.maximum.accumulate(common)[:-1]])  # place + 1 of the last common word before
    one = np.where(seen > begin, symbols[np.maximum(seen - 1, 0)] + 1, 0)
    at = np.where(seen > begin, seen - 1, 0)
    two = np.where((seen > begin) & (seen[at] > begin), symbols[np.maximum(seen[at] - 1, 0)] + 1, 0)
    owner, depth, node, bit = _bits(v.code, symbols)
    slots = np.stack([node, _slot(_spread(one, 1), owner, node), _slot(_spread(one * (COMMON + 1) + two, 2), owner, node), _slot(_spread(before, 3), owner, node)])
    return owner, depth, bit, slots


def _symbols(h: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (escape: none of its own) and counts (-1: not among the frequent words) of word hashes."""
    if not len(v.hashes):
        return np.full(len(h), v.escape, np.int64), np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
    known = v.hashes[at] == h
    symbol = np.where(known, v.symbols[at], -1)
    return np.where(symbol < 0, v.escape, symbol).astype(np.int64), np.where(known, v.counts[at], -1)


class _Texts(NamedTuple):
    hashed: np.ndarray  # of the slice's vocabulary
    symbol: np.ndarray
    known: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray


def _texts(batch: pa.RecordBatch, v: Vocabulary) -> _Texts:
    w = words(batch.column("text"))
    h = hashes(w.vocabulary)
    symbol, known = _symbols(h, v)
    return _Texts(h, symbol, known, w.codes, w.offsets)


def _parts(offsets: np.ndarray, most: Iterator[int] | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts with some words at a time, as many as `most` says."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + (next(most) if most else _WORDS_AT_ONCE), "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def _tokens(t: _Texts, a: int, b: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts a to b with their ends, each token's text, and which tokens are first."""
    n = np.diff(t.offsets[a : b + 1]) + 1
    text = np.repeat(np.arange(b - a, dtype=np.int32), n)
    last = np.cumsum(n) - 1
    out = np.full(int(n.sum()), end, np.int64)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = t.symbol[t.codes[t.offsets[a] : t.offsets[b]]]
    first = np.zeros(len(out), bool)
    first[last - n + 1] = True
    return out, text, first


def _add(into: np.ndarray, slots: np.ndarray, bit: np.ndarray) -> None:
    for k in range(len(slots)):
        into[k] += np.bincount(slots[k] * 2 + bit, minlength=2 * _SLOTS).astype(np.uint32)


def _packed(chunk: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([part], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)])], names=["chunk", "part", "data"])


def _kind(chunk: int) -> type:
    return np.float64 if chunk == FITTED else np.uint64


def _learner(v: Vocabulary):
    """Counts of zeros and ones in each slot over a task's training texts, in chunks of a table, and what its mixer learnt as chunk FITTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fit = np.zeros((TABLES, 2 * _SLOTS), np.uint32), Fit()
        most = (min(FIRST_WORDS << min(i, 20), _WORDS_AT_ONCE) for i in count())
        for batch in slices(batches, "text"):
            t = _texts(batch, v)
            for a, b in _parts(t.offsets, most):
                symbols, _, first = _tokens(t, a, b, v.end)
                _, depth, bit, slots = _word_slots(symbols, first, v)
                if fit.bits.any() or table[0].any():
                    fit.learn(np.stack([_stretched_now(table[i], slots[i]) for i in range(TABLES)]), np.minimum(depth, GATES - 1), bit)
                _add(table, slots, bit)
        flat, part = table.reshape(-1, 2 * _CHUNK), TaskContext.get().partitionId()
        for at in np.flatnonzero(flat.any(1)):
            yield _packed(int(at), part // FAN, flat[at].astype(np.uint64))
        if fit.bits.any():
            yield _packed(FITTED, part // FAN, fit.sums())

    return run


def _sum_chunks(key: tuple, chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, total = key[0].as_py(), 0
    for b in chunks:
        for data in b.column("data"):
            total = total + np.frombuffer(zlib.decompress(data.as_py()), _kind(chunk))
    yield _packed(chunk, key[1].as_py() // FAN, total)


def _stretched(total: np.ndarray) -> np.ndarray:
    """Stretched probabilities; an empty slot has 0, and a slot's trust grows with its counts."""
    n = total.astype(np.float64).reshape(-1, 2)
    return np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)).astype(np.float32)


def _stretched_now(counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """`_stretched` of some slots of a table that is still being counted."""
    n = counts.view(_U)[slots].view(np.uint32).astype(np.float32) + np.float32(0.4)  # both counts of a slot at once
    return np.log(n[1::2] / n[::2])


class Mixer(NamedTuple):
    """Weights [gates, inputs] and refinement map [gates, BINS] of one stream of bits."""

    weights: np.ndarray
    refined: np.ndarray


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -40, 40)))


def _binned(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 2), -(BINS // 2), BINS // 2).astype(np.int32) + BINS // 2


class Fit:
    """Weights and refinement learnt online; sums of several fits make one mixer."""

    def __init__(self) -> None:
        self.weights, self.energy = np.full((GATES, TABLES), 1.0 / TABLES), np.full((GATES, TABLES), 1e-6)
        self.hit, self.seen = np.zeros(GATES * BINS), np.zeros(GATES * BINS)

    @property
    def bits(self) -> np.ndarray:
        return self.seen.reshape(GATES, BINS).sum(1)

    def learn(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        """Each step predicts some bits, then learns from them."""
        cells = np.empty(len(bit), np.int64)
        for a in range(0, len(bit), LESSON):
            x, g, y = inputs[:, a : a + LESSON], gate[a : a + LESSON], bit[a : a + LESSON]
            w = self.weights.astype(np.float32)
            s = sum(w[:, i][g] * x[i] for i in range(TABLES))
            error = y - _squash(s)
            cells[a : a + LESSON] = g * BINS + _binned(s)
            slope = np.stack([np.bincount(g, weights=error * x[i], minlength=GATES) for i in range(TABLES)], 1)
            self.energy += slope**2
            self.weights += 0.1 * slope / np.sqrt(self.energy)
        self.hit += np.bincount(cells, weights=bit, minlength=GATES * BINS)
        self.seen += np.bincount(cells, minlength=GATES * BINS)

    def sums(self) -> np.ndarray:
        return np.concatenate([(self.weights * self.bits[:, None]).ravel(), self.hit, self.seen])


def fitted_mixer(sums: np.ndarray | None) -> Mixer:
    """The mixer of fits' summed `sums`: weights averaged by bits; gates that no fit has seen are even."""
    sums = np.zeros(GATES * (TABLES + 2 * BINS)) if sums is None else sums
    weights, hit, seen = (x.reshape(GATES, -1) for x in np.split(sums, [GATES * TABLES, GATES * (TABLES + BINS)]))
    n = seen.sum(1, keepdims=True)
    middle = _squash((np.arange(BINS) - BINS // 2) / 2)
    return Mixer(np.where(n > 0, weights / np.maximum(n, 1), 1 / TABLES).astype(np.float32), ((hit + 16 * middle) / (seen + 16)).astype(np.float32))


def _log10(p: np.ndarray, bit: np.ndarray) -> np.ndarray:
    p = np.where(bit, p, 1 - p)
    return np.log(np.maximum(p, np.float32(1e-6)) * np.float32(1 - 2e-6)) * np.float32(0.4342944819)


def _mixed(s: np.ndarray, gate: np.ndarray, m: Mixer) -> np.ndarray:
    return np.float32(0.5) * (_squash(s) + m.refined.ravel()[gate * BINS + _binned(s)])


def _bit_scores(symbols: np.ndarray, text: np.ndarray, first: np.ndarray, n_texts: int, v: Vocabulary, tables: np.ndarray, m: Mixer) -> np.ndarray:
    """log10 probability of each token's bits. A text's own weights learn after every STEP of its bits, from the errors in them."""
    owner, depth, bit, slots = _word_slots(symbols, first, v)
    gate = np.minimum(depth, GATES - 1)
    n = np.bincount(text[owner], minlength=n_texts)
    step = (np.arange(len(bit)) - np.repeat(np.cumsum(n) - n, n)) // STEP
    order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")  # the texts' first lessons, their second ones, ...
    cuts = np.searchsorted(step[order], np.arange(-(-int(n.max(initial=0)) // STEP) + 1))
    owner, gate, y = owner[order], gate[order], bit[order]
    of = text[owner]
    x = np.stack([tables[i][slots[i][order]] for i in range(TABLES)])
    s = np.zeros(len(y), np.float32)
    for i in range(TABLES):
        s += m.weights[:, i][gate] * x[i]
    chance = np.empty(len(y), np.float32)
    own = np.zeros((TABLES, n_texts), np.float32)
    for a, b in itertools.pairwise(cuts.tolist()):
        d, xs = of[a:b], x[:, a:b]
        start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        z = s[a:b] if a == 0 else s[a:b] + (np.repeat(own[:, d[start]], np.diff(np.append(start, b - a)), axis=1) * xs).sum(0)
        p = _mixed(z, gate[a:b], m)
        chance[a:b] = p
        if b < len(y):
            own[:, d[start]] += np.float32(RATE) * np.add.reduceat((y[a:b] - p) * xs, start, axis=1)
    return np.bincount(owner, weights=_log10(chance, y), minlength=len(symbols))


def cut_points(hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a passage begins at each token, and a hash of the three tokens before (0 for a text's first passage)."""
    place = np.arange(len(hashed)) - np.maximum.accumulate(np.where(first, np.arange(len(hashed)), 0))
    three = np.zeros(len(hashed), _U)
    for k in (3, 2, 1):
        three[k:] = mix(three[k:] * _U(0x9E3779B97F4A7C15) + hashed[:-k]) if len(hashed) > k else three[k:]
    return first | ((place >= 3) & (three % _U(ANCHOR) == 0)), np.where(place >= 3, three, _U(0))


class Rare(NamedTuple):
    """Training words without a symbol: their discounted counts predict an escaped word; what is taken is the unknown word's."""

    total: float
    discount: float
    unknown: float


def rare_words(total: int, distinct: int, once: int, twice: int) -> Rare:
    if not total:
        return Rare(1.0, 0.0, 1.0)
    discount = once / (once + 2 * twice) if once else 0.5
    discount = min(max(discount, 0.1), 0.9)
    return Rare(float(total), discount, discount * distinct / total)


_PASSAGE = pa.struct([("anchor", pa.int64()), ("passage", pa.int64()), ("bits", pa.float64())])
_RARE = pa.struct([("at", pa.int32()), ("word", pa.int64()), ("n", pa.int32())])


def _lists(where: np.ndarray, n: int, columns: list[pa.Array], kind: pa.StructType) -> pa.ListArray:
    """A list for each of n texts of the rows whose text is `where`, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


def _scorer(v: Vocabulary, total: int, distinct: int, law: Rare, shared):
    """Rows of scores; words that are not at hand are left with the place of their passage and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, mixer, ends = shared.value
        below = np.log10(total + 0.5 * (distinct + 1))
        for batch in slices(batches, "text"):
            # Shortest first: texts that are scored together take as many steps as the longest of them.
            batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column("text")), 0)))
            t = _texts(batch, v)
            size = np.diff(t.offsets)
            base = np.where(t.known >= 0, np.log10(np.maximum(t.known, 0) + 0.5) - below, 0.0)
            told = (t.symbol == v.escape) & (t.known >= 0)
            escaped = np.where(told, np.log10(np.maximum(t.known - law.discount, 1e-9) / law.total), 0.0)
            for a, b in _parts(t.offsets):
                symbols, of, first = _tokens(t, a, b, v.end)
                n = b - a
                inner = symbols != v.end
                codes = t.codes[t.offsets[a] : t.offsets[b]]
                bits = _bit_scores(symbols, of, first, n, v, tables, mixer)
                bits[inner] += escaped[codes]
                h = np.full(len(symbols), _U(0xE7D))
                h[inner] = t.hashed[codes]
                begins, three = cut_points(h, first)
                start = np.flatnonzero(begins)
                content = np.add.reduceat(mix(h + (np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))).astype(_U) * _U(0x9E3779B97F4A7C15)), start)
                cost = np.add.reduceat(bits, start)
                passages = _lists(of[start], n, [pa.array(signed(three[start])), pa.array(signed(mix(content))), pa.array(cost)], _PASSAGE)
                number = (np.cumsum(begins) - 1)[inner]
                sure = t.known[codes] >= 0
                passage_of, word = number[~sure], codes[~sure]
                left, count = np.unique(passage_of * len(t.hashed) + word, return_counts=True) if len(word) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                passage_of, word = left // max(1, len(t.hashed)), left % max(1, len(t.hashed))
                text_of = of[start][passage_of]
                before = np.searchsorted(of[start], text_of)
                rare = _lists(text_of, n, [pa.array((passage_of - before).astype(np.int32)), pa.array(signed(t.hashed)[word]), pa.array(count.astype(np.int32))], _RARE)
                text = of[inner]
                base_score = np.bincount(text, weights=base[codes], minlength=n) + np.log10(ends + 0.5) - below
                n_known = np.bincount(text[sure], minlength=n) + (ends > 0)
                score = np.bincount(of, weights=bits, minlength=n)
                chars = pc.fill_null(pc.binary_length(batch.column("text").slice(a, n)), 0).cast(pa.int64())
                yield pa.record_batch(
                    [batch.column("id").slice(a, n), chars, pa.array(size[a:b] + 1), pa.array(n_known, pa.int64()), pa.array(base_score), pa.array(score), passages, rare],
                    names=["doc_id", "n_bytes", "n_tokens", "n_known", "base_score", "score", "passages", "rare"],
                )

    return run


def answer_passages(rows: list[dict]) -> float:
    """What one text gains by its passage bits, in log10; rows have at, bits, yes, same and all (counts but for its own), in order."""
    gain, yeses, noes, last = 0.0, 0.0, 0.0, 0.0
    weights = {k: [0.6, 0.5, 0.5, 0.0] for k in (1, 2, 3)}
    for r in rows:
        x = [math.log((r["same"] + 0.4) / (r["all"] - r["same"] + 0.4)), math.log((yeses + 0.4) / (noes + 0.4)), last, 1.0]
        w = weights[min(r["same"], 3)]
        p = 1 / (1 + math.exp(-max(-12.0, min(12.0, sum(a * b for a, b in zip(w, x, strict=True))))))
        gain += math.log10(p) - r["bits"] if r["yes"] else math.log10(1 - p)
        error = r["yes"] - p
        for i in range(4):
            w[i] += 0.05 * error * x[i]
        yeses, noes, last = yeses + r["yes"], noes + (not r["yes"]), 1.0 if r["yes"] else -1.0
    return gain


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gains = [answer_passages(sorted(rows, key=lambda r: r["at"])) for rows in batch.column("asked").to_pylist()]
        yield pa.record_batch([batch.column("row"), pa.array(gains, pa.float64())], names=["row", "gain"])


def held_out(doc_id: Column) -> Column:
    """Whether a text is kept from training: crc32 of its id as text leaves 1 when divided by 5; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of some megabytes of texts at a time."""
    for batch in slices(batches, "text", 4 * (8 << 20)):
        w = words(batch.column("text"))
        n = np.bincount(w.codes, minlength=len(w.vocabulary))
        yield pa.record_batch([pa.array(signed(hashes(w.vocabulary))), pa.array(n.astype(np.int64))], names=["word", "n"])


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, most frequent first: all words above a count that at most FREQUENT words reach."""
    reach = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    histogram = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(FREQUENT)  # rows with as many different counts
    least = histogram.withColumn("upto", F.sum("n").over(reach)).where(F.col("upto") <= FREQUENT).agg(F.min("c").alias("c")).first().c
    rows = counts.where(F.col("c") >= least).select("word", "c").collect() if least is not None else []
    rows.sort(key=lambda r: (-r.c, r.word))
    return np.array([r.word for r in rows], np.int64).view(_U), np.array([r.c for r in rows], np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every text."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    train = source.where(~held_out(F.col("id")))
    counts = written(train.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")))
    ends = train.count()
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    total, distinct = (whole.n or 0) + ends, (whole.v or 0) + (ends > 0)

    h, c = _frequent(counts)
    symbol = np.where(np.arange(len(h)) < SYMBOLS, np.arange(len(h)), -1)
    n_symbols = min(SYMBOLS, len(h))
    own = c[:n_symbols]
    law = rare_words((whole.n or 0) - int(own.sum()), whole.v - n_symbols, whole.once - int((own == 1).sum()), whole.twice - int((own == 2).sum()))
    order = np.argsort(h)
    v = Vocabulary(h[order], c[order], symbol[order], huffman([*own.tolist(), max(1, ends), max(1, total - ends - int(own.sum()))]), n_symbols, n_symbols + 1)

    kind = "chunk long, part long, data binary"
    chunks, parts = train.select("text").mapInArrow(_learner(v), kind), max(1, train.rdd.getNumPartitions())
    while True:  # each round adds up FAN partial tables
        parts = -(-parts // FAN)
        chunks = chunks.groupBy("chunk", "part").applyInArrow(_sum_chunks, kind)
        if parts == 1:
            break
    tables = np.zeros((TABLES, _SLOTS), np.float32)
    sums: dict[int, np.ndarray] = {}
    for r in chunks.toLocalIterator():  # the model: a fixed number of slots, once unless the number of partitions was wrong
        sums[r.chunk] = sums.get(r.chunk, 0) + np.frombuffer(zlib.decompress(r.data), _kind(r.chunk))
    mixer = fitted_mixer(sums.pop(FITTED, None))
    flat = tables.reshape(-1, _CHUNK)
    for at, total_counts in sums.items():
        flat[at] = _stretched(total_counts)

    shared = spark.sparkContext.broadcast((tables, mixer, ends))
    schema = "doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double, passages array<struct<anchor:long,passage:long,bits:double>>, rare array<struct<at:int,word:long,n:int>>"
    rows = source.mapInArrow(_scorer(v, total, distinct, law, shared), schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("held_out", held_out(F.col("doc_id"))))

    below = F.lit(total + 0.5 * (distinct + 1))
    c = F.coalesce("c", F.lit(0))
    likely = F.when(c > 0, (c - law.discount) / law.total).otherwise(F.lit(max(law.unknown, 1e-12)))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts, "word", "left")
    rare = written(rare.groupBy("row", "at").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10((c + 0.5) / below)).alias("base"), F.sum(F.col("n") * F.log10(likely)).alias("more")))
    found = rare.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("more").alias("more"))

    passages = rows.select("row", "held_out", F.posexplode("passages").alias("at", "p")).select("row", "held_out", "at", "p.*").where("anchor != 0")
    told = passages.where("not held_out").select("row", "anchor", "passage").distinct().groupBy("anchor", "passage").agg(F.count("*").alias("same"))
    best = told.groupBy("anchor").agg(F.max(F.struct("same", "passage")).alias("best"), F.sum("same").alias("all")).select("anchor", F.col("best.passage").alias("told"), F.col("best.same").alias("same"), "all")
    yes = F.col("passage") == F.col("told")
    asked = passages.join(best, "anchor").withColumn("yes", yes.cast("int"))
    asked = asked.withColumn("all", F.col("all") - (~F.col("held_out")).cast("int")).withColumn("same", F.col("same") - (yes & ~F.col("held_out")).cast("int")).where("same > 0")
    asked = asked.withColumn("all", F.greatest("all", "same")).join(rare.select("row", "at", "more"), ["row", "at"], "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0)))
    lists = asked.groupBy("row").agg(F.collect_list(F.struct("at", "bits", "yes", "same", "all")).alias("asked"))  # of one text each
    gains = lists.mapInArrow(_gains, "row long, gain double")

    out = rows.drop("rare", "passages").join(found, "row", "left").join(gains, "row", "left")
    value = F.col("score") + F.coalesce("more", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), value.alias("score"),
        (-value * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
