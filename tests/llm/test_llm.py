"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spotweave.llm import chat_quotes, fingerprints, graph, langid, line_dedup, linking, lm_scoring, mixing, neardup, packing, sharding, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, b long, node long, key string, id string"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.integers(0, 500, n))


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), f"s{i % 3}" if i is None or i % 5 else None, len(t or ""), 1, 2, 3, "k", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [(1, base), (2, near), (3, base), (4, words(2, 80)), (5, None), (6, ""), (7, "One two"), (8, "one  TWO"), (9, "x " * 30_000), (10, words(3, 6)), (10, words(3, 6)), (None, base), (12, words(4, 3000))]
    rows = [(i, t, "en", None if i == 4 else "s", len(t or ""), 1, 2, 3, "k", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, docs):
    names = tuple(f"n{i}" for i in range(7))
    own = sharding.lookup_table(names, 1009)
    counts = Counter(own)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(own, fewer, strict=True) if a != 6) < 0.25 * 1009
    whole = sharding.lookup_table()
    for r in sharding.assign(docs, "doc_id").collect():
        h = xxhash.xxh64_intdigest("" if r.doc_id is None else str(r.doc_id), seed=42)
        h = h - (1 << 64) if h >> 63 else h
        assert r.slot == h % sharding.TABLE_SIZE and r.shard == whole[r.slot]
    assert sharding.assign(docs.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(("a", "a"))


@pytest.mark.parametrize("scale", [0.2, 4e6])
def test_topk(spark, scale):
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(300, 5)) * scale).round(3)
    v[10] = v[11] = v[12]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (920, [math.nan] * 5), (940, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7).collect()]
    x = np.floor(64 * v).astype(np.int64).astype(object)
    want = []
    for q in range(0, 300, 20):
        s = sorted(((-int((x[q] * x[i]).sum()), i) for i in range(300) if i != q))[:7]
        want += [(q, k + 1, i, -m) for k, (m, i) in enumerate(s)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_line_dedup(spark):
    line = "The quick brown fox number 17 jumps over the lazy dog near the old river bank every single morning before breakfast, " + words(9, 60)
    d = table(spark, [(3, f"own line with enough letters here\n{line}\n\nshort"), (1, f"{line.upper()}!!\nshort"), (2, None), (4, ""), (5, line.replace("17", "99")), (6, "another line of text that nobody repeats at all")])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(d).collect()}
    assert got[1][2] == 0 and got[3] == ("own line with enough letters here\n", 4, 2)  # repeats go whatever their length, blank lines stay
    assert got[1][2] == 0 and got[5] == ("", 1, 1) and got[2] == (None, 0, 0) and got[4] == ("", 1, 0) and got[6][2] == 0
    kept = line_dedup.drop_repeated_lines(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6}
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_finds_edited_lines(spark):
    """Of lines with a changed letter, or with a changed word of at most a tenth of the letters, few are missed at any length."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, kind = [], {}
    for n, edit in itertools.product((8, 20, 50), ("letter", "word")):
        for _ in range(60):
            line = [word(rng.randint(4, 8)) for _ in range(n)]
            copy, k = list(line), rng.randrange(n)
            line[k] = copy[k] = word(4)
            copy[k] = copy[k][:2] + "é" + copy[k][3:] if edit == "letter" else word(4)
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(copy))]
            kind[len(rows) - 1] = n, edit
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} <= set(kind)
    found = Counter(kind[r.doc_id] for r in got if r.n_removed)
    assert all(found[x] >= (48 if x == (8, "word") else 57) for x in set(kind.values())), found


def test_simhash_counts_bits():
    h = np.array([0b01, 0b01, 0b11, 0b10], np.uint64)
    assert line_dedup.simhashes(h, np.array([0, 3, 4])).tolist() == [0b01, 0b10]
    rng = np.random.default_rng(3)
    n = [1, 254, 255, 256, 700, 2]
    h, at = rng.integers(0, 1 << 63, sum(n)).astype(np.uint64), np.cumsum([0, *n])
    plainly = [sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h[a:b]) > b - a) for a, b in itertools.pairwise(at)]
    assert line_dedup.simhashes(h, at).tolist() == plainly


def _edited(rng, line, most):
    """line with words replaced while at most `most` edits are made."""
    for _ in range(50):
        w = line.split(" ")
        w[rng.randrange(len(w))] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
        if _levenshtein(line, " ".join(w)) <= most:
            return " ".join(w)
    k = rng.randrange(len(line))
    return line[:k] + "z" + line[k + 1 :]


@pytest.mark.parametrize(("low", "high"), [(12, 20), (20, 60), (60, 120), (120, 300), (300, 900)])
def test_line_blocks_find_edited_lines(low, high):
    """Of real-looking lines and copies with up to a tenth edited, over nine tenths share a block, in every class of lengths."""
    rng = random.Random(low)
    common = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    lines = []
    while len(lines) < 150:
        line, size = rng.choice(common), rng.randint(low, high - 1)
        while len(line) < size:
            line += " " + common[min(int(rng.paretovariate(0.6)), 400) - 1]
        lines.append(line[:size].strip().ljust(low, "x"))
    copies = [_edited(rng, x, len(x) // 10) for x in lines]
    found = [set(), set()]
    for k, forms in enumerate((lines, copies)):
        key, of = line_dedup.blocks(pa.array(forms))
        found[k] = [set(key[of == i].tolist()) for i in range(len(forms))]
    assert np.mean([bool(x & y) for x, y in zip(*found, strict=True)]) >= 0.9
    same = line_dedup.profiles(pa.array([*lines, *copies]))
    assert all(line_dedup.may_be_similar(same, i, np.array([i + len(lines)]))[0] for i in range(len(lines)) if line_dedup.edit_similar(lines[i], copies[i]))


@pytest.mark.parametrize(("low", "high"), [(30, 60), (60, 120), (120, 300), (300, 900), (900, 5000)])
def test_line_blocks_find_lines_edited_all_over(low, high):
    """The same for copies with words replaced all over the line, as many as a tenth of the characters allow."""
    rng = random.Random(high)
    common = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    lines, copies = [], []
    while len(lines) < 120:
        line, size = rng.choice(common), rng.randint(low, high - 1)
        while len(line) < size:
            line += " " + common[min(int(rng.paretovariate(0.6)), 400) - 1]
        w, left = line[:size].strip().split(" "), size // 10
        for i in rng.sample(range(len(w)), len(w)):
            new = rng.choice(common)
            if max(len(new), len(w[i])) <= left and new != w[i]:
                left -= max(len(new), len(w[i]))
                w[i] = new
        if " ".join(w) != line[:size].strip() and line_dedup.edit_similar(line[:size].strip(), " ".join(w)):
            lines.append(line[:size].strip())
            copies.append(" ".join(w))
    found = [set(), set()]
    for k, forms in enumerate((lines, copies)):
        key, of = line_dedup.blocks(pa.array(forms))
        found[k] = [set(key[of == i].tolist()) for i in range(len(forms))]
    assert np.mean([bool(x & y) for x, y in zip(*found, strict=True)]) >= 0.93


def test_lines_with_one_half_of_their_hashes_equal_are_not_one(spark):
    rows = [(1, 0, 7, 5, "one form of this", []), (2, 0, 7, 4, "quite another form", []), (3, 0, 7, 5, "one form of this", []), (4, 0, 7, 4, "quite another form", []), (5, 0, 8, 4, "third", [])]
    got = line_dedup.repeated(spark.createDataFrame(rows, "doc_id long, line long, node long, check long, form string, keys array<long>"))
    assert [(r.doc_id, r.line) for r in got.collect()] == [(4, 0)]


def test_sets_with_one_half_of_their_hashes_equal_are_not_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f", "g h i j k l", "a b c d e f", "g h i j k l"])], "doc_id long, text string")
    plainly = neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda *a: plainly(*a).withColumn("class", F.lit(5).cast("long")))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got[1] != got[0] and got[2] in (0, 2) and got[3] in (1, 3)


def test_line_groups_agree_with_brute_force(spark):
    """Connected groups over chains of edits: what is kept is each brute-force group's first line."""
    rng, lines = random.Random(8), []
    for g in range(12):
        line = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(30))
        for _ in range(8):
            lines.append(line)
            w = line.split(" ")
            w[rng.randrange(30)] = "".join(rng.choice("klmnop") for _ in range(5))
            line = " ".join(w)
    rng.shuffle(lines)
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(lines)), 2):
        if line_dedup.edit_similar(lines[i], lines[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == {i for i in range(len(lines)) if find(i) == i}


def test_block_simhashes_agree_with_simhashes():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 12, 200)
    h, start = rng.integers(0, 1 << 63, int(n.sum())).astype(np.uint64), np.cumsum(n) - n
    whole = line_dedup.simhashes(h, np.append(start, len(h))) & np.uint64(0x0F0F0F0F0F0F0F0F)
    assert (line_dedup._block_simhashes(h, start, n) == whole).all()


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != e))
    return row[-1]


def test_within_edits():
    rng = random.Random(1)
    for _ in range(2000):
        x = "".join(rng.choice("ab cé") for _ in range(rng.randint(0, 30)))
        y = list(x) if rng.random() < 0.7 else [rng.choice("ab cé") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 2)] = rng.choice(["", "a", "b ", "c"])
        y, most = "".join(y), rng.randint(0, 12)
        assert line_dedup.within_edits(x, y, most) == (_levenshtein(x, y) <= most), (x, y, most)


@pytest.mark.parametrize("few", [0, 10**6])
def test_many_edits_at_once_agree_with_one_by_one(monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(5)
    xs, ys = [], []
    for size in (0, 1, 9, 10, 63, 64, 65, 128, 300, 1200):
        for _ in range(12):
            x = "".join(rng.choice("abcdef é漢") for _ in range(size))
            y = list(x)
            for _ in range(rng.randint(0, size // 6 + 1)):
                y[(k := rng.randrange(len(y) + 1)) : k + rng.randint(0, 1)] = rng.choice(["", "a", "q", "xy"])
            xs.append(x)
            ys.append("".join(y))
    want = [line_dedup.edit_similar(x, y) for x, y in zip(xs, ys, strict=True)]
    assert 20 < sum(want) < 110
    assert line_dedup.all_edit_similar(xs, ys).tolist() == want
    assert line_dedup.all_edit_similar([], []).tolist() == []


def test_joining_many_pairs_at_once():
    x = np.array([0, 1, 10, 11, 50, 90])
    all_rows = lambda i, other: other >= 0
    links = linking.joining(np.arange(6), np.ones(6, bool), all_rows, None, lambda i, j: np.abs(x[i] - x[j]) <= 10)
    assert sorted(map(sorted, links)) == sorted(map(sorted, linking.joining(np.arange(6), np.ones(6, bool), all_rows, lambda i, j: abs(x[i] - x[j]) <= 10)))


def test_joining_compares_what_is_not_connected_yet():
    """A hundred nodes that are all similar need about as many comparisons, not one for each pair."""
    asked = []
    links = linking.joining(np.arange(100), np.ones(100, bool), lambda i, other: other >= 0, None, lambda i, j: asked.extend(i) or np.ones(len(i), bool))
    assert len(links) == 99 and len(asked) < 200


def test_line_blocks_are_few_and_bear_insertions():
    """At most a block a class of a line of any length; of lines with a tenth of their letters in words put in or left out, over nine tenths share one."""
    rng = random.Random(2)
    common = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    lines, copies = [], []
    for _ in range(200):
        w = [rng.choice(common) for _ in range(rng.randint(30, 200))]
        lines.append(" ".join(w))
        left = len(lines[-1]) // 10
        for i in rng.sample(range(len(w)), len(w)):
            if len(w[i]) + 1 <= left:
                left -= len(w[i]) + 1
                w[i] = "" if rng.random() < 0.5 else f"{w[i]} {w[i]}"
        copies.append(" ".join(filter(None, w)))
    key, of = line_dedup.blocks(pa.array([*lines, *copies]))
    assert np.bincount(of).max() <= line_dedup.BLOCKS
    found = [set(key[of == i].tolist()) for i in range(400)]
    assert np.mean([bool(x & y) for x, y in zip(found[:200], found[200:], strict=True)]) >= 0.9


def test_rows_without_a_near_partner_go_before_texts_are_read(spark, monkeypatch):
    """Of the rows of a key those stay that sizes and marks allow with another node's, and no similar pair loses the keys it shares."""
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    forms = []
    for g in range(60):
        w = [word(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(rng.randint(4, 60))]
        forms += [" ".join(w), " ".join([*w[:-1], word("xyz")]), " ".join(w[: len(w) // 2])]
    forms = sorted({f for f in forms if len(f) >= 10})
    size, mark = np.array([len(f) for f in forms]), line_dedup.marks(pa.array(forms))
    rows = [(key, i, int(size[i]), int(mark[i])) for key in (1, 2) for i in range(len(forms)) if key == 1 or i % 3]
    keys = spark.createDataFrame(rows + rows[:5], "key long, node long, size long, mark long")
    sizes = line_dedup.Sizes(line_dedup._sizes_near, line_dedup._marks_like, line_dedup._size_step)
    similar = {(i, j) for i, j in itertools.combinations(range(len(forms)), 2) if line_dedup.edit_similar(forms[i], forms[j])}
    assert len(similar) > 10
    for ahead in (256, 3):
        monkeypatch.setattr(linking, "AHEAD", ahead)
        got = linking.near_members(keys, sizes).collect()
        assert len({(r.key, r.node) for r in got}) == len(got)
        held = {i: {r.key for r in got if r.node == i} for i in range(len(forms))}
        assert all(len(held[i] & held[j]) == 1 + (i % 3 > 0 and j % 3 > 0) for i, j in similar)
        by = {k: {r.node for r in got if r.key == k} for k in {r.key for r in got}}
        assert all(r.lead == min(by[r.key]) and r.crowd == (len(by[r.key]) > 2) and r.size == size[r.node] for r in got)
        assert all(r.star for r in got if (r.lead, r.node) in similar)
    monkeypatch.setattr(linking, "AHEAD", 256)
    assert linking.near_members(keys, sizes).count() < len(rows) * 0.9
    assert linking.near_members(keys.limit(0), sizes).count() == 0


def test_marks_allow_what_is_similar():
    rng = random.Random(12)
    xs, ys = [], []
    while len(xs) < 400:
        x = "".join(rng.choice("aeiou tnsrhéß日本語0") for _ in range(rng.randint(10, 400)))
        y = list(x)
        for _ in range(len(x) // 10):
            k = rng.randrange(len(y))
            y[k : k + 1] = rng.choice([[], [y[k], rng.choice("zé語")], [rng.choice("qzß本")]])
        if line_dedup.edit_similar(x, "".join(y)):
            xs.append(x)
            ys.append("".join(y))
    n, m = (np.array([len(t) for t in texts]) for texts in (xs, ys))
    less, more = np.minimum(n, m), np.maximum(n, m)
    assert line_dedup._sizes_near(less, more).all()
    assert line_dedup._marks_like(line_dedup.marks(pa.array(xs)), line_dedup.marks(pa.array(ys)), less, more).all()
    assert not line_dedup._marks_like(line_dedup.marks(pa.array(["e" * 40])), line_dedup.marks(pa.array(["t" * 40])), np.array([40]), np.array([40]))[0]


def test_profiles_agree_with_single_ones():
    texts = ["", "a", "ab", "abc", "日本語 text", "", "x" * 700, "the end"]
    assert (line_dedup.profiles(pa.array(texts)) == np.stack([line_dedup.profile(x) for x in texts])).all()
    assert line_dedup.profiles(pa.array([], pa.string())).shape == (0, line_dedup.BINS + 1)


def test_large_groups_meet_by_neighbouring_sizes(spark):
    """Every asking row meets every row of a near size in a task, and rows of other sizes don't multiply."""
    rng = random.Random(3)
    rows = [(5, i, i % 40 and i, -1, round(20 * 1.06 ** rng.randrange(60))) for i in range(400)]
    rest = spark.createDataFrame(rows, "key long, node long, label long, lead long, size long")
    got = linking._dealt(rest, 8, line_dedup._size_step).collect()
    tasks = {}
    for r in got:
        tasks.setdefault(r.task, (set(), set()))[0 if r.ask else 1].add(r.node)
    met = {(i, j) for asks, answers in tasks.values() for i in asks for j in asks | answers}
    size = {r[1]: r[4] for r in rows}
    assert all((i, j) in met for i in size for j in size if i % 40 and i != j and line_dedup._sizes_near(np.array([min(size[i], size[j])]), np.array([max(size[i], size[j])]))[0])
    assert 3 * len(got) < len(linking._dealt(rest, 8).collect())


def test_line_dedup_leaves_no_texts_in_the_shared_folder(spark):
    """Tables with texts go when what is read of them is written."""
    line = "a sentence that several documents hold with few words changed in it, number "
    d = table(spark, [(i, f"{line}{words(i, 3)}\n{words(100 + i, 30)}") for i in range(20)])
    folder = Path(line_dedup.written(d.limit(1)).written_to.removeprefix("file:")).parent
    before = {p.name for p in folder.iterdir()}
    assert line_dedup.dedup_lines(d).count() == 20
    new = [spark.read.parquet(str(p)).columns for p in folder.iterdir() if p.name not in before and any(p.glob("part-*"))]
    assert new and not any({"form", "body", "text"} & set(c) for c in new)


def test_quotes(spark):
    a, b = "hello there, this is the first message of all", "a second thought about everything said"
    rows = [(1, 0, "u", a), (1, 1, "a", f"> {a}\n{b}"), (1, 2, "u", "unrelated words of some length"), (1, 3, "a", f">> {a.upper()}\n> {b}\nagreed with the second"), (2, 0, "u", f"> {b}\nquoted from elsewhere"), (2, 5, "u", None), (None, 1, "u", "lost message")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, hash string")
    got = {(r.conv_id, r.turn): r for r in chat_quotes.link_quotes(d).collect()}
    assert got[1, 1].reply_to == 0 and got[1, 1].clean_text == b and got[1, 1].quote_levels == 1
    assert got[1, 3].reply_to == 1 and got[1, 3].n_linked == 2 and got[1, 3].quote_levels == 2 and got[1, 3].depth == 2
    assert got[1, 2].reply_to == 1 and got[1, 0].thread == 0 and got[1, 2].thread == 0
    assert (got[2, 0].quoted_conv, got[2, 0].quoted_turn, got[2, 0].reply_to) == (1, 1, None)
    assert got[2, 5].depth == 0 and got[2, 5].thread == 5 and (None, 1) in got
    assert chat_quotes.link_quotes(d.limit(0)).count() == 0


def test_quotes_find_the_original_behind_their_own_conversation(spark):
    """The least conversation with a text is the quoting one, which says it only later; repeated rows change nothing."""
    x = "a sentence that two conversations contain"
    rows = [(1, 1, "u", f"> {x}\nwho said so?"), (1, 3, "a", x), (2, 4, "u", x), (2, 4, "u", x), (3, 0, "u", x), (4, 0, "u", f"> {x}\nagain")]
    got = {(r.conv_id, r.turn): (r.quoted_conv, r.quoted_turn) for r in chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 1): (2, 4), (1, 3): (None, None), (2, 4): (None, None), (3, 0): (None, None), (4, 0): (1, 3)}


def test_language(spark):
    en, de = "the cat and the dog were in the house of the king", "der hund und die katze waren in dem haus des königs"
    texts = [(i, (en if i % 2 else de) + f" {i}") for i in range(60)] + [(100, None), (101, "123 !!"), (102, ""), (103, "The Dog and the King")]
    d = table(spark, texts, {i: "en" if i % 2 else "de" for i in range(60)} | {100: None, 103: None})
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert got[7].held_out == (crc32(b"7") % 4 == 2)
    assert {r.doc_id for r in langid.keep_identified(d).collect()} == {*range(60), 103}
    assert langid.identify(d.limit(0)).count() == 0


def test_neardup(spark, docs):
    got = [tuple(r) for r in neardup.near_duplicates(docs).collect()]
    by = {g[0]: g for g in got}
    assert by[1][2:] == (1, True) and by[2][2:] == (1, False) and by[3][2:] == (1, False) and by[8][2:] == (7, False) and by[7][1] == 1
    assert by[5] == (5, 0, 5, True) and by[6] == (6, 0, 6, True) and by[9][1] == 1 and by[None][2:] == (None, True) and len(got) == 13
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {2, 3, 8}.isdisjoint({r.doc_id for r in kept.collect()})
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_hyperminhash_estimates():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2500]), np.unique(x[500:])
    same = int((neardup._compress(neardup._registers(a)) == neardup._compress(neardup._registers(b))).sum())
    assert abs(float(neardup.estimated_jaccard(same)) - 2000 / 3000) < 0.15


def test_joining_finds_links_between_labels():
    """A failed pair hides no other; every label is joined by one link; rows that don't ask are not compared."""
    x = np.array([0, 2, 4, 50, 52, 90])
    label, ask = np.array([7, 8, 9, 10, 10, 11]), np.array([False, True, True, True, True, True])
    links = linking.joining(label, ask, lambda i, other: np.abs(x[other] - x[i]) < 40, lambda i, j: abs(x[i] - x[j]) <= 2)
    assert len(links) == 2 and {frozenset(p) for p in links} <= {frozenset((7, 8)), frozenset((8, 9))}
    assert linking.joining(label, np.zeros(6, bool), lambda i, other: other >= 0, lambda i, j: True) == []


def _brute_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        same = len(sets[i] & sets[j])
        if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("group", [neardup.GROUP, 16])
def test_neardup_keeps_drifting_chains_and_stars_whole(spark, monkeypatch, group):
    """A chain in which only neighbours are linked, and a star whose ends are linked by its middle only, in blocks of any size."""
    monkeypatch.setattr(neardup, "GROUP", group)
    rng, base = random.Random(1), words(50, 60).split()
    chain, star = [], [f"x{i}" for i in range(100)]
    for i in range(120):
        chain.append(" ".join(base))
        base[(7 * i) % 60] = f"new{i}"
    texts = chain + [" ".join(star)]
    for i in range(80):
        copy = list(star)
        for k in rng.sample(range(100), 2):
            copy[k] = f"y{i}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_components(sets)


def test_best_fit_takes_the_tightest():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    rng = np.random.default_rng(0)
    n = sorted(rng.integers(1, 2049, 500).tolist(), reverse=True)
    filled: list[int] = []
    for x in n:
        fit = [w for w in range(len(filled)) if filled[w] + x <= 2048]
        if fit:
            filled[max(fit, key=lambda w: filled[w])] += x
        else:
            filled.append(x)
    assert sorted(sum(n[i] for i in w) for w in packing.best_fit(n)) == sorted(filled)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs.where("doc_id is not null and doc_id <> 10"), with_ids=True).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    for r in docs.where("doc_id is not null and doc_id <> 10").collect():
        mine = got[got.doc_id == r.doc_id].sort_values("start")
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(mine.ids) == ids.tobytes() and mine.doc_tokens.iloc[0] == len(ids)
        assert [crc32(x) for x in mine.ids] == mine.ids_crc32.tolist()
    assert packing.pack(docs.limit(0)).count() == 0


def test_chat_depths(spark):
    """Long and short threads without quotations: depth counts the turns up to the first; a gap begins a thread."""
    turns = [(1, i) for i in range(70)] + [(2, 0)] + [(3, i) for i in (0, 1, 2, 5, 6)]
    rows = [(c, i, "user", f"text {c} {i}") for c, i in turns]
    got = {(r.conv_id, r.turn): (r.thread, r.depth) for r in chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(c, i): (5, i - 5) if c == 3 and i >= 5 else (0, i) for c, i in turns}


def test_fingerprint_ranges(spark):
    """Over many ranges of ids, with gaps and negative ids, each document is followed by the next lower id."""
    ids = sorted({int(x) for x in np.random.default_rng(7).integers(-(10**6), 10**12, 300)}, reverse=True)
    docs = spark.createDataFrame([(i, words(abs(i) % 1000, 20)) for i in ids], "doc_id long, text string").repartition(3)
    dealt = fingerprints.with_next(docs, range_chars=400)
    held = {}
    for r in dealt.collect():
        held.setdefault(r.range, []).append((r.extra, -r.id))
    assert len(held) > 50
    pairs = {}
    for rows in held.values():
        rows.sort()
        assert [x[0] for x in rows].count(True) == 1 and rows[-1][0]
        pairs |= {-a[1]: -b[1] for a, b in itertools.pairwise(rows)}
    assert pairs == dict(zip(ids, [*ids[1:], ids[0]], strict=True))


def test_fingerprints(spark, docs):
    got = {(r.doc_id, r.edited_sha256): r for r in fingerprints.compare_edited(docs).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id not in (None, 10)), reverse=True)
    by = {r.doc_id: r for r in got.values()}
    assert len(fingerprints.compare_edited(docs).collect()) == 13
    for (i, x), (j, y) in zip(rows, rows[1:], strict=False):
        if i == 12 or j == 9:
            continue  # neighbours of the repeated id
        h = len(x) // 2
        assert by[i].edited_sha256 == hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest() and by[i].n_chars == len(x)
    assert by[1].fingerprint == by[3].fingerprint and by[5].n_chars == 0 and by[2].near_next > 0.7 and by[6].near_next == 1.0
    assert fingerprints.compare_edited(docs.limit(0)).count() == 0


def test_lm_scores(spark):
    texts = [(i, f"the cat {i % 7} sat on the mat and the dog ran to the cat house {words(i % 5, 20)}") for i in range(120)] + [(500, None), (501, ""), (502, "zebra quagga " * 50)]
    d = table(spark, texts)
    got = {r.doc_id: r for r in lm_scoring.score(d).collect()}
    body = {i: (t or "").encode().lower().split() for i, t in texts}
    train = [i for i in body if crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in body[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, w in body.items():
        below = math.log10(n + 0.5 * (v + 1))
        want = sum(math.log10(c.get(x, 0) + 0.5) - below for x in w) + math.log10(len(train) + 0.5) - below
        assert got[i].base_score == pytest.approx(want) and got[i].train_tokens == n and got[i].n_tokens == len(w) + 1 and got[i].score < 0
        assert got[i].n_known == sum(x in c for x in w) + 1
    held = [i for i in range(120) if i not in train]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert got[0].bits_per_byte == pytest.approx(-got[0].score * math.log2(10) / len(texts[0][1]))
    assert lm_scoring.score(d.limit(0)).count() == 0


def test_lm_bits_agree_with_one_bit_at_a_time():
    """Lockstep scores against a plain loop over each text's bits; the codes of all symbols have total probability 1."""
    rng = np.random.default_rng(2)
    code = lm_scoring.huffman([40, 30, 9, 5, 3, 2, 2, 1])
    v = lm_scoring.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), code, 6, 7)
    tables = rng.normal(size=(lm_scoring.TABLES, 1 << lm_scoring.SLOT_BITS)).astype(np.float32)
    mixer = lm_scoring.Mixer(rng.normal(0.3, 0.1, (lm_scoring.GATES, lm_scoring.TABLES)).astype(np.float32), rng.uniform(0.1, 0.9, (lm_scoring.GATES, lm_scoring.BINS)).astype(np.float32))
    size = [1, 200, 3, 90]
    symbols, text = rng.integers(0, 8, sum(size)), np.repeat(np.arange(4), size).astype(np.int32)
    first = np.concatenate([[True], text[1:] != text[:-1]])
    got = lm_scoring._bit_scores(symbols, text, first, 4, v, tables, mixer)
    owner, depth, bit, slots = lm_scoring._word_slots(symbols, first, v)
    want, own, seen, lesson = np.zeros(len(symbols)), np.zeros(lm_scoring.TABLES), 0, np.zeros(lm_scoring.TABLES)
    for k in range(len(bit)):
        if k == 0 or text[owner[k]] != text[owner[k - 1]]:
            own, seen, lesson = np.zeros(lm_scoring.TABLES), 0, np.zeros(lm_scoring.TABLES)
        if seen and seen % lm_scoring.STEP == 0:
            own, lesson = own + lm_scoring.RATE * lesson, np.zeros(lm_scoring.TABLES)
        x, g = np.array([tables[i][slots[i, k]] for i in range(lm_scoring.TABLES)], float), min(depth[k], lm_scoring.GATES - 1)
        s = float(((mixer.weights[g] + own) * x).sum())
        cell = int(np.clip(np.rint(2 * s), -(lm_scoring.BINS // 2), lm_scoring.BINS // 2)) + lm_scoring.BINS // 2
        p = 0.5 * (1 / (1 + math.exp(-s)) + float(mixer.refined[g, cell]))
        want[owner[k]] += math.log10(p if bit[k] else 1 - p)
        lesson += (bit[k] - p) * x
        seen += 1
    assert np.allclose(got, want, atol=2e-3)
    chances = [10 ** lm_scoring._bit_scores(np.array([3, 1, s]), np.zeros(3, np.int32), np.array([True, False, False]), 1, v, tables, mixer)[2] for s in range(8)]
    assert sum(chances) == pytest.approx(1, abs=1e-3)


def test_lm_rare_words_have_total_probability_one():
    counts = [1, 1, 1, 2, 2, 5, 9]
    law = lm_scoring.rare_words(sum(counts), len(counts), 3, 2)
    assert sum((c - law.discount) / law.total for c in counts) + law.unknown == pytest.approx(1)


def test_lm_passage_answers():
    """Passages that agree gain nearly all of their bits; ones that don't cost little, the less the longer they fail."""
    row = lambda at, yes: {"at": at, "bits": -30.0, "yes": yes, "same": 1, "all": 1}
    assert lm_scoring.answer_passages([row(i, 1) for i in range(20)]) > 20 * 29.5
    fails = [lm_scoring.answer_passages([row(i, 0) for i in range(n)]) for n in (1, 20)]
    assert 0 > fails[1] > 20 * fails[0]


def test_lm_tells_texts_that_occur_twice(spark):
    """A text whose copy is trained on, too, scores above texts that occur once, whether it is held out or not."""
    texts = [(i, words(1000 + i, 150)) for i in range(60)] + [(100 + i, words(1000 + i, 150)) for i in range(12)]
    got = {r.doc_id: r for r in lm_scoring.score(table(spark, texts)).collect()}
    trained = {i for i, _ in texts if crc32(str(i).encode()) % 5 != 1}
    twice = [i for i in got if i % 100 < 12 and (i + 100 if i < 100 else i - 100) in trained]
    once = [got[i].score for i in range(12, 60)]
    assert twice and min(got[i].score for i in twice) > max(once)


def test_lm_mixer_starts_from_all_training_texts():
    """Texts beyond any number still teach the mixer; its weights are the tasks' own, by their bits."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 40_000)
    x = rng.normal(size=(lm_scoring.TABLES, len(y))).astype(np.float32)
    x[0] = np.where(y, 2, -2)  # the one that tells
    gate = np.zeros(len(y), np.int32)
    a, b = lm_scoring.Fit(), lm_scoring.Fit()
    a.learn(x[:, :10_000], gate[:10_000], y[:10_000]), b.learn(x[:, 10_000:], gate[10_000:], y[10_000:])
    m = lm_scoring.fitted_mixer(a.sums() + b.sums())
    assert a.bits[0] + b.bits[0] == len(y) and np.allclose(m.weights[0], a.weights[0] / 4 + b.weights[0] * 3 / 4, rtol=1e-5) and m.weights[0, 0] > 0.5 and abs(m.weights[0, 1:]).max() < 0.1
    assert (m.weights[1:] == 1 / lm_scoring.TABLES).all() and np.allclose(lm_scoring.fitted_mixer(None).weights, 1 / lm_scoring.TABLES)


def test_lm_texts_of_like_lengths_are_scored_together(monkeypatch):
    """Long texts among short ones don't make each run of texts take as many steps as theirs."""
    known = lm_scoring.hashes(pa.array([f"w{i}" for i in range(8)]))
    order = np.argsort(known)
    v = lm_scoring.Vocabulary(known[order], np.full(8, 100), order, lm_scoring.huffman([100] * 10), 8, 9)
    texts = [" ".join(f"w{k % 8}" for k in range(n)) for _ in range(8) for n in (3000, *[300] * 10)]
    steps, plainly = [], lm_scoring._mixed
    monkeypatch.setattr(lm_scoring, "_mixed", lambda *a: steps.append(1) or plainly(*a))
    monkeypatch.setattr(lm_scoring, "_WORDS_AT_ONCE", 6000)

    class Shared:
        value = np.zeros((lm_scoring.TABLES, 1 << lm_scoring.SLOT_BITS), np.float32), lm_scoring.fitted_mixer(None), 1

    got = list(lm_scoring._scorer(v, 800, 9, lm_scoring.rare_words(0, 0, 0, 0), Shared)([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])]))
    n_tokens = {i: n for b in got for i, n in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), strict=True)}
    assert n_tokens == {i: len(t.split()) + 1 for i, t in enumerate(texts)}
    assert len(steps) < 500  # 8 runs of long texts and short ones take about 80 each, or 4 runs of long ones and 4 of short ones


def test_lm_counting_task_learns_from_each_text(spark):
    """All bits but those of a task's first run of texts are predicted and learnt from, whatever the number of texts."""
    texts = [(i, words(i % 50, 40)) for i in range(700)]
    code = lm_scoring.huffman([5, 3, 2, 1])
    v = lm_scoring.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), code, 2, 3)
    rows = table(spark, texts).coalesce(1).select("text").mapInArrow(lm_scoring._learner(v), "chunk long, part long, data binary").where(f"chunk = {lm_scoring.FITTED}").collect()
    seen = np.frombuffer(zlib.decompress(rows[0].data))[-lm_scoring.GATES * lm_scoring.BINS :].sum()
    bits = 40 * code.size[3] + code.size[2]  # of each text
    assert len(rows) == 1 and (700 - lm_scoring.FIRST_WORDS // 40 - 1) * bits <= seen < 700 * bits


def test_mixing(spark, docs):
    rows = [(i, "w " * (i % 13), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(900, None, "s9")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        rest, w = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in names if s not in fixed)
        share = {s: rest * weight[s] / w for s in names if s not in fixed}
        above = [s for s in share if share[s] > 3 * sizes[s]]
        if not above:
            break
        fixed |= {s: 3 * sizes[s] for s in above}
    want = share | fixed
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 15 for s in names)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(d).collect()), key=str)
    assert mixing.take_mix(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


NAMES = ("score", "lang_pred", "gone", "_gone", "of", "_of", "had", "id", "_id", "_source", "copies", "_copies", "copy", "_copy", "at", "_slot", "Slot", "node", "key", "row", "form", "size")


@pytest.mark.parametrize("stage", ["language_id", "line_dedup", "minhash_neardup", "mixing", "packing", "sharding"])
def test_stages_with_clashing_names_nulls_and_empty_tables(spark, stage):
    """Columns of any name keep their values; nulls, empty texts, repeated rows and empty tables pass through each stage."""
    import corpus_pipeline

    texts = [(i, f"the cat and the dog were in the house of the king number {words(i, 12)}") for i in range(12)] + [(3, None), (None, None), (50, ""), (51, "the cat"), (51, "the cat"), (None, "the cat and a dog")]
    rows = [(i, t, "en", None if i == 4 else "s", len(t or ""), *(f"{n}-{i}" for n in NAMES)) for i, t in texts]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    run = dict(corpus_pipeline.STAGES).get(stage) or (lambda _, docs, __: sharding.assign(docs, "doc_id"))
    got = run(spark, d, "")
    assert run(spark, d.limit(0), "").count() == 0
    found = got.collect()
    assert found
    if stage in ("packing", "sharding"):
        assert {r.doc_id for r in found} == {i for i, _ in texts}
        return
    assert got.columns == d.columns
    assert all(r[n] == f"{n}-{r.doc_id}" for r in found for n in NAMES)
    if stage == "language_id":
        assert {r.doc_id for r in found} <= {*range(12), 51, None} and all(r.text for r in found)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.limit(120).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_neardup", "mixing", "packing"]
