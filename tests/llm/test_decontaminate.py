"""Benchmark decontamination against brute force, and texts with spans removed."""

import hashlib
import re

import numpy as np
import pytest

from spotweave.llm import decontaminate

ITEMS = "item_id long, text string, w string, hash long, window long"
DOCS = "doc_id long, text string, id string, own string, h long, start long, _id string"


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = plain(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = plain(text)
        hit, found = set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", "y", 1, 2, "z") for d in docs], DOCS), spark.createDataFrame([(*i, "x", 1, 2) for i in items], ITEMS)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    sentence = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 40, n))
    items = [(1, sentence(25)), (2, sentence(10)), (3, "One, TWO three"), (4, None), (5, "..."), (6, "KÉ K"), (7, sentence(14)), (10, "one two three"), (None, "solo"), (7, "other words of seven here")]
    long = [sentence(700), items[0][1], sentence(1300), items[6][1].upper().replace(" ", " -\n"), sentence(40)]
    docs = [
        (1, "x " + items[0][1] + " y"), (2, items[0][1][10:] + "!"), (3, "ONE two;three one two three"), (4, None), (5, ""), (6, "solo KÉ K ké k"), (7, "clean text of no item at all"),
        (8, " ".join(long)), (8, "another text of the same id solo"), (9, items[1][1]), (9, items[1][1]), (None, "one two three"), (11, "\x00one\x1ftwo\x7fthree"), (12, "a " * 511 + items[1][1] + " b" * 600), (13, " ".join([items[1][1]] * 300)),
    ]
    return docs, items


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination_agrees_with_brute_force(spark, tables, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_HASHES", most)
    monkeypatch.setattr(decontaminate, "MOST_BYTES", most)
    docs, items = tables
    got = decontaminate.contamination(*frames(spark, docs, items))
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_nothing_runs_in_python(spark, tables):
    plan = decontaminate.contamination(*frames(spark, *tables))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark, tables):
    docs, items = frames(spark, *tables)
    assert decontaminate.contamination(docs.where("false"), items).count() == 0
    got = decontaminate.contamination(docs, items.where("false")).collect()
    assert len(got) == len(tables[0]) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert decontaminate.decontaminate(docs, items.where("false")).count() == docs.count()


def test_spans_go_and_the_rest_stays(spark):
    docs = [(1, "  Keep this; ONE two, three. And THIS!\n"), (2, "one two three"), (3, None), (4, "clean  As it É is "), (5, "one two three mid one two three end"), (6, "")]
    d, i = frames(spark, docs, [(1, "one two three")])
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(d, i).collect()}
    assert got == {1: "  Keep this; And THIS!\n", 2: "", 3: None, 4: "clean  As it É is ", 5: "mid end", 6: ""}
    kept = decontaminate.decontaminate(d, i, remove="documents")
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6] and kept.columns == d.columns
    with pytest.raises(ValueError):
        decontaminate.decontaminate(d, i, remove="words")
