"""The prefix trie against a plain walk over whole conversations."""

import hashlib
import random
import zlib

from spotweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth long, node long, q long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        built[c] = tuple(base[:h] + own[c][h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == k)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), sum(len(x) == len(k) + 1 for x in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def test_agrees_with_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4, 4, 7]), rng.choice(["user", "assistant", None]), rng.choice(["hé", "yes", "", None, "no"])) for c in range(-7, 60) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 12]))]
    rows += [(c, t, "user", "same") for c in (100, 101, 107, 900) for t in range(20)]  # equal conversations, longer than what is shared
    rows += [(200, t, "user", f"long {t % 3}") for t in range(150)] + [(201, t, "user", f"long {t % 3}") for t in range(150)]
    rows += [(None, 1, "user", "lost"), (300, 1, "user", "twice"), (300, 1, "user", "twice"), (44, None, None, None)]
    rng.shuffle(rows)
    got = prefix_trie.trie(frame(spark, rows).repartition(5))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_names_are_dense_and_equal_for_equal_beginnings(spark):
    texts = {1: "abcabc", 2: "abcabd", 3: "ab", 4: "", 5: "bcabca"}
    turns = spark.createDataFrame([(c, d + 1, t.encode()) for c, x in texts.items() for d, t in enumerate(x)], "conv long, depth long, turn binary")
    got = {(r.conv, r.depth): r.node for r in prefix_trie.prefixes(turns, spark.createDataFrame([(c,) for c in texts], "conv long")).collect()}
    assert set(got) == {(c, d) for c, x in texts.items() for d in range(len(x) + 1)}
    for (c, d), n in got.items():
        for (e, f), m in got.items():
            if d == f:
                assert (n == m) == (texts[c][:d] == texts[e][:d])
    named = prefix_trie._named(turns, ["turn"], "name").select("turn", "name").distinct().collect()
    assert sorted(r.name for r in named) == list(range(len("abcd")))


def test_ids_of_a_node_in_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, 0, "user", "hello") for c in range(0, 500, 5)]
    got = prefix_trie.trie(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert prefix_trie.trie(frame(spark, [])).count() == 0
    rows = [(c, 0, "user", "x") for c in range(1, 5)]  # their family's first conversation is absent
    assert sorted(map(tuple, prefix_trie.trie(frame(spark, rows)).collect()), key=str) == brute(rows)
