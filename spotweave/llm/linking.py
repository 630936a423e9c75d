"""Connected groups of nodes that share block keys and are similar, without a list of all their pairs.

Two nodes are linked if they share a key and `similar` holds for their bodies. Groups come in rounds that contract
what is connected already:

1. Stars: every node is compared with the least node of each of its keys. This is one row for each (key, node) at
   most and connects most of a group of copies.
2. Blocks: a key whose nodes still have several labels is compared exactly, in tasks. The nodes outside the key's
   largest label ask, all of the key's nodes answer; beyond `group` nodes both sides are cut into blocks, and a task
   has one block of each. A task compares only nodes of different labels, passes over pairs that `alike` rules out
   by their sketches, and emits only links that join two labels, so never more than it has labels.

Where bodies have sizes that bound their likeness (`Sizes`), rows that no other row of their key can be similar to go
before any body is read, keys split where sizes leave a gap, and only blocks of neighbouring sizes meet.

A pair is compared under the least key that both nodes have, so once besides its stars. One that fails hides no
other pair, so no link between nodes that share a key is lost, whatever the size of the key's group.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.graph import components
from spotweave.llm.tables import dropped, settled, written
from spotweave.llm.text import mix, signed

#: Nodes of a block.
GROUP = 1024

#: Partitions that tasks are dealt to at most; beyond that partitions grow.
MOST_PARTITIONS = 65_536

#: Rows (key, node) that may be broadcast; beyond that, a join by shuffles gives the same.
BROADCAST = 1_000_000

#: Rows of a block that ask at once at most.
TOGETHER = 64

#: Rows in order of size that a row's mark is held against; rows beyond that stay untested.
AHEAD = 256

#: Sketches of bodies, as anything that `alike` can index.
Sketch = Callable[[pa.Array], np.ndarray]
#: (sketches, i, others) -> whether node i may be similar to each of the others.
Alike = Callable[[np.ndarray, int, np.ndarray], np.ndarray]
#: (bodies, others) -> what `similar` says of each pair.
Several = Callable[[list, list], np.ndarray]


class Sizes(NamedTuple):
    """What sizes say of pairs. Between two that are near, all sizes must be near both."""

    #: (lesser, greater) -> whether the sizes allow nodes to be similar.
    near: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: (marks, marks, lesser, greater) -> whether the marks of nodes of near sizes do.
    like: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: A whole number for each size; near sizes have the same or the next.
    step: Callable[[Column], Column]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows, sorted by `key`, some at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(key).to_numpy()
        last = int(np.searchsorted(at, at[-1]))  # the last group may go on in the next batch
        if last == 0 and (not held or held[-1].column(key)[-1].as_py() == at[0]):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks() if last else pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def asking(label: np.ndarray, ask: np.ndarray, may: Callable[[int, np.ndarray], np.ndarray]) -> Generator[tuple[list[int], list[int]], np.ndarray, list[tuple[int, int]]]:
    """`joining` for comparisons of many pairs at once: yields pairs, takes what holds of them, and returns the links.

    Each row is compared with one row of each label, then with more of those that are left: what is connected meanwhile isn't
    compared. As long as nothing is found, twice as many rows ask at once.
    """
    names, root = np.unique(label, return_inverse=True)
    first = root.copy()
    place = np.arange(len(label))
    links: list[tuple[int, int]] = []
    rows, at, together = np.flatnonzero(ask), 0, 1
    while at < len(rows):
        left, width, before = [], 1, len(links)
        for i in rows[at : at + together]:
            other = np.flatnonzero((root != root[i]) & ~(ask & (place < i)))
            left.append((i, other[may(i, other)] if len(other) else other))
        at += together
        while left:
            x, y, more = [], [], []
            for i, other in left:
                other = other[root[other] != root[i]]
                order = np.argsort(root[other], kind="stable")
                rank = np.empty(len(other), np.int64)
                rank[order] = np.arange(len(other))
                now = rank - np.searchsorted(root[other][order], root[other]) < width
                x += [int(i)] * int(now.sum())
                y += other[now].tolist()
                if not now.all():
                    more.append((i, other[~now]))
            if not x:
                break
            good = yield x, y
            for k in np.flatnonzero(good).tolist():
                i, j = x[k], y[k]
                if root[i] != root[j]:
                    links.append((int(names[first[i]]), int(names[first[j]])))
                    root[root == root[j]] = root[i]
            left, width = more, 4 * width
        together = 1 if len(links) > before else min(2 * together, TOGETHER)
    return links


def compared(groups: list[tuple[Generator, list]], several: Several) -> set[tuple[int, int]]:
    """The links of all groups (`asking`, bodies): what they ask next is compared together, so that pairs are many at once."""
    links: set[tuple[int, int]] = set()
    said: list[np.ndarray | None] = [None] * len(groups)
    while groups:
        waiting, xs, ys, ends = [], [], [], [0]
        for (group, values), answer in zip(groups, said, strict=True):
            try:
                x, y = group.send(answer)
            except StopIteration as end:
                links.update(end.value)
                continue
            waiting.append((group, values))
            xs += [values[i] for i in x]
            ys += [values[j] for j in y]
            ends.append(len(xs))
        groups, said = waiting, np.split(several(xs, ys), ends[1:-1]) if waiting else []
    return links


def joining(
    label: np.ndarray, ask: np.ndarray, may: Callable[[int, np.ndarray], np.ndarray], similar: Callable[[int, int], bool] | None, several: Callable[[list[int], list[int]], np.ndarray] | None = None
) -> list[tuple[int, int]]:
    """Links between labels: each asking row is compared with all rows whose label isn't connected to its own yet.

    `several`, where given, says the same as `similar` of many pairs at once.
    """
    if several:
        return list(compared([(asking(label, ask, may), range(len(label)))], several))
    names, root = np.unique(label, return_inverse=True)
    first = root.copy()
    place = np.arange(len(label))
    links = []
    for i in np.flatnonzero(ask):
        other = np.flatnonzero((root != root[i]) & ~(ask & (place < i)))
        if not len(other):
            continue
        other = other[may(i, other)]
        while len(other):
            j = other[0]
            if similar(i, j):
                links.append((int(names[first[i]]), int(names[first[j]])))
                root[root == root[j]] = root[i]
                other = other[root[other] != root[i]]
            else:
                other = other[1:]
    return links


def near_members(keys: DataFrame, sizes: Sizes) -> DataFrame:
    """(key, node, size, lead, star, crowd) of the rows (key, node, size, mark) that another node of their key may be similar to.

    Keys are new ones, one for each run of sizes without a gap; two nodes that may be similar share as many as before.
    lead is the run's least node, star says whether it may be similar to the row's own, crowd whether the run has more than two nodes.
    Rows are shuffled once, as numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            key, node, size, mark = (table.column(c).to_numpy() for c in ("key", "node", "size", "mark"))
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (size[1:] != size[:-1])]))
            key, node, size, mark = key[new], node[new], size[new], mark[new]
            partner, i = np.zeros(len(key), bool), np.arange(len(key))
            for d in range(1, AHEAD + 1):
                i = i[: np.searchsorted(i, len(key) - d)]
                i = i[key[i] == key[i + d]]
                i = i[sizes.near(size[i], size[i + d])]  # a row that is too large has only larger ones behind it
                if not len(i):
                    break
                j = i[~(partner[i] & partner[i + d])]
                j = j[sizes.like(mark[j], mark[j + d], size[j], size[j + d])]
                partner[j] = partner[j + d] = True
            else:  # the rows that weren't tested
                ends = np.zeros(len(key) + 1, np.int64)
                np.add.at(ends, i, 1)
                np.add.at(ends, np.searchsorted(key, key[i], "right"), -1)
                partner |= np.cumsum(ends[:-1]) > 0
            at = np.flatnonzero(partner)
            if not len(at):
                continue
            key, node, size, mark = key[at], node[at], size[at], mark[at]
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | ~sizes.near(size[:-1], size[1:])]))
            n = np.diff(np.append(start, len(key)))
            part = np.repeat(np.arange(len(start)), n)
            least = np.lexsort((node, part))[start]
            lead, other = node[least][part], size[least][part]
            less, more = np.minimum(size, other), np.maximum(size, other)
            star = (node != lead) & sizes.near(less, more) & sizes.like(mark, mark[least][part], less, more)
            named = signed(mix(key.view(np.uint64) + mix(size[start][part].astype(np.uint64) + np.uint64(1))))
            yield pa.record_batch([pa.array(x) for x in (named, node, size, lead, star, n[part] > 2)], names=["key", "node", "size", "lead", "star", "crowd"])

    rows = keys.select("key", "node", F.col("size").cast("long"), "mark").repartition("key").sortWithinPartitions("key", "size", "node")
    return rows.mapInArrow(run, "key long, node long, size long, lead long, star boolean, crowd boolean")


def _dealt(rest: DataFrame, group: int, step: Callable[[Column], Column] | None = None) -> DataFrame:
    """(task, key, node, label, ask, lead) of rows (key, node, label, lead), with `step` and a size, for keys with several labels."""
    counts = rest.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_keys = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1 and n > 2")  # the stars have compared two nodes
    open_keys = open_keys.select("key", F.col("most.label").alias("largest"), F.ceil(F.col("n") / group).alias("blocks"), F.ceil((F.col("n") - F.col("most.n")) / group).alias("asking"))
    rows = rest.join(open_keys, "key").withColumn("ask", F.col("label") != F.col("largest"))
    small = rows.where("blocks = 1").select(F.col("key").alias("task"), "key", "node", "label", "ask", "lead")
    large = written(rows.where("blocks > 1"))
    if large.isEmpty():
        return small
    mine = F.xxhash64("node", F.lit(7))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    answers, asks = large.withColumn("step", F.lit(0).cast("long")), large.where("ask").withColumn("step", F.lit(0).cast("long"))
    if step:
        # Nodes of one step of sizes ask those of the same and both next ones, so a key is as many smaller ones.
        own = step(F.col("size")).cast("long")
        answers, asks = large.withColumn("step", F.explode(F.array(own - 1, own, own + 1))), large.where("ask").withColumn("step", own)
        n = asks.groupBy("key", "step").agg(F.count("*").alias("n"))
        n = answers.groupBy("key", "step").agg(F.count("*").alias("all")).join(n, ["key", "step"])
        n = written(n.select("key", "step", F.ceil(F.col("all") / group).alias("blocks"), F.ceil(F.col("n") / group).alias("asking")))
        answers, asks = (x.drop("blocks", "asking").join(n, ["key", "step"]) for x in (answers, asks))
    answers = answers.withColumn("a", F.pmod(mine, F.col("blocks"))).withColumn("q", every("asking")).withColumn("ask", F.lit(False))
    asks = asks.withColumn("q", F.pmod(mine, F.col("asking"))).withColumn("a", every("blocks"))
    columns = [F.xxhash64("key", "step", "q", "a").alias("task"), "key", "node", "label", "ask", "lead"]
    return small.unionByName(answers.select(columns)).unionByName(asks.select(columns))


def known_few(rows: DataFrame) -> DataFrame:
    """Written rows, marked for a broadcast if they are at most BROADCAST."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def searched(batches: Iterator[pa.RecordBatch], similar: Callable[[object, object], bool], sketch: Sketch, alike: Alike, several: Several | None) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between labels, of rows (task, key, lead, node, label, ask, body, keys) sorted by task and node."""
    for table in runs(batches, "task"):
        task, node = table.column("task").to_numpy(), table.column("node").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        links: set[tuple[int, int]] = set()
        groups: list[tuple[Generator, list]] = []
        for a, b in zip(start, [*start[1:], len(task)], strict=True):
            mine, begin = np.unique(node[a:b], return_index=True)
            key, lead = table.column("key")[a].as_py(), table.column("lead")[a].as_py()
            ask = np.maximum.reduceat(table.column("ask").slice(a, b - a).to_numpy(), begin)
            part = table.slice(a, b - a).take(pa.array(begin)).combine_chunks()
            body = part.column("body").combine_chunks()
            marks, values = sketch(body), body.to_pylist()
            shared = [set(x) for x in part.column("keys").to_pylist()]

            def may(i: int, other: np.ndarray, mine=mine, lead=lead, shared=shared, key=key, marks=marks) -> np.ndarray:
                """The pairs that sketches allow and that are compared under this key: no star has, and it is the least that both have."""
                out = alike(marks, i, other)
                out[out] = [lead not in (mine[i], mine[j]) and min(shared[i] & shared[j]) == key for j in other[out]]
                return out

            label = part.column("label").to_numpy()
            if several:
                groups.append((asking(label, ask, may), values))
            else:
                links.update(joining(label, ask, may, lambda i, j, values=values: similar(values[i], values[j])))
        links |= compared(groups, several) if several else set()
        if links:
            yield pa.record_batch([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def connect(
    keys: DataFrame, bodies: Callable[[DataFrame], DataFrame], similar: Callable[[object, object], bool], sketch: Sketch, alike: Alike,
    rounds: int = 1, group: int = GROUP, several: Several | None = None, sizes: Sizes | None = None,
) -> DataFrame:
    """(node, component) of all nodes that share a key with another; a component is named by its least node.

    keys: (key, node, round), with `sizes` (key, node, size, mark), all of one round; repeated rows allowed; stars take all keys, blocks those of one round after the other.
    bodies: gives (node, body) of the nodes asked for, one row each.
    several: what `similar` says of many pairs at once.
    sizes: what sizes and marks allow; of the nodes without any that these allow, none is in the result.
    """
    if sizes:
        members = settled(written(near_members(keys, sizes)))
        stars = members.where("star").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    else:
        # Most keys are one node's own, on however many rows: they are shuffled once, with 32-bit hashes of nodes, and nodes only of those that are left.
        often = written(keys.groupBy("key").agg(F.min(F.hash("node")).alias("lo"), F.max(F.hash("node")).alias("hi")).where("lo < hi").select("key"))
        repeated = written(keys.join(known_few(often), "key"))
        shared = repeated.groupBy("key").agg(F.min("node").alias("lead"))
        members = written(repeated.join(shared, "key"))
        stars = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    own = settled(written(members.groupBy("node").agg(F.collect_set("key").alias("keys"))))  # as many as a node has blocks
    held = settled(written(bodies(own.select("node")).join(own, "node")))
    if sizes:
        stars = settled(written(stars))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = several(x, y) if several else [similar(p, q) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = stars.join(held.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").join(held.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    found = components(pairs.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))
    state = settled(written(own.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("label"))))
    for k in range(rounds):
        mine = members.where("crowd").select("key", "node", "lead", "size") if sizes else members.where(F.col("round") == k).select("key", "node", "lead").distinct()
        tasks = settled(written(_dealt(mine.join(state, "node"), group, sizes and sizes.step)))
        if tasks.isEmpty():
            continue
        partitions = min(-(-tasks.count() // (4 * group if several else group)), MOST_PARTITIONS)  # given, since work goes by rows and not by bytes; pairs of many rows are compared at once
        rows = tasks.join(held, "node").repartition(partitions, "task").sortWithinPartitions("task", "node")
        links = settled(written(rows.select("task", "key", "lead", "node", "label", "ask", "body", "keys").mapInArrow(lambda batches: searched(batches, similar, sketch, alike, several), "a long, b long")))
        if not links.isEmpty():
            merged = components(links).withColumnRenamed("node", "label")
            state = written(state.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("label")))
        dropped(tasks, links)
    dropped(members, own, held)
    return state.withColumnRenamed("label", "component")
