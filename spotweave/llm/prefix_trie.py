"""The prefix trie of conversations, by prefix doubling.

A node is a distinct sequence of first turns. Turns get dense numbers as names, and blocks of 2^k turns that begin at a
multiple of 2^k get theirs from the pairs of names of their halves: one grouping and one join for each of the log2(longest)
levels. The first d turns are the blocks of d's binary digits, largest first: the prefix that lacks the last block is named
before, and the pair of its name and the block's names the prefix, in as many rounds as d has digits that are set. So
equal names are equal sequences of turns, which are compared by the SHA-256 of role and text alone.

Every row (conversation, depth) then knows its node. What a subtree adds up to is put on the rows of one member of each
node and summed along that conversation from its end, by range partitions, and then by node; no path is walked. A long
conversation, a turn that many conversations share and the root are keys that only partial aggregates, joins that adaptive
execution splits and range partitions see. Every step is a written table.

The end lists' digest reads ids in order, so a node's ids pass one task, in runs of RUN as text that earlier tasks made; it
holds a batch of them at a time.

Null roles and texts are empty; turns that tie are ordered by role and text, and repeated rows are turns like others. Rows without
conv_id are left out. Without conversations there is no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.tables import written
from spotweave.operators.scans import range_sorted, running

#: The conversations that share a beginning after rebuilding, and how long that is at most, less one.
FAMILY, MOST_SHARED = 5, 9

#: Ids that are joined into one text before they go to the task of their node.
RUN = 256

_BITS = 33  #: monotonically_increasing_id's bits of the place in a partition


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, at, turn, bytes): the turns of each conversation numbered from 0; `turn` is the digest of role and text, `bytes` the text's."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", empty("role"), empty("text"))
    laid = range_sorted(rows, ["conv"], ["turn", "role", "text"])
    placed = running(laid, ["conv"], {"at": ("count", F.lit(1))}, upto=-1)
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return written(placed.select("conv", "at", F.unhex(digest).alias("turn"), F.octet_length("text").cast("long").alias("bytes")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations that begin with the first turns of their family's first: ((conv, depth, turn, bytes), (conv, length)).

    Conversation c begins with the first crc32(c) % 9 turns of conversation c - c % 5 and goes on with its own turns from there.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = own.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).alias("h"))
    lengths = own.select(F.col("conv").alias("base"), F.least("n", F.lit(MOST_SHARED)).alias("there"))
    convs = written(convs.join(lengths, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"))
    first = turns.where(F.col("at") < MOST_SHARED).withColumnRenamed("conv", "base")
    borrowed = convs.select("conv", "base", "h").join(first, "base").where("at < h").select("conv", (F.col("at") + 1).alias("depth"), "turn", "bytes")
    rest = turns.join(convs.select("conv", "h", "lent"), "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("lent") + 1).alias("depth"), "turn", "bytes")
    return borrowed.unionByName(rest), convs.select("conv", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with `name`: a number from 0 for each distinct combination of keys, without gaps."""
    ids = written(rows.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", _BITS), F.col("_id").bitwiseAND((1 << _BITS) - 1)
    sizes = ids.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_offset"))  # a row for each partition
    dense = ids.join(F.broadcast(offsets), part == F.col("_p")).select(*keys, (F.col("_offset") + place).alias(name))
    return rows.join(dense, keys)


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, node) for every conversation and every depth from 0 to its length.

    turns: (conv, depth from 1, turn), one row for each depth of a conversation; convs: (conv). Rows of equal depth have equal
    nodes if and only if their conversations agree in all turns up to there. The root is node 0 of depth 0.
    """
    blocks = written(_named(turns.select("conv", (F.col("depth") - 1).alias("q"), "turn"), ["turn"], "name").select("conv", "q", "name"))
    longest = blocks.agg(F.max("q")).first()[0]
    levels = 0 if longest is None else (longest + 1).bit_length()
    last = []  # of each depth, the block of its lowest digit
    for k in range(levels):
        last.append(blocks.where("q % 2 = 0").select("conv", ((F.col("q") + 1) * (1 << k)).alias("depth"), (F.col("q") * (1 << k)).alias("before"), "name"))
        if k + 1 < levels:
            half = lambda odd: F.max(F.when(F.col("q") % 2 == odd, F.col("name")))
            pairs = blocks.groupBy("conv", F.shiftright("q", 1).alias("q2")).agg(half(0).alias("a"), half(1).alias("b")).where("b is not null")
            blocks = written(_named(pairs, ["a", "b"], "name").select("conv", F.col("q2").alias("q"), "name"))
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"))
    out = known = root
    if last:
        ends = last[0]
        for more in last[1:]:
            ends = ends.unionByName(more)
        ends = written(ends.withColumn("digits", F.bit_count("depth")))
    for digits in range(1, levels + 1):
        now = ends.where(F.col("digits") == digits)
        if digits > 1:
            now = now.join(known.select("conv", F.col("depth").alias("before"), F.col("node").alias("prefix")), ["conv", "before"])
        else:
            now = now.withColumn("prefix", F.lit(0).cast("long"))
        known = written(_named(now, ["depth", "prefix", "name"], "node").select("conv", "depth", "node"))
        out = out.unionByName(known)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (depth, node, conv) in order: (depth, node, first, ids), RUN ids at most joined by commas."""
    for batch in batches:
        depth, node, conv = (batch.column(c).to_numpy() for c in ("depth", "node", "conv"))
        if not len(conv):
            continue
        new = np.concatenate([[True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])])
        start = np.flatnonzero(new)
        place = np.arange(len(conv)) - np.repeat(start, np.diff([*start, len(conv)]))
        cut = np.flatnonzero(place % RUN == 0)
        text = conv.astype(str).tolist()
        ids = [",".join(text[a:b]) for a, b in zip(cut, [*cut[1:], len(conv)], strict=True)]
        yield pa.record_batch([pa.array(depth[cut]), pa.array(node[cut]), pa.array(conv[cut]), pa.array(ids, pa.string())], names=["depth", "node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs in order: (depth, node, ends_sha256)."""
    at, state, done = None, None, []
    for batch in batches:
        for depth, node, ids in zip(batch.column("depth").to_pylist(), batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if at == (depth, node):
                state.update(b",")
            else:
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield _table(done)
            done = []
    if at:
        yield _table([(*at, state.hexdigest())])


def _table(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, node, digest = zip(*rows, strict=True)
    return pa.record_batch([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(digest, pa.string())], names=["depth", "node", "ends_sha256"])


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations.

    turns: (conv, depth, turn, bytes) as in `prefixes`; convs: (conv, length), turnless ones included. Columns: conv_id, the
    smallest member; depth; parent_conv_id, null at the root; n_convs; n_children; n_leaves, childless nodes in the subtree;
    saved_tokens, each node's (n_convs - 1) times the bytes of its last text, summed over the subtree; ends_sha256, of the
    conversations that end here.
    """
    rows = written(prefixes(turns, convs))
    found = written(rows.groupBy("depth", "node").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")))
    above = rows.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    texts = turns.select(F.col("conv").alias("conv_id"), "depth", "bytes")
    known = written(found.join(above, ["conv_id", "depth"], "left").join(texts, ["conv_id", "depth"], "left"))
    children = known.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    table = written(known.join(parents, ["depth", "parent"], "left").join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    saves = (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))
    owned = table.select(F.col("conv_id").alias("conv"), "depth", saves.alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    laid = range_sorted(rows.join(owned, ["conv", "depth"], "left"), ["conv"], [F.col("depth").desc()])
    sums = running(laid, ["conv"], {"saved": ("sum", F.col("saves")), "leaves": ("sum", F.col("leaf"))})
    below = sums.groupBy("depth", "node").agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))

    ends = rows.join(convs.select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select("depth", "node", "conv")
    runs = ends.repartitionByRange("depth", "node", "conv").sortWithinPartitions("depth", "node", "conv").mapInArrow(_runs, "depth long, node long, first long, ids string")
    digests = runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, ends_sha256 string")
    out = table.join(below, ["depth", "node"]).join(digests, ["depth", "node"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations rebuilt by `rebuilt`."""
    turns, convs = rebuilt(ordered_turns(conversations))
    return nodes(written(turns), convs)
