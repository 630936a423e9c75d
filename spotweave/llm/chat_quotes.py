"""Quotation linking in chats: quote levels, hashed passages, originals, and conversations in reply order.

A line's quote level is the number of `>` at its start (spaces between them don't count). A message's passages
are its runs of lines of one level above 0; the rest, without blank lines at its ends, is its own text. A
passage and each of its lines are units, in a normal form (lower case, letters and digits, single spaces)
of at least MIN_CHARS characters; a message's own text, its paragraphs and its lines are units, too.

A passage's original is the message whose own text has the passage's longest unit that any has: in the same
conversation the earliest turn, if that is before the quoting one; else the least (conversation, turn) of all others.
A message replies to the original of its longest level-1 passage, if that is in its conversation; else to the
preceding turn number; else (no such turn) it starts a thread. Ordering a conversation by thread, depth and turn
puts every message after what it replies to.

Units are aggregated to one original each before the join, so it has one row for each unit quoted, and a first
turn that many conversations share is one row. Depths come by pointer doubling: a join for each doubling of the
longest reply chain, by (conversation, turn).

Null texts are empty and have no quotes. Null conversations or turns: such messages start threads and are no
originals. Rows that repeat a (conversation, turn) stay rows; links go to the turn. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.tables import written
from spotweave.llm.text import SLICE_BYTES, slices

MIN_CHARS = 12
_PREFIX = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own text, and its passages as (level, lines)."""
    own, passages, last = [], [], 0
    for line in text.split("\n"):
        found = _PREFIX.match(line)
        level = found[0].count(">") if found else 0
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(line[found.end() :])
        else:
            passages.append((level, [line[found.end() :]]))
        last = level
    return "\n".join(own).strip("\n") if passages else text, passages


def _units(texts: list[str]) -> list[tuple[int, int]]:
    """(hash, characters) of the distinct units among texts that are long enough."""
    found = {u for u in map(normal, texts) if len(u) >= MIN_CHARS}
    return sorted((xxhash.xxh3_64_intdigest(u) - (1 << 63), len(u)) for u in found)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = pa.struct([("hash", pa.int64()), ("chars", pa.int64())])
    passage = pa.struct([("passage", pa.int64()), ("level", pa.int64()), ("units", pa.list_(unit))])
    for batch in slices(batches, "text", SLICE_BYTES):
        clean, own, quotes = [], [], []
        for text in batch.column("text").to_pylist():
            body, passages = parse(text or "")
            clean.append(body)
            own.append([{"hash": h, "chars": n} for h, n in _units([body, *re.split(r"\n\s*\n", body), *body.split("\n")])])
            quotes.append([{"passage": i, "level": level, "units": [{"hash": h, "chars": n} for h, n in _units(["\n".join(lines), *lines])]} for i, (level, lines) in enumerate(passages)])
        rest = [batch.column(c) for c in ("conv_id", "turn", "role", "row")]
        yield pa.record_batch([*rest, pa.array(clean, pa.string()), pa.array(own, pa.list_(unit)), pa.array(quotes, pa.list_(passage))], names=["conv_id", "turn", "role", "row", "clean", "own", "quotes"])


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, role, clean_text, quote_levels, n_passages, n_linked, quoted_conv, quoted_turn, reply_to, thread, depth."""
    unit = "struct<hash:long,chars:long>"
    source = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    parsed = written(source.mapInArrow(_parsed, f"conv_id long, turn long, role string, row long, clean string, own array<{unit}>, quotes array<struct<passage:long,level:long,units:array<{unit}>>>"))

    said = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own.hash").alias("hash"))
    passages = parsed.where(F.size("quotes") > 0).select("row", "conv_id", "turn", F.explode("quotes").alias("q"))
    units = written(passages.select("row", "conv_id", "turn", "q.passage", "q.level", F.explode("q.units").alias("u")).select("row", "conv_id", "turn", "passage", "level", "u.hash", "u.chars"))
    asked = units.select("hash").distinct()
    said = said.join(asked, "hash", "left_semi")
    here = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("h_turn"))
    # The two least conversations: where the first is the quoting one, the second holds the outside original.
    place = F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))
    firsts = here.withColumn("place", place).where("place <= 2")
    least = firsts.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("conv_id", F.col("h_turn").alias("turn")))).alias("g"))
    near = units.join(here, ["conv_id", "hash"], "left").join(least, "hash", "left")
    inside = F.when(F.col("h_turn") < F.col("turn"), F.struct(F.col("conv_id").alias("conv_id"), F.col("h_turn").alias("turn")))
    outside = F.get(F.filter("g", lambda x: ~x["conv_id"].eqNullSafe(F.col("conv_id"))), F.lit(0))
    found = near.withColumn("original", F.coalesce(inside, outside)).where("original is not null")
    best = found.groupBy("row", "passage", "level").agg(F.max_by("original", F.struct("chars", "hash")).alias("original"), F.max("chars").alias("chars"))
    direct = (F.col("level") == 1)
    linked = best.groupBy("row").agg(F.count("*").alias("n_linked"), F.max_by(F.when(direct, F.col("original")), F.struct(direct.cast("int"), F.col("chars"), -F.col("passage"))).alias("original"))

    rows = parsed.join(linked, "row", "left").select(
        "row", "conv_id", "turn", "role", F.col("clean").alias("clean_text"), F.coalesce(F.array_max("quotes.level"), F.lit(0)).alias("quote_levels"), F.size("quotes").cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("original.conv_id").alias("quoted_conv"), F.col("original.turn").alias("quoted_turn"),
    )
    turns = parsed.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn")).distinct()
    want = F.when(F.col("quoted_conv") == F.col("conv_id"), F.col("quoted_turn")).otherwise(F.col("turn") - 1)
    rows = rows.withColumn("want", want).join(turns, (F.col("conv_id") == F.col("p_conv")) & (F.col("want") == F.col("p_turn")), "left")
    rows = written(rows.select(*[c for c in rows.columns if c != "want"], F.col("p_turn").alias("reply_to")))

    # (conv_id, turn) -> an ancestor and its distance; each round doubles the distance of the turns that have not met
    # their thread's first turn yet, and only those.
    at = rows.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up"))
    at = written(at.select("conv_id", "turn", F.coalesce("up", "turn").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("arrived")))
    arrived, going = at.where("arrived"), at.where("not arrived")
    while not going.isEmpty():
        above = arrived.unionByName(going).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("arrived").alias("arrived2"))
        step = going.join(above, ["conv_id", "up"]).select("conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("arrived2").alias("arrived"))
        step = written(step)
        arrived, going = arrived.unionByName(step.where("arrived")), step.where("not arrived")
    at = arrived.drop("arrived")
    return rows.join(at, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "clean_text", "quote_levels", "n_passages", "n_linked", "quoted_conv", "quoted_turn", "reply_to", F.coalesce("up", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")
    )
