"""Benchmark decontamination: words of documents that occur in a benchmark item, and texts without them.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. A window is ten consecutive words of
an item; an item of fewer words, but not none, is one window. A document's word inside any occurrence of a window is hit.

Everything is built-in functions. The windows' distinct hashes are a broadcast set where there are at most MOST_HASHES of
them (16 bytes each), else the other side of a shuffled join. Documents' words are cut into segments of SEGMENT window starts
that overlap by a window less one word, so a long text is many bounded rows; every segment's windows are hashed and looked
up, and only those that are found carry their words on, to be compared with the windows' own (so a hash that two word
sequences share changes nothing). Hits are merged into spans by one sort for each document.

The windows' lengths that occur (ten numbers at most) and the sizes of the window table are all that reaches the driver.

Null texts have no words, as have empty ones. Documents that share an id are told apart by their text; identical rows get
the same result each. A null item_id is an item, written as the empty text; rows of the benchmark that share an item_id are
one item. Without benchmark rows nothing is hit. Columns of any name may come along with both tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.tables import written
from spotweave.llm.text import free_name

#: Words of a window.
WIDTH = 10

#: Windows that start in a segment.
SEGMENT = 512

#: Distinct hashes that are broadcast, and bytes of windows' words; beyond that both joins are shuffled.
MOST_HASHES = 2_000_000
MOST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """The words of a text; none if it is null. Only A-Z change case, whatever else has one."""
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BETWEEN), "")


def _starts(n: Column, length: int) -> Column:
    """How many windows of `length` words start in a segment of n words."""
    return F.greatest(F.lit(0), F.least(F.lit(SEGMENT), n - (length - 1)))


def _segments(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, base, part): the words from `base` on, as many as the windows that start in a segment need."""
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(SEGMENT)))
    cut = words.select(*keys, "w", F.explode_outer(starts).alias("base"))  # outer, as else Spark infers a filter and splits each text twice
    return cut.where("base is not null").select(*keys, "base", F.slice("w", F.col("base") + 1, SEGMENT + WIDTH - 1).alias("part"))


def _hashed(segments: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys, base, part, at, hash): the hashes of the windows of each length, one length's behind the other's."""
    of = lambda n: F.transform(F.sequence(F.lit(0), _starts(F.size("part"), n) - 1), lambda i: F.xxhash64(*[F.get("part", i + k) for k in range(n)]))
    none = F.array().cast("array<bigint>")
    each = [F.when(_starts(F.size("part"), n) > 0, of(n)).otherwise(none) for n in lengths]
    return segments.select(*keys, "base", "part", F.concat(*each).alias("h")).select(*keys, "base", "part", F.posexplode_outer("h").alias("at", "hash"))


def _spelled(hashed: DataFrame, keys: list[str], lengths: list[int], held: Column | None = None) -> DataFrame:
    """(keys, start, len, hash, words) of rows of `_hashed` that have the column `len`."""
    before, offset = F.lit(0), F.lit(0)
    for n in lengths:
        offset = F.when(F.col("len") == n, before).otherwise(offset)
        before = before + _starts(F.size("part"), n)
    at = F.col("at") - offset
    inside = (at >= 0) & (F.col("len") > 0) & (at + F.col("len") <= F.size("part")) & (at < SEGMENT)
    return hashed.where(inside).select(*keys, (F.col("base") + at).cast("long").alias("start"), "len", "hash", F.array_join(F.slice("part", at + 1, F.col("len")), " ").alias("words"))


def _windows(items: DataFrame) -> DataFrame:
    """(item, len, hash, words): every item's distinct windows, of rows (item, w)."""
    whole = F.least(F.size("w"), F.lit(WIDTH))
    sized = items.where("size(w) > 0").withColumn("len", whole)
    short = sized.where(F.col("len") < WIDTH)
    parts = [_segments(sized.where(F.col("len") == WIDTH), ["item"])]
    out = _spelled(_hashed(parts[0], ["item"], [WIDTH]).withColumn("len", F.lit(WIDTH)), ["item"], [WIDTH])
    for n in range(1, WIDTH):
        own = short.where(F.col("len") == n)
        out = out.unionByName(own.select("item", F.lit(0).cast("long").alias("start"), "len", F.xxhash64(*[F.get("w", F.lit(k)) for k in range(n)]).alias("hash"), F.array_join("w", " ").alias("words")))
    return out.select("item", "len", "hash", "words").distinct()


def _key(text: Column) -> Column:
    """What tells apart documents that share an id."""
    return F.md5(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Where windows occur: ((id, own, start, len, window), (window, item)).

    id and own are a document's id and the digest of its text, start the place of the window's first word. `window` numbers
    the distinct windows, items are ids as text. Repeated documents give their rows once.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), plain_words(F.col(item_text)).alias("w"))
    of_items = written(_windows(items))
    distinct = written(of_items.groupBy("len", "hash", "words").agg(F.count("*").alias("items")).withColumn("window", F.monotonically_increasing_id()))
    windows = distinct.select("len", "hash", "words", "window")
    known = windows.select("len", "hash").distinct()
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # ten at most
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()

    words = docs.select(F.col(doc_id).alias("id"), _key(F.col(text)).alias("own"), plain_words(F.col(text)).alias("w"))
    keys = ["id", "own"]
    if not lengths:
        return words.select(*keys, F.lit(0).cast("long").alias("start"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("window")).where("false"), of_items.select(F.lit(0).cast("long").alias("window"), "item").where("false")
    hashed = _hashed(_segments(words, keys), keys, lengths)
    seen = hashed.join(F.broadcast(known) if size["n"] <= MOST_HASHES else known, "hash")
    spelled = _spelled(seen, keys, lengths)
    verified = spelled.join(F.broadcast(windows) if size["bytes"] <= MOST_BYTES else windows, ["len", "hash", "words"])
    found = verified.select(*keys, "start", "len", "window").distinct()
    return written(found), of_items.join(windows, ["len", "hash", "words"]).select("window", "item").distinct()


def _spans(found: DataFrame) -> DataFrame:
    """(id, own, spans, n_hit): the words that are hit, as sorted spans [start, end) of places."""
    places = found.groupBy("id", "own", "start").agg((F.col("start") + F.max("len")).alias("end"))
    order = Window.partitionBy("id", "own").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = places.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("id", "own", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("id", "own").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))


def _items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(id, own, n_items, items_sha256): lists of items are made once for all documents with the same windows."""
    sets = written(found.groupBy("id", "own").agg(F.array_sort(F.collect_set("window")).alias("windows")))
    each = sets.select("windows").distinct().select("windows", F.explode("windows").alias("window")).join(items, "window").select("windows", "item").distinct()
    lists = each.groupBy("windows").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    return sets.join(lists, "windows").drop("windows")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    items_sha256 is the digest of the ids of the items with occurring windows, sorted as strings and joined by commas.
    """
    found, items = occurrences(docs, benchmark, doc_id, text)
    counts = _spans(found).select("id", "own", "n_hit").join(_items(found, items).withColumnsRenamed({"id": "i", "own": "o"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("o"))).drop("i", "o")
    every = docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(text)).alias("mine"), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _BETWEEN), "")).cast("long").alias("n_words"))
    joined = every.join(counts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mine") == F.col("own")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without what they share with the benchmark, in their own columns.

    remove="documents": without the documents that have a hit word. remove="spans": the hit words go, each with what stands
    between it and the next word; everything else, case and spacing included, stays as it is.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove!r}")
    found, _ = occurrences(docs, benchmark, doc_id, text)
    spans = _spans(found)
    names = [free_name(docs.columns, n) for n in ("_id", "_own", "_spans", "_mine", "_pieces", "_first")]
    i, own, held, mine, pieces, first = names
    keyed = docs.withColumn(mine, _key(F.col(text)))
    marks = spans.select(F.col("id").alias(i), F.col("own").alias(own), F.col("spans").alias(held))
    same = F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(mine) == F.col(own))
    if remove == "documents":
        return keyed.join(marks, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    joined = keyed.join(marks, same, "left")
    between = F.split(F.col(text), _WORD)
    cut = joined.withColumn(first, F.get(between, F.lit(0))).withColumn(pieces, F.zip_with(F.array_remove(F.split(F.col(text), _BETWEEN), ""), F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(1))), lambda a, b: F.concat(a, b)))
    edges = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.transform(held, lambda x: x["end"])).alias("a"), F.concat(F.transform(held, lambda x: x["start"]), F.array(F.size(pieces).cast("long"))).alias("b"))
    kept = F.array_join(F.transform(edges, lambda e: F.array_join(F.slice(pieces, (e["a"] + 1).cast("int"), (e["b"] - e["a"]).cast("int")), "")), "")
    cleaned = F.when(F.col(held).isNull(), F.col(text)).otherwise(F.concat(F.col(first), kept))
    return cut.withColumn(text, cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])
