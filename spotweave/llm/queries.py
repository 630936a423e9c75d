"""The operators over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import chat_quotes, decontaminate, fingerprints, langid, line_dedup, lm_scoring, mixing, neardup, packing, prefix_trie, sharding, topk, whitening
from spotweave.session import ship


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, slot, shard and shard_name of every document."""
    return sharding.assign(_table(spark, folder, "documents").select("doc_id"), "doc_id")


def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated lines, with the numbers of its lines and of those removed."""
    return line_dedup.dedup_lines(_table(spark, folder, "documents"))


def op4_chat_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return chat_quotes.link_quotes(_table(spark, folder, "conversations"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op6_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, folder, "documents"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(_table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.mix(_table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", F.col("target"), "taken")


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, folder, "conversations"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_exact_topk, op3_line_dedup, op4_chat_quotes, op5_language_id, op6_minhash_neardup, op7_packing, op8_fingerprints, op9_lm_scoring, op10_mixing, op11_decontamination, op12_prefix_trie, op13_whitening)
}

_TOPK = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * CAST(e AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_NEARDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d),
c AS (SELECT d, min(m) AS m FROM r GROUP BY d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.d = w.doc_id
"""

_DECONTAMINATION = r"""
WITH x AS (SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS l, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda s: array_to_string(w[s:s + least(10, len(w)) - 1], ' '))) AS t FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT k, l, unnest(list_transform(range(1, len(w) - l + 2), lambda s: {'s': s, 't': array_to_string(w[s:s + l - 1], ' ')})) AS o FROM d, g),
h AS (SELECT dw.k, dw.l, dw.o.s AS s, dw.o.t AS t FROM dw WHERE dw.o.t IN (SELECT t FROM iw)),
v AS (SELECT DISTINCT h.k, h.l, h.s, iw.item FROM h JOIN iw ON iw.t = h.t AND iw.l = h.l),
p AS (SELECT k, count(DISTINCT w) AS n FROM (SELECT k, unnest(range(s, s + l)) AS w FROM (SELECT DISTINCT k, l, s FROM v)) GROUP BY k),
m AS (SELECT k, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT k, item FROM v) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, coalesce(m.sha, sha256('')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.k = d.k LEFT JOIN m ON m.k = d.k
"""

_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: ascii(y)::BIGINT),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

_TRIE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, c - c % 5 AS b, {_CRC32.replace('conv_id', 'c')} % 9 AS h FROM t GROUP BY c),
m AS (SELECT n.*, least(n.h, coalesce(o.n, 0)) AS lent FROM n LEFT JOIN n o ON o.c = n.b),
u AS (SELECT m.c, t.p + 1 AS d, t.r, t.x FROM m JOIN t ON t.c = m.b AND t.p < m.h UNION ALL SELECT m.c, t.p - m.h + m.lent + 1, t.r, t.x FROM m JOIN t ON t.c = m.c AND t.p >= m.h),
w AS (SELECT c, d, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d) AS k, x FROM u UNION ALL SELECT c, 0, [], '' FROM m),
e AS (SELECT c, max(d) AS e FROM w GROUP BY c),
g AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(strlen(x)) AS b, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (e.e = d) AS ends FROM w JOIN e USING (c) GROUP BY d, k),
a AS (SELECT g.*, (SELECT min(o.c) FROM w o WHERE o.d = g.d - 1 AND o.k = g.k[1:g.d - 1]) AS pc FROM g),
ch AS (SELECT pc, d - 1 AS d, count(*) AS n FROM a WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT a.*, coalesce(ch.n, 0) AS ch FROM a LEFT JOIN ch ON ch.pc = a.c AND ch.d = a.d),
z AS (SELECT w.k, w.d, sum(s.n * s.b - s.b) AS saved, count(*) FILTER (s.ch = 0) AS leaves FROM w JOIN s ON s.c = w.c AND s.d >= w.d GROUP BY w.k, w.d)
SELECT s.c AS conv_id, CAST(s.d AS BIGINT) AS depth, s.pc AS parent_conv_id, s.n AS n_convs, CAST(s.ch AS BIGINT) AS n_children, z.leaves AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
FROM s JOIN z ON z.k = s.k AND z.d = s.d
"""


def _mixing_sql(documents: str = "documents") -> str:
    draws = ", ".join(f"CAST(('0x' || substr(md5('{i // 4}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {1 + 8 * (i % 4)}, 8)) AS BIGINT) / 4294967296.0" for i in range(mixing.SEEDS))
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, [{draws}] AS u FROM {documents}),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t),
a AS (SELECT *, sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight,
        row_number() OVER (ORDER BY source_size * 3 / weight, source IS NULL, source) AS place
      FROM o WINDOW b AS (ORDER BY source_size * 3 / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by({{'rest': rest, 'w': rest_weight, 'place': place}}, place) AS f FROM a WHERE source_size * 3 * rest_weight >= rest * weight),
g AS (SELECT source, source_size, CASE WHEN place < f.place THEN CAST(source_size * 3 AS DOUBLE) ELSE CAST(f.rest AS DOUBLE) * weight / f.w END AS target FROM a, f),
x AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT source, i, abs(sum(CASE WHEN u[i] < rate - floor(rate) THEN size ELSE 0 END) - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS miss
      FROM x, range(1, {mixing.SEEDS + 1}) r(i) GROUP BY source, i),
h AS (SELECT source, min_by(i, miss * 100000 + i) AS i FROM (SELECT source, i, miss, row_number() OVER (PARTITION BY source ORDER BY miss, i) AS k FROM e) WHERE k = 1 GROUP BY source)
SELECT x.doc_id, x.size, x.source_size, x.target, CAST((floor(rate) + CASE WHEN u[h.i] < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM x JOIN h ON x.source IS NOT DISTINCT FROM h.source
"""


ORACLE_SQL: dict[str, str] = {"op2_exact_topk": _TOPK, "op6_minhash_neardup": _NEARDUP, "op10_mixing": _mixing_sql(), "op11_decontamination": _DECONTAMINATION, "op12_prefix_trie": _TRIE}
