"""DuckDB SQL for the queries, over the driver's views."""

from __future__ import annotations

from spotweave.plans import oracle_histograms as H
from spotweave.plans.oracle_reads import ERFC, read_features

_B = "ATCG"

_EVENTS = """ev AS (SELECT *, substr('ATCG', CAST(1 + site % 4 AS INT), 1) AS ref,
  CASE WHEN is_alt THEN substr('ATCG', CAST(1 + (site + 1 + (o % 97) // 90) % 4 AS INT), 1) ELSE substr('ATCG', CAST(1 + site % 4 AS INT), 1) END AS base
  FROM (SELECT l_partkey % 60 AS site, 'chr' || CAST(1 + (l_partkey % 60) % 3 AS VARCHAR) AS chrom, 1000 + 4 * (l_partkey % 60) AS pos, 'BC' || CAST(l_orderkey % 50 AS VARCHAR) AS barcode,
    CAST(l_suppkey % 10 AS VARCHAR) AS umi, l_orderkey AS o, 20 + CAST(trunc(l_quantity) AS INT) % 21 AS qual, l_linestatus = 'O' AS is_reverse, l_orderkey * 10 + l_linenumber AS read_id,
    (l_orderkey * 31 + l_linenumber * 17 + l_suppkey * 7) % 97 < CASE WHEN (l_partkey % 60) % 12 = 11 THEN 48 ELSE (l_partkey % 60) % 12 END AS is_alt FROM lineitem)),
bc AS (SELECT 'BC' || CAST(i AS VARCHAR) AS barcode, CAST(i % 4 AS VARCHAR) AS cluster, i % 10 AS x, i // 10 AS y FROM range(50) t(i))"""

_SITES = _EVENTS + ", st AS (SELECT chrom, pos, ref, " + ", ".join(f"count(*) FILTER (base = '{b}') AS n{b}" for b in _B) + ", count(*) AS depth FROM ev GROUP BY ALL)"
_ALLELES = _SITES + """, rk AS (SELECT s.chrom, s.pos, s.ref, s.depth, b.base, b.n, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY b.base <> ref, b.n DESC, b.i) AS k
  FROM st s, LATERAL (VALUES ('A', nA, 0), ('T', nT, 1), ('C', nC, 2), ('G', nG, 3)) b(base, n, i)),
al AS (SELECT chrom, pos, ref, any_value(depth) AS depth, """ + ", ".join(f"max(base) FILTER (k = {k}) AS allele{k}, max(n) FILTER (k = {k}) AS count{k}" for k in range(1, 5)) + " FROM rk GROUP BY ALL)"

_UMI = _EVENTS + ", um AS (SELECT chrom, pos, ref, barcode, umi, " + ", ".join(f"count(*) FILTER (base = '{b}') AS n{b}, coalesce(sum(ln(greatest(1 - pow(10, -qual / 10.0), 1e-12))) FILTER (base = '{b}'), 0) AS r{b}, coalesce(sum(-qual / 10.0 * ln(10.0)) FILTER (base = '{b}'), 0) AS e{b}" for b in _B) + """,
  count(*) AS reads, count(*) FILTER (is_reverse) AS reverse, CASE WHEN count(*) FILTER (NOT is_reverse) > count(*) FILTER (is_reverse) THEN '+' ELSE '-' END AS strand FROM ev GROUP BY chrom, pos, ref, barcode, umi)"""


def _like(b: str) -> str:
    o = [h for h in _B if h != b]
    pcr = {h: f"pow(10.0, -6.0 * (n{h} + 0.5) / (reads + 2))" for h in _B}
    return f"CASE WHEN n{b} > 0 THEN 0.5 * pow(1 - 1e-6, 100) * exp(r{b} + e{o[0]} + e{o[1]} + e{o[2]}) + 0.5 * rp * least({pcr[o[0]]}, {pcr[o[1]]}, {pcr[o[2]]}) ELSE rp * {pcr[o[0]]} * {pcr[o[1]]} * {pcr[o[2]]} END"


def _phred(b: str) -> str:
    miss = "(" + " + ".join(f"l{h}" for h in _B if h != b) + ") / (lA + lT + lC + lG)"
    return f"CASE WHEN lA + lT + lC + lG <= 0 THEN 0 WHEN {miss} < 1e-16 THEN 40 ELSE CAST(ceil(round(-log10({miss}) * 10, 9)) AS INT) END AS p{b}"


_CONS = (
    _UMI
    + ", rp AS (SELECT *, exp(" + " + ".join(f"CASE WHEN n{b} > 0 THEN r{b} ELSE 0 END" for b in _B) + ") AS rp FROM um)"
    + ", lk AS (SELECT *, " + ", ".join(f"{_like(b)} AS l{b}" for b in _B) + " FROM rp)"
    + ", ph AS (SELECT *, " + ", ".join(_phred(b) for b in _B) + " FROM lk)"
    + """, cs AS (SELECT *, greatest(pA, pT, pC, pG) AS phred, CASE WHEN CASE ref WHEN 'A' THEN pA WHEN 'T' THEN pT WHEN 'C' THEN pC ELSE pG END = greatest(pA, pT, pC, pG) THEN ref
  WHEN pA = greatest(pA, pT, pC, pG) THEN 'A' WHEN pT = greatest(pA, pT, pC, pG) THEN 'T' WHEN pC = greatest(pA, pT, pC, pG) THEN 'C' ELSE 'G' END AS allele FROM ph)"""
)
_CLUS = _CONS + ", cl AS (SELECT chrom, pos, ref, cluster, count(DISTINCT barcode) AS spot_number, " + ", ".join(f"count(*) FILTER (allele = '{b}' AND phred >= 20) AS n{b}" for b in _B) + " FROM cs JOIN bc USING (barcode) GROUP BY chrom, pos, ref, cluster)"
_IND = _CLUS + ", ind AS (SELECT chrom, pos, ref, CAST(sum(spot_number) AS BIGINT) AS spot_number, " + ", ".join(f"CAST(sum(n{b}) AS BIGINT) AS n{b}" for b in _B) + " FROM cl GROUP BY chrom, pos, ref)"
_MUT = _IND + """, mu AS (SELECT chrom, pos, ref, arg_min(b.base, b.i - 10 * b.n) AS mutant, max(b.n) AS alt_count, any_value(nA + nT + nC + nG) AS depth, any_value(spot_number) AS spot_number
  FROM ind, LATERAL (VALUES ('A', nA, 0), ('T', nT, 1), ('C', nC, 2), ('G', nG, 3)) b(base, n, i) WHERE b.base <> ref AND b.n > 0 GROUP BY chrom, pos, ref)"""
_VAR = _MUT + """, va AS (SELECT chrom, pos, ref, mutant AS alt, spot_number, alt_count, depth, substr('ATCG', CAST((pos + 1) % 4 + 1 AS INT), 1) AS up, substr('ATCG', CAST((pos + 2) % 4 + 1 AS INT), 1) AS down FROM mu)"""
_COUNT = "CASE mutant WHEN 'A' THEN nA WHEN 'T' THEN nT WHEN 'C' THEN nC ELSE nG END"
_SPOT = _MUT + ", sp AS (SELECT chrom, pos, ref, barcode, " + ", ".join(f"count(*) FILTER (allele = '{b}') AS n{b}, CAST(coalesce(sum(phred) FILTER (allele = '{b}'), 0) AS BIGINT) AS q{b}" for b in _B) + f""" FROM cs GROUP BY chrom, pos, ref, barcode),
ss AS (SELECT sp.chrom, sp.pos, sp.barcode, cluster, x, y, nA + nT + nC + nG AS depth, {_COUNT} AS alt, ({_COUNT}) / (nA + nT + nC + nG) AS vaf FROM sp JOIN mu ON sp.chrom = mu.chrom AND sp.pos = mu.pos JOIN bc USING (barcode))"""
_DENSE = _EVENTS + ", ds AS (SELECT DISTINCT chrom, 1000 + 2 * site + 15 * (site // 10) AS pos FROM ev)"
_GENES = """gn AS (SELECT 'chr' || CAST(1 + p_partkey % 4 AS VARCHAR) AS chrom, 990 + 260 * (p_partkey // 120) + (p_partkey * 37) % 260 AS "start", 990 + 260 * (p_partkey // 120) + (p_partkey * 37) % 260 + 3 + p_size % 17 AS "end", 'G' || CAST(p_partkey AS VARCHAR) AS gene FROM part)"""
_SESS = _DENSE + """, sn AS (SELECT chrom, session, min(pos) AS "start", max(pos) AS "end", count(*) AS sites FROM (SELECT chrom, pos, CAST(sum(n) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 10 THEN 0 ELSE 1 END AS n FROM ds)) GROUP BY chrom, session)"""
_HIST = _MUT + f""", ll AS (SELECT cs.chrom, cs.pos, cs.ref, mutant AS alt, count(*) FILTER (allele = cs.ref) AS r, count(*) FILTER (allele = mutant) AS a,
  coalesce(sum(ln(greatest(1 - pow(10, -phred / 10.0), 1e-12))) FILTER (allele = cs.ref), 0) AS rr, coalesce(sum(ln(pow(10, -phred / 10.0))) FILTER (allele = cs.ref), 0) AS rw,
  coalesce(sum(ln(greatest(1 - pow(10, -phred / 10.0), 1e-12))) FILTER (allele = mutant), 0) AS ar, coalesce(sum(ln(pow(10, -phred / 10.0))) FILTER (allele = mutant), 0) AS aw,
  coalesce(sum(CASE WHEN allele = cs.ref THEN pow(10, -phred / 10.0) WHEN allele = mutant THEN 1 - pow(10, -phred / 10.0) END), 0) AS ea
  FROM cs JOIN mu ON cs.chrom = mu.chrom AND cs.pos = mu.pos WHERE phred >= 20 GROUP BY ALL),
lh AS (SELECT *, (ch + rr + aw) / ln(10) AS l_refhom, (ch + rw + ar) / ln(10) AS l_althom, (ch - (r + a) * ln(2)) / ln(10) AS l_het, (ch + lgamma(ea + 1) + lgamma(r + a - ea + 1) - lgamma(r + a + 2.0)) / ln(10) AS l_mosaic
  FROM (SELECT *, lgamma(r + a + 1.0) - lgamma(a + 1.0) - lgamma(r + 1.0) AS ch FROM ll))"""


def _w(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{ctes} {select}"


def _sf(k: str, n: str, p: str) -> str:
    """P(X >= k) of a binomial, by a correlated sum."""
    return f"CASE WHEN {k} <= 0 THEN 1.0 WHEN {k} > {n} THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - ({p})))))) END"


_DEPTH = "(nA + nT + nC + nG)"
_FILTERED = _CLUS + ", fk AS (SELECT *, " + ", ".join(f"coalesce(bool_or(n{b} > 0 AND {_sf(f'n{b}', _DEPTH, '0.003')} < 0.05) OVER (PARTITION BY chrom, pos), false) AS k{b}" for b in _B) + " FROM cl)"
_COMP = lambda x: f"translate({x}, 'ATCG', 'TAGC')"
_RNA = f"CASE WHEN pos % 8 = 0 THEN {_COMP('down')} || '[' || {_COMP('ref')} || '>' || {_COMP('alt')} || ']' || {_COMP('up')} ELSE up || '[' || ref || '>' || alt || ']' || down END"
_SPEC = _VAR + f""", ct AS (SELECT row_number() OVER (ORDER BY r, a, u, d) - 1 AS place, u || '[' || r || '>' || a || ']' || d AS context FROM (VALUES ('A'),('C'),('G'),('T')) t1(r), (VALUES ('A'),('C'),('G'),('T')) t2(a), (VALUES ('A'),('C'),('G'),('T')) t3(u), (VALUES ('A'),('C'),('G'),('T')) t4(d) WHERE r <> a),
sc AS (SELECT place, ct.context, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ct LEFT JOIN (SELECT {_RNA} AS context, count(*) AS n FROM va GROUP BY 1) m ON m.context = ct.context)"""
_FIT = f"""er AS (SELECT {_RNA.replace('alt', 'alt1')} AS context FROM (SELECT chrom, pos, ref, allele2 AS alt1, substr('ATCG', CAST((pos + 1) % 4 + 1 AS INT), 1) AS up, substr('ATCG', CAST((pos + 2) % 4 + 1 AS INT), 1) AS down FROM al WHERE depth >= 100 AND count1 / depth >= 0.95 AND count2 >= 5)),
cx AS (SELECT place, context FROM (SELECT (r * 3 + a - CASE WHEN a > r THEN 1 ELSE 0 END) * 16 + u * 4 + d AS place, substr('ACGT', u + 1, 1) || '[' || substr('ACGT', r + 1, 1) || '>' || substr('ACGT', a + 1, 1) || ']' || substr('ACGT', d + 1, 1) AS context
  FROM range(4) t1(r), range(4) t2(a), range(4) t3(u), range(4) t4(d) WHERE a <> r)),
sg AS (SELECT context, sum(p_size * CASE WHEN substr(context, 3, 1) = 'A' THEN 9 ELSE 1 END) AS s1, sum(p_size % 11 * CASE WHEN substr(context, 3, 1) = 'C' THEN 9 ELSE 1 END) AS s2, sum(p_size * 7 % 13) AS s3 FROM part JOIN cx ON place = p_partkey % 192 GROUP BY context),
sn2 AS (SELECT sg.context, s1 / sum(s1) OVER () AS s1, s2 / sum(s2) OVER () AS s2, s3 / sum(s3) OVER () AS s3, (SELECT count(*) FROM er WHERE er.context = sg.context) / (SELECT count(*) FROM er) AS t FROM sg),
gm AS (SELECT sum(s1*s1) AS g11, sum(s1*s2) AS g12, sum(s1*s3) AS g13, sum(s2*s2) AS g22, sum(s2*s3) AS g23, sum(s3*s3) AS g33, sum(s1*t) AS b1, sum(s2*t) AS b2, sum(s3*t) AS b3 FROM sn2),
st2 AS (SELECT 0 AS i, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3 UNION ALL
  SELECT i + 1, greatest(0, v1 - th), greatest(0, v2 - th), greatest(0, v3 - th) FROM (
    SELECT *, greatest(0, greatest(v1, v2, v3) - 1, (greatest(v1, 0) + greatest(v2, 0) + greatest(v3, 0) - least(greatest(v1, 0), greatest(v2, 0), greatest(v3, 0)) - 1) / 2, (greatest(v1, 0) + greatest(v2, 0) + greatest(v3, 0) - 1) / 3) AS th FROM (
      SELECT i, w1 + (b1 - g11*w1 - g12*w2 - g13*w3) / (g11+g22+g33) AS v1, w2 + (b2 - g12*w1 - g22*w2 - g23*w3) / (g11+g22+g33) AS v2, w3 + (b3 - g13*w1 - g23*w2 - g33*w3) / (g11+g22+g33) AS v3 FROM st2, gm WHERE i < 4000))),
wt AS (SELECT CASE WHEN w1 >= 0.06 THEN w1 ELSE 0 END AS w1, CASE WHEN w2 >= 0.06 THEN w2 ELSE 0 END AS w2, CASE WHEN w3 >= 0.06 THEN w3 ELSE 0 END AS w3 FROM st2 WHERE i = 4000),
rw AS (SELECT context, w1 * s1 + w2 * s2 + w3 * s3 AS mixed FROM sn2, wt)"""
_BB = "greatest(0, 1 - list_sum(list_transform(range(0, CAST(alt_count AS BIGINT)), lambda i: exp(lgamma(depth + 1.0) - lgamma(i + 1.0) - lgamma(depth - i + 1.0) + lgamma(i + 0.107) + lgamma(depth - i + 47.58) - lgamma(depth + 0.107 + 47.58) - lgamma(0.107) - lgamma(47.58) + lgamma(0.107 + 47.58)))))"
_RULES = _VAR + """, ru AS (SELECT *, coalesce(nullif(concat_ws(';', CASE WHEN alt_count < 3 THEN 'ALT_ALLELE_COUNT' END, CASE WHEN alt_count / depth < 0.01 THEN 'LOW_VAF' END, CASE WHEN alt_count / depth > 0.3 THEN 'HIGH_VAF' END,
  CASE WHEN spot_number < 30 THEN 'LOW_SPOT_NUM' END, CASE WHEN pos % 20 = 0 THEN 'CLUSTER_EVENTS' END), ''), 'PASS') AS filter FROM va)"""
_GERM = "ge AS (SELECT 'chr' || CAST(1 + p_partkey % 4 AS VARCHAR) AS chrom, p_partkey AS pos, p_size % 5 <> 0 AS het, p_partkey * 7 % 60 AS count1, p_partkey * 13 % 60 AS count2, p_partkey % 9 / 10 AS prior1, p_partkey % 7 / 10 AS prior2 FROM part)"
_MOSAIC = """mz AS (SELECT chrom, pos, ref, (pos - 1000) // 80 AS region, CASE WHEN het THEN [ref, allele2] ELSE [ref] END AS germ, CASE WHEN het THEN allele3 ELSE allele2 END AS mutant, het FROM (SELECT *, count2 / depth >= 0.3 AS het FROM al) WHERE CASE WHEN het THEN count3 ELSE count2 END > 0)"""
_CROSS = _CONS + _ALLELES[len(_EVENTS) :] + ", " + _MOSAIC + ", cr AS (SELECT a.chrom, a.region, a.pos, b.pos AS snp_pos FROM mz a JOIN mz b ON a.chrom = b.chrom AND a.region = b.region AND b.het AND a.pos <> b.pos)"
_HAPLO = _CROSS + ", ha AS (SELECT cr.chrom, cr.pos, snp_pos, m.allele AS base, g.allele AS snp_base, count(*) AS n FROM cr JOIN cs m ON m.chrom = cr.chrom AND m.pos = cr.pos AND m.phred >= 20 JOIN cs g ON g.chrom = cr.chrom AND g.pos = snp_pos AND g.barcode = m.barcode AND g.umi = m.umi AND g.phred >= 20 GROUP BY ALL)"

# Of 100 tosses, 40 to 60 heads have a two-sided p above .05.
_GATE = _HAPLO + """, hs AS (SELECT chrom, pos, snp_pos, snp_base, sum(n) AS n, instr('ATCG', snp_base) AS i FROM ha GROUP BY ALL), hr AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, snp_pos ORDER BY n DESC, i) AS k, sum(n) OVER (PARTITION BY chrom, pos, snp_pos) AS dp FROM hs),
gt AS (SELECT chrom, pos, snp_pos, max(snp_base) FILTER (k = 1) AS h1, max(snp_base) FILTER (k = 2) AS h2, CAST(any_value(dp) AS BIGINT) AS dp, count(*) FILTER (k <= 2 AND ceil(100 * n / dp) BETWEEN 40 AND 60) = 2 AS balanced FROM hr GROUP BY chrom, pos, snp_pos)"""
_CELLS = ", ".join(f"CAST(coalesce(sum(n) FILTER (base = {x} AND snp_base = {h}), 0) AS BIGINT) AS {c}{h}" for c, x in (("g1", "germ[1]"), ("g2", "germ[2]"), ("m", "mutant")) for h in ("h1", "h2"))
_PHASE = _GATE + f""", pa AS (SELECT ha.chrom, ha.pos, ha.snp_pos, germ, mutant, {_CELLS} FROM ha JOIN gt USING (chrom, pos, snp_pos) JOIN mz ON mz.chrom = ha.chrom AND mz.pos = ha.pos WHERE balanced AND h2 IS NOT NULL GROUP BY ALL),
pd AS (SELECT *, g1h1 + g1h2 + g2h1 + g2h2 + mh1 + mh2 AS dp, mh1 + mh2 AS mut_allele FROM pa WHERE mh1 + mh2 > 0),
pc AS (SELECT *, CASE len(germ)
  WHEN 1 THEN CASE WHEN ((g1h1 > 5 * g1h2 AND mh2 > 5 * mh1) OR (g1h2 > 5 * g1h1 AND mh1 > 5 * mh2)) AND dp > 4 THEN 2
    WHEN NOT (g1h1 > 5 * g1h2 OR g1h2 > 5 * g1h1) AND (mh2 > 5 * mh1 OR mh1 > 5 * mh2) AND mut_allele >= 2 AND ((g1h1 > g1h2 AND mh1 < mh2) OR (g1h2 > g1h1 AND mh2 < mh1)) THEN 3 ELSE 4 END
  WHEN 2 THEN CASE WHEN NOT ((g1h1 > 5 * g1h2 AND g2h2 > 5 * g2h1) OR (g1h2 > 5 * g1h1 AND g2h1 > 5 * g2h2)) OR mut_allele < 2 THEN 4 WHEN mh1 > 5 * mh2 OR mh2 > 5 * mh1 THEN 3 ELSE 4 END END AS haplo FROM pd)"""

_POP = "po AS (SELECT 'chr' || CAST(1 + p_partkey % 60 % 3 AS VARCHAR) AS chrom, 1000 + 4 * (p_partkey % 60) AS pos, substr('ATCG', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substr('ATCG', CAST(1 + (p_partkey + 1 + p_size % 3) % 4 AS INT), 1) AS alt, p_size / 100 AS af FROM part)"
_OTHER = " + ".join(f"CASE WHEN ref = '{b}' THEN 0 ELSE coalesce(g{b}, 0) END" for b in _B)
_PRIOR = _POP + f""", p0 AS (SELECT chrom, pos, ref, {", ".join(f"max(af) FILTER (alt = '{b}') AS g{b}" for b in _B)} FROM po WHERE EXISTS (SELECT 1 FROM st WHERE st.chrom = po.chrom AND st.pos = po.pos AND st.ref = po.ref) GROUP BY ALL),
pr AS (SELECT chrom, pos, {", ".join(f"CASE WHEN ref = '{b}' THEN 1 - other * scale ELSE coalesce(g{b}, 0) * scale END AS f{b}" for b in _B)} FROM (SELECT *, CASE WHEN other > 1 THEN 0.99 / other ELSE 1 END AS scale FROM (SELECT *, {_OTHER} AS other FROM p0)))"""
_FREQ = lambda x: "coalesce(nullif(CASE " + x + " " + " ".join(f"WHEN '{b}' THEN f{b}" for b in _B) + " END, 0), 1e-5)"

_KEPT = _CONS + ", " + H.kept(_sf("n", "d", "0.003")) + H.INDIVIDUAL
_GENO = _KEPT + _SITES[len(_EVENTS) :] + ", " + _PRIOR + H.genotypes(_FREQ("base"), 250)

_CELLN = "tt AS (SELECT barcode, cluster, count(DISTINCT chrom || '_' || pos || '_' || umi) AS n_umi FROM ev JOIN bc USING (barcode) GROUP BY ALL), md AS (SELECT quantile_cont(n_umi, 0.5) AS m FROM tt GROUP BY cluster ORDER BY sum(n_umi) DESC, cluster DESC LIMIT 1), cn AS (SELECT barcode, CAST(CASE WHEN m > 0 THEN least(25, ceil(round(20 * n_umi / m, 9))) ELSE 1 END AS BIGINT) AS number FROM tt, md)"

ORACLE_SQL: dict[str, str] = {
    "umi_histogram": _w(_EVENTS + ", " + H.UMI, H.UMI_ROWS),
    "spot_histogram": _w(_CONS + ", " + H.SPOT, H.SPOT_ROWS),
    "cluster_histogram": _w(_CONS + ", " + H.CLUSTER, H.CLUSTER_ROWS),
    "allele_filter_histogram": _w(_KEPT, H.FILTER_ROWS),
    "individual_histogram": _w(_KEPT, "SELECT * FROM hw"),
    "individual_genotype": _w(_GENO, H.GENOTYPE_ROWS),
    "spot_genotype": _w(_GENO + ", " + _CELLN + H.SPOT_GENO, H.SPOT_GENO_ROWS),
    "individual_germline": _w(_GENO, H.GERMLINE_ROWS),
    "classify_candidates": _w(_ALLELES, "SELECT * FROM (SELECT chrom, pos, ref, allele2 AS alt1, count2 >= 5 AND depth >= 30 AND count2 / depth >= 0.001 AND count2 / depth <= 0.6 AS is_somatic, depth >= 100 AND count1 / depth >= 0.95 AND count2 >= 5 AS is_error, depth AS total_depth, count1 AS ref_depth, count2 AS alt1_depth, round(count2 / depth, 6) AS vaf FROM al WHERE depth >= 30) WHERE is_somatic OR is_error"),
    "order_alleles_by_count": _w(_ALLELES, "SELECT * FROM al"),
    "agg_umi": _w(_UMI, "SELECT chrom, pos, barcode, umi, nA, nT, nC, nG, reads, reverse, strand FROM um"),
    "umi_consensus": _w(_CONS, "SELECT chrom, pos, barcode, umi, allele, phred, strand FROM cs"),
    "check_errors": _w(_UMI, "SELECT chrom, pos, count(*) FILTER (f >= 2 AND m >= 3) AS pcr, count(*) FILTER (f = 1 AND m > 3) AS lysis FROM (SELECT *, (nA > 0)::INT + (nT > 0)::INT + (nC > 0)::INT + (nG > 0)::INT AS f, greatest(" + ", ".join(f"CASE WHEN ref <> '{b}' THEN n{b} ELSE 0 END" for b in _B) + ") AS m FROM um) GROUP BY chrom, pos"),
    "site_error_allele": _w(_UMI, "SELECT chrom, pos, ref, max(alt) AS alt FROM (SELECT *, CASE " + " ".join(f"WHEN ref <> '{b}' AND n{b} > 3 AND reads = n{b} THEN '{b}'" for b in _B) + " END AS alt FROM um) GROUP BY chrom, pos, ref HAVING count(alt) = 1"),
    "site_strand": _w(_UMI, "SELECT chrom, pos, CASE WHEN count(*) FILTER (strand = '+') > count(*) FILTER (strand = '-') THEN '+' ELSE '-' END AS strand FROM um GROUP BY chrom, pos"),
    "agg_spot": _w(_SPOT, "SELECT * FROM sp"),
    "agg_cluster": _w(_CLUS, "SELECT * FROM cl"),
    "agg_individual": _w(_IND, "SELECT * FROM ind"),
    "allele_filter_binom": _w(_FILTERED, "SELECT chrom, pos, ref, cluster, spot_number, " + ", ".join(f"CASE WHEN k{b} THEN n{b} ELSE 0 END AS n{b}" for b in _B) + " FROM fk"),
    "join_cluster_vaf_calc": _w(_MUT, f"SELECT cl.chrom, cl.pos, cl.ref, mutant, cluster, cl.spot_number, {_DEPTH} AS depth, round(CASE WHEN {_DEPTH} > 0 THEN ({_COUNT}) / {_DEPTH} END, 6) AS cluster_vaf FROM cl JOIN mu ON cl.chrom = mu.chrom AND cl.pos = mu.pos"),
    "agg_barcode_totals": _w(_EVENTS, "SELECT barcode, count(DISTINCT umi) AS n_umi, count(*) AS reads FROM ev GROUP BY barcode"),
    "cell_number": _w(_EVENTS + ", tt AS (SELECT barcode, cluster, count(DISTINCT chrom || '_' || pos || '_' || umi) AS n_umi FROM ev JOIN bc USING (barcode) GROUP BY ALL), md AS (SELECT quantile_cont(n_umi, 0.5) AS m FROM tt GROUP BY cluster ORDER BY sum(n_umi) DESC, cluster DESC LIMIT 1)", "SELECT barcode, cluster, n_umi, CAST(CASE WHEN m > 0 THEN least(25, ceil(round(20 * n_umi / m, 9))) ELSE 1 END AS BIGINT) AS refined_cell_num FROM tt, md"),
    "genotype_likelihood": _w(_HIST, "SELECT chrom, pos, alt, r, a, round(l_refhom, 4) AS l_refhom, round(l_althom, 4) AS l_althom, round(l_het, 4) AS l_het, round(l_mosaic, 4) AS l_mosaic FROM lh"),
    "individual_posterior": _w(_HIST + _SITES[len(_EVENTS) :] + ", " + _PRIOR + f", lf AS (SELECT lh.*, {_FREQ('lh.ref')} AS fr, {_FREQ('lh.alt')} AS fa FROM lh LEFT JOIN pr ON pr.chrom = lh.chrom AND pr.pos = lh.pos), g AS (SELECT *, log10(fr * fr) + l_refhom AS g0, log10(fa * fa) + l_althom AS g1, log10(2 * fr * fa) + l_het AS g2, log10(1e-5) + l_mosaic AS g3 FROM lf)", "SELECT chrom, pos, alt, CASE greatest(g0, g1, g2, g3) WHEN g3 THEN 'mosaic' WHEN g0 THEN 'refhom' ELSE 'het' END AS genotype, round(1 / (1 + pow(10.0, greatest(g0, g1, g2) - g3)), 4) AS p_mosaic, round(a / (r + a), 6) AS vaf FROM g"),
    "downsample_hist": _w(_CONS, "SELECT chrom, pos, allele, phred, CAST(CASE WHEN t > 200 THEN round_even(n * (200.0::DOUBLE / t), 0) ELSE n END AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY chrom, pos) AS t FROM (SELECT chrom, pos, allele, phred, count(*) AS n FROM cs GROUP BY ALL))"),
    "prior_normalise": "WITH p AS (SELECT p_partkey AS pos, substr('ATCG', CAST(p_partkey % 4 + 1 AS INT), 1) AS ref, (p_partkey * 7) % 100 / 120 AS fA, (p_partkey * 11) % 100 / 120 AS fT, (p_partkey * 13) % 100 / 120 AS fC, (p_partkey * 17) % 100 / 120 AS fG FROM part), q AS (SELECT *, " + " + ".join(f"CASE WHEN ref = '{b}' THEN 0 ELSE f{b} END" for b in _B) + " AS o FROM p), z AS (SELECT *, CASE WHEN o > 1 THEN 0.99 / o ELSE 1 END AS s FROM q) SELECT pos, ref, " + ", ".join(f"round(CASE WHEN ref = '{b}' THEN 1 - o * s ELSE f{b} * s END, 6) AS f{b}" for b in _B) + " FROM z",
    "join_prior_left": _w(_SITES + ", " + _PRIOR, "SELECT x.chrom, x.pos, depth, " + ", ".join(f"round(coalesce(f{b}, 0), 6) AS f{b}" for b in _B) + " FROM (SELECT 'chr' || CAST(1 + p_partkey % 60 % 3 AS VARCHAR) AS chrom, 1000 + 2 * (p_partkey % 180) AS pos, p_partkey AS depth FROM part) x LEFT JOIN pr ON pr.chrom = x.chrom AND pr.pos = x.pos"),
    "rebin_coord": "SELECT event_id, CAST(ceil(user_id / 50) * 50 AS BIGINT) AS x FROM events",
    "win_gap_sessionize": _w(_SESS, "SELECT * FROM sn"),
    "win_merge_intervals": _w(_GENES, """SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS merged FROM (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY "start", "end", gene ROWS UNBOUNDED PRECEDING) AS b FROM (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY chrom ORDER BY "start", "end", gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 5 THEN 0 ELSE 1 END AS n FROM gn)) GROUP BY chrom, b"""),
    "interval_join_gene_het": _w(_SITES + ", " + _GENES, """SELECT st.chrom, pos, gene, "start", "end" FROM st JOIN gn ON st.chrom = gn.chrom AND pos >= "start" AND pos < "end" """),
    "interval_join_cluster_region": _w(_SESS + ", " + _GENES, """SELECT sn.chrom, session, gene, least(sn."start", gn."start") AS "start", greatest(sn."end" + 1, gn."end") AS "end" FROM sn JOIN gn ON sn.chrom = gn.chrom AND sn."start" < gn."end" AND gn."start" < sn."end" + 1"""),
    "interval_left_gene": _w(_SITES + ", " + _GENES, """SELECT st.chrom, pos, string_agg(gene, ',' ORDER BY gene) AS genes, coalesce(min("start"), pos - 150) AS "start", coalesce(max("end"), pos + 150) AS "end" FROM st LEFT JOIN gn ON st.chrom = gn.chrom AND pos >= "start" AND pos < "end" GROUP BY st.chrom, pos"""),
    "interval_subtract_bed": _w(_SITES + ", " + _GENES, """SELECT chrom, pos, EXISTS (SELECT 1 FROM gn WHERE gn.chrom = st.chrom AND pos >= "start" AND pos < "end") AS imprinted FROM st"""),
    "asof_mappability": _w(_SITES + ", " + _GENES + """, tr AS (SELECT chrom, "start", max("end") AS "end", CAST(max("end" - "start") AS DOUBLE) AS score FROM gn GROUP BY ALL)""", """SELECT st.chrom, st.pos, CASE WHEN st.pos < tr."end" THEN score WHEN st.chrom IN (SELECT chrom FROM tr) THEN 0.0 END AS score FROM st ASOF LEFT JOIN tr ON st.chrom = tr.chrom AND st.pos >= tr."start" """),
    "self_join_cluster_pairs": _w(_DENSE, "SELECT a.chrom, a.pos AS pos_i, b.pos AS pos_j FROM ds a JOIN ds b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos <= a.pos + 10"),
    "semi_pon": "SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS pon FROM orders",
    "semi_editing_db": _w(_SITES + ", " + _GENES, 'SELECT chrom, pos, EXISTS (SELECT 1 FROM gn WHERE gn.chrom = st.chrom AND gn."start" = st.pos) AS editing_database FROM st'),
    "lookup_dbsnp": _w(_VAR, "SELECT chrom, pos, ref, alt, CASE WHEN alt IN ('A', 'G') THEN 'rs' || pos END AS dbsnp FROM va"),
    "context_dna96": _w(_VAR, f"SELECT chrom, pos, CASE WHEN ref IN ('C', 'T') THEN up || '[' || ref || '>' || alt || ']' || down ELSE {_COMP('down')} || '[' || {_COMP('ref')} || '>' || {_COMP('alt')} || ']' || {_COMP('up')} END AS context FROM va"),
    "context_rna192": _w(_VAR, f"SELECT chrom, pos, {_RNA} AS context FROM va"),
    "agg_mutation_spectrum": _w(_SPEC, "SELECT place, context, n FROM sc"),
    "refine_spectrum": _w(_SPEC, "SELECT a.context, greatest(a.n - coalesce(b.n, 0), 0) AS n FROM sc a LEFT JOIN sc b ON b.context = translate(substr(a.context, 7, 1), 'ACGT', 'TGCA') || '[' || translate(substr(a.context, 3, 1), 'ACGT', 'TGCA') || '>' || translate(substr(a.context, 5, 1), 'ACGT', 'TGCA') || ']' || translate(substr(a.context, 1, 1), 'ACGT', 'TGCA')"),
    "gc_content": "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[GC]')) / length(text) END, 9) AS gc FROM documents",
    "cause_poly_alt": _w(_VAR, "SELECT chrom, pos, contains(substr(repeat(alt, CAST(pos % 7 AS INT)), 1, 5) || alt || down, repeat(alt, 6)) AS poly FROM va"),
    "beta_binomial_sf": _w(_VAR, f"SELECT chrom, pos, alt_count, depth, round({_BB}, 6) AS p FROM va"),
    "hFDR": _w(_VAR + _ALLELES[len(_EVENTS) :] + ", " + _FIT + f", bb AS (SELECT *, {_BB} AS al FROM (SELECT va.*, {_RNA} AS context FROM va) JOIN rw USING (context))", "SELECT chrom, pos, CASE WHEN mixed > 0 THEN round(al / (al + (depth - alt_count + 1) / (depth + 1) / 192 / mixed / 49), 6) ELSE 0 END AS hfdr FROM bb", True),
    "signature_fit": _w(_VAR + _ALLELES[len(_EVENTS) :] + ", " + _FIT, "SELECT context, CASE WHEN mixed > 0 THEN round(1 / 192 / mixed, 6) ELSE CAST('inf' AS DOUBLE) END AS rweigh FROM rw", True),
    "binom_cdf_ase": _w(_MUT + f", hp AS (SELECT cl.chrom, cl.pos, greatest(0, 1 - ({_sf(f'(({_COUNT}) + 1)', _DEPTH, '0.1')})) AS p FROM cl JOIN mu ON cl.chrom = mu.chrom AND cl.pos = mu.pos WHERE {_DEPTH} > 0), hq AS (SELECT *, p * count(*) OVER (PARTITION BY chrom, pos) / k AS q FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY p) AS k FROM hp)), ha AS (SELECT chrom, pos, least(1, min(q) OVER (PARTITION BY chrom, pos ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS a FROM hq)", "SELECT chrom, pos, max(a) >= 0.05 AS ase, round(max(a), 6) AS p_adj FROM ha GROUP BY chrom, pos"),
    "bh_fdr": "WITH x AS (SELECT p_size AS g, p_partkey, (p_partkey * 7919 % 1009 + 1) / 1010 AS p FROM part WHERE p_partkey % 11 <> 0), y AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS k, count(*) OVER (PARTITION BY g) AS n FROM x), z AS (SELECT p_partkey, least(1, min(p * n / k) OVER (PARTITION BY g ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM y) SELECT part.p_partkey, round(p_adj, 6) AS p_adj FROM part LEFT JOIN z ON z.p_partkey = part.p_partkey",
    "phase_classify": _w(_PHASE, "SELECT chrom, pos, snp_pos, mutant, g1h1, g1h2, g2h1, g2h2, mh1, mh2, dp, mut_allele, haplo, CASE haplo WHEN 2 THEN 'heterzygous' WHEN 3 THEN 'mut_mosaic' ELSE 'artifacts' END AS annotated_type FROM pc"),
    "mutation_origin": _w(_PHASE, """SELECT chrom, pos, snp_pos, array_to_string(germ, ',') AS germline, CASE WHEN haplo <> 3 THEN NULL WHEN len(germ) = 1 THEN germ[1]
      WHEN mh1 > mh2 THEN CASE WHEN g1h1 > g2h1 THEN germ[1] ELSE germ[2] END WHEN mh1 < mh2 THEN CASE WHEN g1h2 > g2h2 THEN germ[1] ELSE germ[2] END END AS mut_origin FROM pc"""),
    "cluster_events": _w(_CROSS + """, nn AS (SELECT a.chrom, a.pos AS pos_i, b.pos AS pos_j, a.ref AS r1, a.mutant AS m1, b.ref AS r2, b.mutant AS m2 FROM mz a JOIN mz b ON a.chrom = b.chrom AND b.pos - a.pos BETWEEN 1 AND 24 AND NOT a.het AND NOT b.het),
      c0 AS (SELECT nn.chrom, pos_i, pos_j, count(*) FILTER (x.allele = r1 AND y.allele = r2) AS rr, count(*) FILTER (x.allele = r1 AND y.allele = m2) AS ra, count(*) FILTER (x.allele = m1 AND y.allele = r2) AS ar, count(*) FILTER (x.allele = m1 AND y.allele = m2) AS aa
        FROM nn JOIN cs x ON x.chrom = nn.chrom AND x.pos = pos_i AND x.phred >= 20 JOIN cs y ON y.chrom = nn.chrom AND y.pos = pos_j AND y.barcode = x.barcode AND y.umi = x.umi AND y.phred >= 20 GROUP BY ALL), ce AS (SELECT * FROM c0 WHERE rr + ra + ar + aa >= 50),
      fi AS (SELECT *, rr + ra + ar + aa AS n, list_transform(range(greatest(0, rr - aa), least(rr + ra, rr + ar) + 1), lambda k: lgamma(rr + ra + 1.0) + lgamma(ar + aa + 1.0) + lgamma(rr + ar + 1.0) + lgamma(ra + aa + 1.0) - lgamma(rr + ra + ar + aa + 1.0) - lgamma(k + 1.0) - lgamma(rr + ra - k + 1.0) - lgamma(rr + ar - k + 1.0) - lgamma(aa - rr + k + 1.0)) AS t FROM ce),
      ch AS (SELECT *, list_sum(list_transform([[rr, (rr + ra) * (rr + ar) / n], [ra, (rr + ra) * (ra + aa) / n], [ar, (ar + aa) * (rr + ar) / n], [aa, (ar + aa) * (ra + aa) / n]], lambda c: pow(greatest(abs(c[1] - c[2]) - 0.5, 0), 2) / c[2])) AS chi FROM fi),
      pv AS (SELECT *, sqrt(chi / 2) AS x FROM ch), pw AS (SELECT *, CASE WHEN least(rr, ra, ar, aa) < 5 THEN least(1, list_sum(list_filter(list_transform(t, lambda z: exp(z)), lambda z: z <= exp(t[rr - greatest(0, rr - aa) + 1]) * (1 + 1e-7)))) ELSE """ + ERFC + """ END AS p FROM pv)""",
      "SELECT chrom, pos_i, pos_j, rr::DOUBLE AS rr, ra::DOUBLE AS ra, ar::DOUBLE AS ar, aa::DOUBLE AS aa, round(p, 6) AS p, p < 0.05 AS event FROM pw"),
    "agg_phase_summary": _w(_PHASE + ", ps AS (SELECT chrom, pos, CAST(max(mut_allele) AS BIGINT) AS max_support, CAST(sum(mut_allele) AS BIGINT) AS sum_support, arg_min(haplo, (snp_pos - pos) * 100000 + snp_pos) AS nearest_haplo, arg_max(haplo, mut_allele * 100000 - snp_pos) AS most_haplo FROM pc GROUP BY chrom, pos)", "SELECT *, CASE WHEN most_haplo = nearest_haplo THEN most_haplo WHEN most_haplo = 3 OR nearest_haplo = 3 THEN 3 ELSE least(most_haplo, nearest_haplo) END AS haplo FROM ps"),
    "rule_filtration": _w(_RULES, "SELECT chrom, pos, ref, alt, filter FROM ru"),
    "filter_pipeline": "SELECT filter, passed, total, round(passed / total, 6) AS pass_rate FROM (SELECT 'dear' AS filter, count(*) FILTER (o_totalprice > 100000) AS passed, count(*) AS total FROM orders UNION ALL SELECT 'open', count(*) FILTER (o_orderstatus = 'O'), count(*) FROM orders)",
    "join_wide_features": _w(_VAR + ", " + _GENES + ", " + _POP, 'SELECT chrom, pos, ref, alt, spot_number, (SELECT min(af) FROM po WHERE po.chrom = va.chrom AND po.pos = va.pos AND po.ref = va.ref AND po.alt = va.alt) AS known_af, (SELECT nullif(count(*), 0) FROM gn WHERE gn.chrom = va.chrom AND gn."start" <= va.pos AND va.pos < gn."end") AS genes FROM va'),
    "agg_site_spatial": _w(_SPOT + ", sq AS (SELECT chrom, pos, CASE WHEN pos % 5 = 0 THEN 4 ELSE depth END AS depth, vaf, ceil(round(CASE WHEN pos % 5 = 0 THEN 4 ELSE depth END * vaf, 9)) AS m, (pos * 7 + k * 3) % 10 / 10 AS pr, (pos + k * 5) % 8 / 10 AS li FROM (SELECT *, CAST(substr(barcode, 3) AS BIGINT) AS k FROM ss) WHERE k % 9 > 0)",
      "SELECT chrom, pos, count(*) AS num_spots, count(*) FILTER (vaf > 0) AS num_mut_spots, round(avg((vaf > 0 AND pr > 0.5)::INT), 6) AS mut_rate, round(avg((pr > 0.5)::INT), 6) AS mut_rate_prob, round(avg((li > 0.5)::INT), 6) AS mut_rate_likelihood, round(avg((vaf > 0)::INT), 6) AS mut_rate_vaf, round(max(vaf), 6) AS vaf_max, round(avg(vaf), 6) AS vaf_mean, round(avg(vaf) FILTER (vaf > 0), 6) AS vaf_mean_mut, round(quantile_cont(vaf, 0.5) FILTER (vaf > 0), 6) AS vaf_median_mut, round(CASE WHEN count(DISTINCT depth) <= 1 THEN 1 WHEN count(DISTINCT m) = 1 THEN 0 ELSE pow(corr(m, depth), 2) END, 6) AS r2 FROM sq GROUP BY chrom, pos"),
    "sample_fixed_n": _w(_EVENTS, "SELECT chrom, pos, read_id FROM (SELECT chrom, pos, read_id, row_number() OVER (PARTITION BY chrom, pos ORDER BY (read_id * 7919 + 42) % 104729, read_id) AS k FROM ev) WHERE k <= 20"),
    "agg_bam_qc": "SELECT l_suppkey % 4 * 85 AS mapq, l_linenumber % 6 AS nm, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1, 2",
    "phylo_matrix": _w(_SPOT, "SELECT g.chrom, g.pos, g.barcode, coalesce(ss.alt, 0) AS alt, coalesce(depth, 0) AS total, CASE WHEN ss.alt > 0 THEN 1 WHEN depth > 0 THEN 0 END AS state FROM (SELECT chrom, pos, bc.barcode FROM (SELECT chrom, pos FROM ss GROUP BY ALL HAVING count(*) > 3), bc) g LEFT JOIN ss ON ss.chrom = g.chrom AND ss.pos = g.pos AND ss.barcode = g.barcode"),
    "parse_pileup": "SELECT 'chr1' AS chrom, p_partkey AS pos, 'A' AS ref, CAST(1 + 2 * (p_size % 5) AS BIGINT) AS nA, p_partkey % 3 AS nT, CAST(0 AS BIGINT) AS nC, CAST(0 AS BIGINT) AS nG, CAST(1 AS BIGINT) AS insertions, CAST(1 AS BIGINT) AS deletions FROM part",
    "sink_vcf": _w(_RULES, "SELECT concat_ws(chr(9), chrom, pos, '.', ref, alt, '.', 'PASS', 'DP=' || depth || ';ALT_DP=' || alt_count) AS line FROM ru WHERE filter = 'PASS'"),
    "ml_prepare": "SELECT DISTINCT p_partkey, round(log10(1 + coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size / 50 END, 1)), 6) AS x_p, round(coalesce(CASE WHEN p_size % 7 <> 0 THEN p_retailprice END, 0), 6) AS y_rbc FROM part",
    "union_distinct": _w(_VAR, "SELECT chrom, pos, ref, alt FROM va WHERE pos < 1120 UNION SELECT chrom, pos, ref, alt FROM va WHERE pos > 1080"),
    "set_except": _w(_VAR + ", " + _GENES + ", " + _POP, '(SELECT chrom, pos FROM va EXCEPT SELECT chrom, "start" FROM gn) INTERSECT SELECT va.chrom, va.pos FROM va JOIN po ON po.chrom = va.chrom AND po.pos = va.pos AND po.alt = va.alt'),
    "sort_chrom_aware": _w(_SITES, "SELECT chrom, pos, CAST(substr(chrom, 4) AS INT) AS o FROM st ORDER BY o, pos"),
    "umi_event_explode": "WITH b(kind, k, start, len) AS (VALUES (0, 0, 0, 40), (1, 3, 0, 20), (1, 25, 20, 15), (2, 0, 0, 10), (2, 10, 14, 20), (2, 30, 84, 10), (3, 5, 0, 15), (3, 20, 15, 1), (3, 21, 16, 17)), si AS (SELECT DISTINCT 'chr' || (1 + p_partkey % 4) AS chrom, 1 + p_partkey % 400 AS pos FROM part), x AS (SELECT o_orderkey AS read_id, o_custkey, 'chr' || (1 + o_orderkey % 3) AS chrom, o_orderkey % 300 + start + i + 1 AS pos, k + i AS k FROM orders JOIN b ON kind = o_orderkey % 4, unnest(range(0, len)) u(i) WHERE o_custkey % 11 <> 0) SELECT * FROM (SELECT read_id, chrom, pos, 'A' AS ref, 'BC' || (o_custkey % 50) AS barcode, CAST(read_id % 10 AS VARCHAR) AS umi, substr(repeat('ACGTTGCAN', 6), CAST(1 + o_custkey % 9 + k AS BIGINT), 1) AS base, CAST((k * 7 + read_id) % 45 AS INT) AS qual, read_id % 2 = 1 AS is_reverse FROM x JOIN si USING (chrom, pos)) WHERE base <> 'N' AND qual <= 40",
    "read_features": read_features(_CONS[len(_EVENTS) :]),
    "sample_reservoir": """WITH rg AS (SELECT DISTINCT 'chr' || (1 + p_partkey % 3) AS chrom, p_partkey % 12 * 25 AS "start", p_partkey % 12 * 25 + 25 + p_partkey % 4 * 10 AS "end" FROM part),
      rd AS (SELECT o_orderkey AS read_id, 'chr' || (1 + o_orderkey % 3) AS chrom, o_orderkey % 300 AS a, o_orderkey % 300 + [40, 35, 94, 33][1 + o_orderkey % 4] AS b FROM orders),
      hi AS (SELECT rg.*, read_id, count(*) OVER w AS total_seen, row_number() OVER (w ORDER BY CAST('0x' || substr(md5(CAST(read_id AS VARCHAR)), 1, 15) AS BIGINT), read_id) AS k FROM rg JOIN rd ON rd.chrom = rg.chrom AND a < rg."end" AND b > rg."start" WINDOW w AS (PARTITION BY rg.chrom, rg."start", rg."end"))
      SELECT chrom, "start", "end", read_id, total_seen, total_seen > 150 AS adjusted FROM hi WHERE k <= 150""",
    "filter_reads_quality": "SELECT o_orderkey AS read_id, CAST(o_orderkey % 4 * 85 AS INT) AS mapq, CAST(o_orderkey % 7 AS INT) AS nm FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey % 7 <= 5",
    "filter_reads_by_barcode": "SELECT o_orderkey AS read_id, 'BC' || (o_custkey % 50) AS barcode FROM orders WHERE o_custkey % 11 <> 0 AND o_custkey % 50 % 4 = 1",
    "filter_informative_het": _w(_GERM, "SELECT chrom, pos, count1, count2 FROM ge WHERE het AND count1 > 5 AND count2 > 5 AND prior1 > 0.05 AND prior2 > 0.05 AND count1 + count2 > 30"),
    "filter_ase_germline": _w(_GERM + f", gp AS (SELECT *, CASE WHEN count1 = count2 THEN 1.0 ELSE least(1.0, 2 * ({_sf('greatest(count1, count2)', '(count1 + count2)', '0.5')})) END AS p FROM ge WHERE het AND count1 + count2 > 50 AND prior1 > 1e-4 AND prior2 > 1e-4)", "SELECT chrom, pos, count1, count2, round(p, 6) AS p FROM gp WHERE p <= 0.05"),
    "filter_gene_bed": _w(_GENES, """SELECT chrom, "start", "end", gene FROM gn WHERE chrom <> 'chr4' AND "start" % 7 <> 0"""),
    "mask_placeholder_priors": "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_partkey % 5 > 1 AND p_partkey % 10 <> 0 THEN p_partkey * {m} % 10 / 10 END AS f{b}" for b, m in zip(_B, (1, 2, 3, 4), strict=True)) + " FROM part",
    "null_normalise": "SELECT p_partkey, CASE p_size % 7 WHEN 5 THEN 'yes' WHEN 6 THEN '0' END AS x FROM part",
    "zero_to_null": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size % 4 AS BIGINT) END AS x FROM part",
    "extract_barcode_umi": "SELECT event_id, CASE WHEN ok THEN CAST(ceil(user_id / 50) * 50 AS BIGINT) || '_' || CAST(ceil(event_id % 777 / 50) * 50 AS BIGINT) END AS barcode, CASE WHEN ok THEN event_type END AS umi FROM (SELECT *, event_id % 9 > 0 AND user_id IS NOT NULL AND event_type IS NOT NULL AS ok FROM events)",
    "barcode_to_cell": _w(_EVENTS, "SELECT read_id, 'cell' || cluster AS barcode, 'cell' || cluster || '_' || umi AS umi FROM ev JOIN bc USING (barcode) WHERE cluster <> '3'"),
    "join_prior_lookup": _w(_SITES + ", po AS (SELECT 'chr' || CAST(1 + p_partkey % 60 % 3 AS VARCHAR) AS chrom, 1000 + 4 * (p_partkey % 60) AS pos, substr('ATCG', CAST(1 + p_partkey % 4 AS INT), 1) AS ref, substr('ATCG', CAST(1 + (p_partkey + 1 + p_size % 3) % 4 AS INT), 1) AS alt, p_size / 100 AS af FROM part)", "SELECT chrom, pos, ref, " + ", ".join(f"max(af) FILTER (alt = '{b}') AS f{b}" for b in _B) + " FROM po WHERE EXISTS (SELECT 1 FROM st WHERE st.chrom = po.chrom AND st.pos = po.pos AND st.ref = po.ref) GROUP BY ALL"),
    "RNA_editing": _w(_VAR + ", " + _GENES + f", rc AS (SELECT chrom, pos, contains({_RNA}, 'A>G') AS ag, EXISTS (SELECT 1 FROM gn WHERE gn.chrom = va.chrom AND gn.\"start\" = va.pos) AS db FROM va)", "SELECT chrom, pos, db AS editing_database, ag AS editing_AtoG, db OR ag AS RNA_editing FROM rc"),
    "agg_cluster_spatial": _w(_SPOT, "SELECT chrom, pos, cluster, count(*) AS spot_count, CAST(sum(depth) AS BIGINT) AS depth, CAST(sum(alt) AS BIGINT) AS mutant_allele_num, count(*) FILTER (alt > 0) AS has_mutant_allele, count(*) FILTER (alt > 0) AS high_prob, round(avg(vaf), 6) AS vaf, round(sum(alt) / sum(depth), 6) AS vaf_unnom, round(count(*) FILTER (alt > 0) / count(*), 6) AS mutant_prop_vaf, round(count(*) FILTER (alt > 0) / count(*), 6) AS mutant_prop_prob FROM ss GROUP BY ALL"),
    "cross_mosaic_hsnp": _w(_CONS + _ALLELES[len(_EVENTS) :] + ", " + _MOSAIC, "SELECT mz.chrom, region, mz.pos, al.pos AS snp_pos FROM mz JOIN al ON al.chrom = mz.chrom AND (al.pos - 1000) // 80 = region AND count2 / depth >= 0.3 AND al.pos <> mz.pos"),
    "agg_phase_haplotypes": _w(_HAPLO, "SELECT chrom, pos, snp_pos, base, snp_base, n FROM ha"),
    "haplotype_balance_gate": _w(_GATE, "SELECT chrom, pos, snp_pos, h1, h2, dp, balanced FROM gt"),
    "discordant_prop": "SELECT p_partkey, round(CASE WHEN p_partkey % 8 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN CASE WHEN v3 < v4 THEN coalesce(v3 / nullif(v1 + v3, 0), 0) ELSE coalesce(v4 / nullif(v2 + v4, 0), 0) END WHEN v2 < v3 THEN coalesce(v3 / nullif(v1 + v3, 0), 0) WHEN v2 > 0 THEN 1 ELSE 0 END, 6)::DOUBLE AS prop FROM (SELECT p_partkey, p_partkey % 50 AS v1, p_partkey * 3 % 17 AS v2, p_partkey * 5 % 11 AS v3, p_partkey * 7 % 13 AS v4 FROM part)",
    "fisher_2x2": """WITH x AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (l_quantity > 25 AND l_returnflag = 'A') AS a, count(*) FILTER (l_quantity > 25) AS r, count(*) FILTER (l_returnflag = 'A') AS c, count(*) AS n FROM lineitem GROUP BY ALL),
  y AS (SELECT *, list_transform(range(greatest(0, c - (n - r)), least(r, c) + 1), lambda k: lgamma(r + 1.0) - lgamma(k + 1.0) - lgamma(r - k + 1.0) + lgamma(n - r + 1.0) - lgamma(c - k + 1.0) - lgamma(n - r - c + k + 1.0) - lgamma(n + 1.0) + lgamma(c + 1.0) + lgamma(n - c + 1.0)) AS t FROM x)
  SELECT l_suppkey, l_linenumber, round(least(1.0, list_sum(list_transform(t, lambda v: CASE WHEN v <= t[a - greatest(0, c - (n - r)) + 1] + 1e-7 THEN exp(v) ELSE 0.0 END))), 6) AS p FROM y""",
    "union_all": "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
}
