"""DuckDB SQL for quality histograms and individual genotypes: plain rows of (site, base) and joins, from the calls `cs` and clusters `bc`."""

from __future__ import annotations

_B = "ATCG"
_KEYS = "chrom, pos, strand, ref"


def text(b: str, least: int, n: str = "n") -> str:
    return f"coalesce(string_agg(phred || ':' || {n}, ',' ORDER BY phred) FILTER (allele = '{b}' AND phred >= {least}), 'NA') AS q{b}"


def counts(n: str = "n") -> str:
    return ", ".join(f"CAST(coalesce(sum({n}) FILTER (allele = '{b}'), 0) AS BIGINT) AS n{b}" for b in _B)


def texts(least: int, n: str = "n") -> str:
    return ", ".join(text(b, least, n) for b in _B)


UMI = ("mh AS (SELECT chrom, pos, ref, barcode, umi, base AS allele, qual AS phred, count(*) AS n FROM ev GROUP BY ALL), "
       "ms AS (SELECT chrom, pos, barcode, umi, CASE WHEN count(*) FILTER (NOT is_reverse) > count(*) FILTER (is_reverse) THEN '+' ELSE '-' END AS strand FROM ev GROUP BY ALL)")  # fmt: skip
UMI_ROWS = f"SELECT chrom, pos, barcode, umi, any_value(strand) AS strand, {counts()}, {texts(0)} FROM mh JOIN ms USING (chrom, pos, barcode, umi) GROUP BY chrom, pos, ref, barcode, umi"

SPOT = f"""sg AS (SELECT chrom, pos, CASE WHEN count(*) FILTER (strand = '+') > count(*) FILTER (strand = '-') THEN '+' ELSE '-' END AS strand FROM cs GROUP BY ALL),
hs AS (SELECT chrom, pos, sg.strand, ref, barcode, allele, phred, count(*) AS n FROM cs JOIN sg USING (chrom, pos) GROUP BY ALL),
ly AS (SELECT chrom, pos, ref, barcode, CASE WHEN count(bad) = 1 THEN max(bad) END AS error_allele FROM (SELECT *, CASE {" ".join(f"WHEN ref <> '{b}' AND n{b} > 3 AND reads = n{b} THEN '{b}'" for b in _B)} END AS bad FROM cs) GROUP BY ALL)"""
SPOT_ROWS = f"""SELECT chrom, pos, strand, ref, coalesce(nullif(array_to_string(list_filter(['A', 'T', 'C', 'G'], lambda b: list_contains(list(allele), b) AND b <> ref), ','), ''), '.') AS alt, barcode, any_value(error_allele) AS error_allele, {counts()}, {texts(0)}
  FROM hs JOIN ly USING (chrom, pos, ref, barcode) GROUP BY chrom, pos, strand, ref, barcode"""

CLUSTER = SPOT + """, hk AS (SELECT chrom, pos, strand, ref, cluster, allele, phred, CAST(sum(n) AS BIGINT) AS n FROM hs JOIN bc USING (barcode) GROUP BY ALL),
hn AS (SELECT chrom, pos, cluster, count(DISTINCT barcode) AS spot_number FROM hs JOIN bc USING (barcode) GROUP BY ALL)"""
CLUSTER_ROWS = f"""SELECT {_KEYS}, coalesce(string_agg(DISTINCT allele, ',' ORDER BY allele) FILTER (allele <> ref), '.') AS alt, cluster, any_value(spot_number) AS spot_number, {counts()}, {texts(20)}
  FROM hk JOIN hn USING (chrom, pos, cluster) GROUP BY {_KEYS}, cluster"""


def kept(sf: str) -> str:
    """Bases that stand out in any cluster; sf is P(X >= n) of a binomial of depth d and share 0.003."""
    return CLUSTER + f", kb AS (SELECT DISTINCT chrom, pos, allele FROM (SELECT *, sum(n) OVER (PARTITION BY chrom, pos, cluster) AS d FROM (SELECT chrom, pos, cluster, allele, sum(n) AS n FROM hk GROUP BY ALL)) WHERE {sf} < 0.05)"


FILTER_ROWS = f"""SELECT {_KEYS}, coalesce(any_value(alt), '.') AS alt, cluster, any_value(spot_number) AS spot_number, {counts()}, {texts(20)} FROM
  (SELECT {_KEYS}, hk.cluster, spot_number, CASE WHEN kb.allele IS NOT NULL THEN hk.allele END AS allele, phred, n FROM hk JOIN hn USING (chrom, pos, cluster) LEFT JOIN kb USING (chrom, pos, allele))
  LEFT JOIN (SELECT chrom, pos, cluster, string_agg(allele, ',' ORDER BY n DESC, instr('ATCG', allele)) AS alt FROM (SELECT chrom, pos, cluster, allele, sum(n) AS n FROM hk SEMI JOIN kb USING (chrom, pos, allele) WHERE allele <> ref GROUP BY ALL) GROUP BY ALL) USING (chrom, pos, cluster)
  GROUP BY {_KEYS}, cluster"""

INDIVIDUAL = f""", hi AS (SELECT {_KEYS}, allele, phred, CAST(sum(n) AS BIGINT) AS n FROM hk SEMI JOIN kb USING (chrom, pos, allele) GROUP BY ALL),
ns AS (SELECT {_KEYS}, CAST(sum(spot_number) AS BIGINT) AS spot_number FROM (SELECT DISTINCT {_KEYS}, cluster, spot_number FROM hk JOIN hn USING (chrom, pos, cluster)) GROUP BY ALL),
hw AS (SELECT {_KEYS}, coalesce(string_agg(DISTINCT allele, ',' ORDER BY allele) FILTER (allele <> ref), '.') AS alt, any_value(spot_number) AS spot_number, {counts()}, {texts(20)} FROM ns LEFT JOIN hi USING ({_KEYS}) GROUP BY {_KEYS})"""


def _joint(r: str, a: str) -> str:
    """[refhom, althom, het, mosaic]: log10 of prior times likelihood for rows r and a of (site, base)."""
    ch = f"(lgamma({r}.n + {a}.n + 1) - lgamma({r}.n + 1) - lgamma({a}.n + 1)) / ln(10)"
    x = f"({r}.ms + {a}.n - {a}.ms)"
    beta = f"(lgamma({x} + 1) + lgamma({r}.n + {a}.n - {x} + 1) - lgamma({r}.n + {a}.n + 2)) / ln(10)"
    return f"[log10({r}.f * {r}.f) + {ch} + {r}.rt + {a}.wr, log10({a}.f * {a}.f) + {ch} + {r}.wr + {a}.rt, log10(2 * {r}.f * {a}.f) + {ch} - ({r}.n + {a}.n) * log10(2), -7 + {ch} + {beta}]"


def genotypes(freq: str, depth: int) -> str:
    """From hi, hw and priors pr: gm is the germline of a site, gx a row for each candidate mutant."""
    lsum = lambda i: f"list_max(list(p[{i}])) + log10(list_sum(list_transform(list(p[{i}]), lambda x: pow(10.0, x - list_max(list(p[{i}])))))) AS p{i}"
    return f""", iq AS (SELECT * EXCLUDE (n), n AS n0, CASE WHEN t > {depth} THEN round_even(n * ({depth}.0::DOUBLE / t), 0) ELSE n END::DOUBLE AS n FROM (SELECT *, sum(n) OVER (PARTITION BY chrom, pos) AS t FROM hi WHERE phred >= 20)),
ab AS (SELECT s.chrom, s.pos, s.ref, b.base, b.i, CAST(coalesce(sum(n0), 0) AS BIGINT) AS n0, coalesce(sum(n), 0) AS n, coalesce(sum(n * log10(1 - pow(10, -phred / 10.0))), 0) AS rt, coalesce(sum(n * -phred / 10.0), 0) AS wr, coalesce(sum(n * pow(10, -phred / 10.0)), 0) AS ms
  FROM (SELECT DISTINCT chrom, pos, ref FROM iq) s CROSS JOIN (VALUES ('A', 1), ('T', 2), ('C', 3), ('G', 4)) b(base, i) LEFT JOIN iq ON iq.chrom = s.chrom AND iq.pos = s.pos AND iq.allele = b.base GROUP BY ALL),
af AS (SELECT ab.*, {freq} AS f FROM ab LEFT JOIN pr ON pr.chrom = ab.chrom AND pr.pos = ab.pos),
pn AS (SELECT chrom, pos, count(*) FILTER (n > 0) AS k, count(*) FILTER (n > 0 AND base = ref) = 1 AS has, sum(n) AS depth FROM ab GROUP BY ALL HAVING count(*) FILTER (n > 0) > 1),
ot AS (SELECT af.*, row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, i) AS o FROM af WHERE base <> ref AND n > 0),
g0 AS (SELECT r.chrom, r.pos, r.base AS rb, r.n0 AS rn, r.f AS rf, a.base AS ab, a.n0 AS an, a.f AS af, {_joint('r', 'a')} AS p FROM af r JOIN ot a ON r.chrom = a.chrom AND r.pos = a.pos AND r.base = r.ref AND a.o = 1),
gm AS (SELECT g0.*, depth, k = 2 AND has AS pair, CASE WHEN list_position(p, list_max(p)) IN (1, 4) THEN 'refhom' WHEN k = 2 AND has OR list_position(p, list_max(p)) = 3 THEN 'het' ELSE 'althom' END AS geno FROM g0 JOIN pn USING (chrom, pos)),
rf AS (SELECT af.* FROM af JOIN gm USING (chrom, pos) WHERE af.base = rb OR af.base = ab AND NOT pair AND geno <> 'refhom'),
px AS (SELECT a.chrom, a.pos, a.base AS mutant, a.n / gm.depth AS vaf_hat, geno, pair OR geno = 'refhom' AS alone, CASE WHEN pair OR geno = 'refhom' THEN rb ELSE rb || ',' || ab END AS germline, {_joint('r', 'a')} AS p
  FROM ot a JOIN gm USING (chrom, pos) JOIN rf r ON r.chrom = a.chrom AND r.pos = a.pos WHERE pair OR geno = 'refhom' OR a.o > 1),
ps AS (SELECT chrom, pos, germline, mutant, geno, alone, vaf_hat, {', '.join(map(lsum, range(1, 5)))} FROM px GROUP BY ALL),
gx AS (SELECT *, CASE WHEN NOT alone OR geno = 'refhom' THEN p1 WHEN geno = 'althom' THEN p2 ELSE p3 END AS pg FROM ps)"""


GENOTYPE_ROWS = """SELECT chrom, pos, strand, germline, mutant, spot_number, nA || ',' || nT || ',' || nC || ',' || nG AS consensus_read_count, CASE WHEN p4 > pg THEN 'mosaic' ELSE 'germline' END AS genotype,
  round(1 / (1 + pow(10.0, pg - p4)), 4) AS p_mosaic, CASE WHEN p4 > pg OR geno = 'het' THEN '0/1' WHEN geno = 'althom' THEN '1/1' ELSE '0/0' END AS Gi, round(vaf_hat, 6) AS vaf_hat FROM gx JOIN hw USING (chrom, pos)"""
GERMLINE_ROWS = """SELECT chrom, pos, geno AS germline_geno, CASE WHEN geno = 'refhom' THEN rb ELSE rb || ',' || ab END AS germline_allele, CASE WHEN geno = 'refhom' THEN CAST(rn AS VARCHAR) ELSE rn || ',' || an END AS germ_count,
  round(rf, 6) AS prior1, CASE WHEN geno <> 'refhom' THEN round(af, 6) END AS prior2 FROM gm"""

#: Spots of mosaic candidates: cn has (barcode, number), xs a row for each spot and candidate with its bases' sums.
SPOT_GENO = """, gz AS (SELECT chrom, pos, strand, germline, mutant, string_split(germline, ',') AS gl FROM gx JOIN hw USING (chrom, pos) WHERE p4 > pg),
sv AS (SELECT chrom, pos, mutant, cluster, coalesce(sum(n) FILTER (allele = mutant), 0) / sum(n) AS v FROM gz JOIN (SELECT chrom, pos, cluster, allele, n FROM hk SEMI JOIN kb USING (chrom, pos, allele)) USING (chrom, pos) GROUP BY ALL),
sb AS (SELECT chrom, pos, barcode, allele, sum(n) AS n, sum(n * ln(1 - pow(10, -phred / 10.0))) AS rt, sum(n * ln(pow(10, -phred / 10.0))) AS wr, sum(n * pow(10, -phred / 10.0)) AS ms FROM hs WHERE phred >= 20 GROUP BY ALL),
dp AS (SELECT chrom, pos, barcode, CAST(coalesce(sum(n) FILTER (phred >= 20), 0) AS BIGINT) AS depth FROM hs GROUP BY ALL),
xs AS (SELECT gz.*, dp.barcode, dp.depth, bc.cluster, coalesce(v, 0) AS v, coalesce(number, 20) AS number, least(greatest(coalesce(v, 0), 0), 1) AS w, coalesce(m.n, 0) AS mn, coalesce(m.wr, 0) AS mw, coalesce(m.ms, 0) AS mm,
    coalesce(a.n, 0) AS an, coalesce(a.rt, 0) AS ar, coalesce(a.ms, 0) AS am, coalesce(b.n, 0) AS bn, coalesce(b.rt, 0) AS br, coalesce(b.ms, 0) AS bm
  FROM gz JOIN dp ON dp.chrom = gz.chrom AND dp.pos = gz.pos LEFT JOIN bc ON bc.barcode = dp.barcode LEFT JOIN sv ON sv.chrom = gz.chrom AND sv.pos = gz.pos AND sv.mutant = gz.mutant AND sv.cluster = bc.cluster LEFT JOIN cn ON cn.barcode = dp.barcode
  LEFT JOIN sb m ON m.chrom = gz.chrom AND m.pos = gz.pos AND m.barcode = dp.barcode AND m.allele = gz.mutant
  LEFT JOIN sb a ON a.chrom = gz.chrom AND a.pos = gz.pos AND a.barcode = dp.barcode AND a.allele = gl[1]
  LEFT JOIN sb b ON b.chrom = gz.chrom AND b.pos = gz.pos AND b.barcode = dp.barcode AND b.allele = gl[2]),
xw AS (SELECT * EXCLUDE (w), CASE w WHEN 0 THEN 1e-5 WHEN 1 THEN 1 - 1e-5 ELSE w END AS w FROM xs),
xl AS (SELECT *, CASE WHEN an > 0 OR bn = 0 THEN exp(lgamma(an + mn + 1) - lgamma(an + 1) - lgamma(mn + 1) + ar + mw) ELSE 0 END + CASE WHEN bn > 0 THEN exp(lgamma(bn + mn + 1) - lgamma(bn + 1) - lgamma(mn + 1) + br + mw) ELSE 0 END AS lg,
    CASE WHEN an > 0 OR bn = 0 THEN exp(lgamma(an + mn + 1) - lgamma(an + 1) - lgamma(mn + 1)) * pow(w, am + mn - mm) * pow(1 - w, an + mm - am) ELSE 0 END
    + CASE WHEN bn > 0 THEN exp(lgamma(bn + mn + 1) - lgamma(bn + 1) - lgamma(mn + 1)) * pow(w, bm + mn - mm) * pow(1 - w, bn + mm - bm) ELSE 0 END AS lm, CASE WHEN v < 0.5 THEN pow(1 - 2 * v, number) ELSE 1e-5 END AS none FROM xw),
xp AS (SELECT *, an + bn + mn > 0 AS known, lm / (lg + lm) AS share, (1 - none) * lm / ((1 - none) * lm + none * lg) AS p FROM xl),
xr AS (SELECT *, CASE WHEN (mn > 0 AND share < 0.5) OR (mn = 0 AND share > 0.5) THEN 0.5 ELSE share END AS half, mn > 0 AND p > 0.5 AS hit FROM xp)"""
SPOT_GENO_ROWS = """SELECT chrom, pos, strand, germline, mutant, cluster, barcode, CASE WHEN known THEN round(1 - half, 4) END AS l_germline, CASE WHEN known THEN round(half, 4) END AS l_mosaic, CASE WHEN known THEN CASE WHEN hit THEN 'mosaic' ELSE 'germline' END END AS genotype,
  CASE WHEN known THEN CASE WHEN hit THEN '0/1' ELSE '0/0' END END AS Gi, depth, CASE WHEN known THEN round(mn / depth, 6) END AS vaf, CASE WHEN known THEN round(CASE WHEN mn = 0 THEN least(p, 0.5) ELSE p END, 4) END AS p_mosaic FROM xr"""
