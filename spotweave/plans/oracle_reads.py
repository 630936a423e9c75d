"""DuckDB SQL for the read features: a row for each read and site first, plain windows over them afterwards."""

from __future__ import annotations

import math

_B = "ATCG"

#: A variant for each site, the reads' aligned runs and gaps by kind of CIGAR, and what a read shows at a site.
OBSERVED = r"""
si AS (SELECT DISTINCT 'chr' || (1 + p_partkey % 4) AS chrom, 1 + p_partkey % 400 AS pos, 'A' AS ref, substr('TCG', CAST(1 + (1 + p_partkey % 400) % 3 AS INT), 1) AS alt FROM part),
rn(kind, k, s, len) AS (VALUES (0, 0, 0, 40), (1, 3, 0, 20), (1, 25, 20, 15), (2, 0, 0, 10), (2, 10, 14, 20), (2, 30, 84, 10), (3, 5, 0, 15), (3, 20, 15, 1), (3, 21, 16, 17)),
gp(kind, s, len, del) AS (VALUES (1, 20, 2, false), (2, 10, 4, true)),
kd(kind, ls, rs, lh, ni) AS (VALUES (0, 0, 0, 0, 0), (1, 3, 0, 0, 1), (2, 0, 0, 0, 1), (3, 5, 2, 7, 0)),
rd AS (SELECT o_orderkey AS id, o_custkey AS cu, 'chr' || (1 + o_orderkey % 3) AS chrom, o_orderkey % 300 AS lf, o_orderkey % 4 AS kind, o_orderkey % 2 = 1 AS rev FROM orders WHERE o_custkey % 11 <> 0),
al AS (SELECT rd.*, lf + s + i + 1 AS pos, k + i AS k FROM rd JOIN rn USING (kind), unnest(range(0, len)) u(i)
       UNION ALL SELECT rd.*, lf + s + i + 1, NULL FROM rd JOIN gp USING (kind), unnest(range(0, len)) u(i) WHERE del),
hit AS (SELECT al.*, si.ref, si.alt, k IS NULL OR EXISTS (SELECT 1 FROM gp WHERE gp.kind = al.kind AND al.pos > lf + gp.s AND al.pos <= lf + gp.s + gp.len) AS gone,
          EXISTS (SELECT 1 FROM rn WHERE rn.kind = al.kind AND al.pos + 1 > lf + rn.s AND al.pos + 1 <= lf + rn.s + rn.len) AS goes FROM al JOIN si USING (chrom, pos)),
ob AS (SELECT chrom, pos, ref, alt, 'BC' || (cu % 50) AS barcode, CAST(id % 10 AS VARCHAR) AS umi, gone, rev AS is_reverse, lf, id % 7 AS nm, id % 4 * 85 AS mq, CASE WHEN cu % 13 = 0 THEN 3 ELSE 1 END AS nh, ls + rs AS soft, ni,
         CASE WHEN NOT gone THEN substr(repeat('ACGTTGCAN', 9), CAST(1 + cu % 9 + k AS BIGINT), 1) END AS base, CASE WHEN NOT gone THEN (k * 7 + id) % 45 END AS qual, CASE WHEN NOT gone AND goes THEN ((k + 1) * 7 + id) % 45 END AS nq,
         k + lh AS qp, (40 - ls - rs) - (k - ls) + rs AS sp, CASE WHEN rev THEN (40 - ls - rs) - (k - ls) ELSE k - ls END / (40 - ls - rs) AS es
       FROM hit JOIN kd USING (kind) WHERE gone OR (k * 7 + id) % 45 <= 40),
ev AS (SELECT * FROM ob WHERE base IN ('A', 'T', 'C', 'G'))"""

ERFC = f"""CASE WHEN x < 0.05 THEN 1 - 2 / sqrt(pi()) * (x - x ** 3 / 3 + x ** 5 / 10 - x ** 7 / 42 + x ** 9 / 216)
  ELSE x * exp(-x * x) / pi() * (0.5 / (x * x) + {" + ".join(f"exp(-{k * k / 4}) / (x * x + {k * k / 4})" for k in range(1, 14))}) + CASE WHEN x < {2 * math.pi!r} THEN 2 / (1 - exp({4 * math.pi!r} * x)) ELSE 0 END END"""

_N = {b: f"n{b}" for b in _B}


def _of(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{b}' THEN n{b}" for b in _B) + " END"


_RANKED = ("baseq", "alt_baseq1b", "querypos", "leftpos", "seqpos", "per_UMI_end_remove_clip", "mismatches", "mapq", "read_number", "softclip_length")
_GREATER = "('baseq', 'alt_baseq1b', 'mapq')"
_TESTS = (*_RANKED, "softclip_prop", "reads_with_indel", "multi_mapper", "strand_bias")


def read_features(consensus: str) -> str:
    """SQL of the query; consensus: the CTEs um to cs over ev (chrom, pos, ref, barcode, umi, base, qual, is_reverse)."""
    reads = {"baseq": "qual", "querypos": "qp", "leftpos": "lf", "seqpos": "sp", "mismatches": "CASE WHEN base = alt THEN greatest(nm - 1, 0) ELSE nm END", "mapq": "mq", "softclip_length": "soft"}
    values = [f"SELECT chrom, pos, ref, alt, '{n}' AS t, CAST({c} AS DOUBLE) AS v, base = ref AS x FROM ev WHERE base IN (ref, alt)" for n, c in reads.items()]
    values += ["SELECT chrom, pos, ref, alt, 'alt_baseq1b', CAST(nq AS DOUBLE), true FROM ev WHERE base = alt AND nq IS NOT NULL", "SELECT chrom, pos, ref, alt, 'alt_baseq1b', CAST(qual AS DOUBLE), false FROM ev WHERE base = alt"]
    values += ["SELECT chrom, pos, ref, alt, 'per_UMI_end_remove_clip', es, allele = ref FROM mo WHERE allele IN (ref, alt)"]
    values += [f"SELECT chrom, pos, ref, alt, 'read_number', {_of(c)}, {c == 'ref'!s} FROM mo WHERE {_of(c)} > 0" for c in ("ref", "alt")]
    fisher = lambda a, b, c, d: f"""(SELECT least(1.0, sum(p) FILTER (p <= own * (1 + 1e-7))) FROM (SELECT exp(l) AS p, exp(max(l) FILTER (k = {a}) OVER ()) AS own FROM (SELECT k, lgamma({a} + {b} + 1.0) + lgamma({c} + {d} + 1.0) + lgamma({a} + {c} + 1.0) + lgamma({b} + {d} + 1.0)
      - lgamma({a} + {b} + {c} + {d} + 1.0) - lgamma(k + 1.0) - lgamma({a} + {b} - k + 1.0) - lgamma({a} + {c} - k + 1.0) - lgamma({d} - {a} + k + 1.0) AS l FROM unnest(range(greatest(0, {a} - {d}), least({a} + {b}, {a} + {c}) + 1)) u(k))))"""  # noqa: E731
    exact = {"softclip_prop": ("soft > 10", True), "reads_with_indel": ("ni > 0", False), "multi_mapper": ("nh <> 1", False), "strand_bias": ("is_reverse", False)}
    cells = ", ".join(f"count(*) FILTER (base = {s} AND {'' if y else 'NOT '}({c})) AS {n}_{s}_{'y' if y else 'n'}" for n, (c, _) in exact.items() for s in ("alt", "ref") for y in (True, False))
    tests = ", ".join((f"CASE WHEN nr > 0 AND na > 0 THEN {{}} END" if guard else "{}").format(fisher(f"{n}_alt_y", f"{n}_alt_n", f"{n}_ref_y", f"{n}_ref_n")) + f" AS {n}_p" for n, (_, guard) in exact.items())
    pivot = ", ".join(f"max(p) FILTER (t = '{n}') AS {n}_p, max(rbc) FILTER (t = '{n}') AS {n}_rbc" for n in _RANKED)
    long = " UNION ALL ".join(f"SELECT chrom, pos, ref, alt, '{n}' AS t, {n}_p AS p FROM wd" for n in _TESTS)
    final = ", ".join(f"round(wd.{n}_p, 9) AS {n}_p, round(bh.{n}_p_adj, 9) AS {n}_p_adj" + (f", round(wd.{n}_rbc, 9) AS {n}_rbc" if n in _RANKED else "") for n in _TESTS)
    alt = _of("alt")
    umis = ", ".join(f"""round(avg({alt} / reads) FILTER ({alt} > 0{w}), 9) AS alt_UMI_avg_consistence{s}, round(avg(CAST({alt} = reads AS INT)) FILTER ({alt} > 0{w}), 9) AS alt_consistent_UMI_prop_strict{s},
      round(avg(CAST({alt} / reads >= 0.75 AS INT)) FILTER ({alt} > 0{w}), 9) AS alt_consistent_UMI_prop_relaxed{s}""" for s, w in (("", ""), ("_remove_single_read", " AND reads >= 2")))
    second = "arg_max(b, struct_pack(d := d, i := -i))"
    return f"""WITH {OBSERVED}{consensus},
mo AS (SELECT cs.*, e.alt, e.es FROM cs JOIN (SELECT chrom, pos, ref, alt, barcode, umi, median(es) AS es FROM ev GROUP BY ALL) e USING (chrom, pos, ref, barcode, umi)),
va AS ({' UNION ALL '.join(values)}),
rk AS (SELECT *, rank() OVER (PARTITION BY chrom, pos, ref, alt, t ORDER BY v) + (count(*) OVER (PARTITION BY chrom, pos, ref, alt, t, v) - 1) / 2 AS r FROM va),
su AS (SELECT chrom, pos, ref, alt, t, CAST(count(*) FILTER (x) AS DOUBLE) AS n, CAST(count(*) FILTER (NOT x) AS DOUBLE) AS m, sum(r) FILTER (x) AS r FROM rk GROUP BY ALL),
zs AS (SELECT *, (r - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12) AS z, abs((r - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12)) / sqrt(2) AS x FROM su WHERE n > 0 AND m > 0),
ps AS (SELECT *, {ERFC} AS e, 2 * (r - n * (n + 1) / 2) / (n * m) - 1 AS rbc FROM zs),
pp AS (SELECT *, CASE WHEN t NOT IN {_GREATER} THEN least(1.0, e) WHEN z >= 0 THEN e / 2 ELSE 1 - e / 2 END AS p FROM ps),
pv AS (SELECT chrom, pos, ref, alt, {pivot} FROM pp GROUP BY ALL),
ce AS (SELECT chrom, pos, ref, alt, count(*) AS dp, count(*) FILTER (gone) AS del, count(*) FILTER (base = ref) AS nr, count(*) FILTER (base = alt) AS na, count(*) FILTER (base = ref AND mq = 255) AS rq, count(*) FILTER (base = alt AND mq = 255) AS aq, {cells},
  avg(qual) FILTER (base = ref) AS rb, avg(qual) FILTER (base = alt) AS ab, avg(qual) FILTER (base IN (ref, alt)) AS bb, avg(nm) FILTER (base = ref) AS rm, avg(greatest(nm - 1, 0)) FILTER (base = alt) AS am, count(DISTINCT qp) FILTER (base = alt) AS qn FROM ob GROUP BY ALL),
wd AS (SELECT ce.*, pv.* EXCLUDE (chrom, pos, ref, alt), {tests} FROM ce LEFT JOIN pv USING (chrom, pos, ref, alt)),
lo AS (SELECT *, rank() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY p) + count(*) OVER (PARTITION BY chrom, pos, ref, alt, p) - 1 AS k, count(*) OVER (PARTITION BY chrom, pos, ref, alt) AS n FROM ({long}) WHERE p IS NOT NULL),
ad AS (SELECT *, least(1.0, min(p * n / k) OVER (PARTITION BY chrom, pos, ref, alt ORDER BY p DESC)) AS q FROM lo),
bh AS (SELECT chrom, pos, ref, alt, {', '.join(f"max(q) FILTER (t = '{n}') AS {n}_p_adj" for n in _TESTS)} FROM ad GROUP BY ALL),
um2 AS (SELECT chrom, pos, ref, alt, max({alt}) AS alt_read_number_perUMI_max, {umis}, round(avg(es) FILTER (allele = alt), 9) AS per_alt_UMI_end_remove_clip_mean, round(median(es) FILTER (allele = alt), 9) AS per_alt_UMI_end_remove_clip_median FROM mo GROUP BY ALL),
a2 AS (SELECT chrom, pos, ref, alt, {second} AS b FROM (SELECT si.*, l.b, l.i, (SELECT count(*) FROM ev WHERE ev.chrom = si.chrom AND ev.pos = si.pos AND ev.base = l.b) AS d FROM si, (VALUES ('A', 0), ('T', 1), ('C', 2), ('G', 3)) l(b, i) WHERE l.b NOT IN (si.ref, si.alt)) GROUP BY ALL),
al2 AS (SELECT mo.chrom, mo.pos, mo.ref, mo.alt, round(avg({_of('a2.b')} / reads) FILTER ({_of('a2.b')} > 0), 9) AS alt2_proportion_per_UMI FROM mo JOIN a2 USING (chrom, pos, ref, alt) GROUP BY ALL)
SELECT wd.chrom, wd.pos, wd.ref, wd.alt, wd.dp, {final},
  CASE WHEN nr > 0 THEN round(multi_mapper_ref_y / nr, 9) END AS ref_multi_map_prop, CASE WHEN na > 0 THEN round(multi_mapper_alt_y / na, 9) END AS alt_multi_map_prop, CASE WHEN nr + na > 0 THEN round((multi_mapper_ref_y + multi_mapper_alt_y) / (nr + na), 9) END AS multi_map_prop,
  CASE WHEN nr > 0 THEN round(rq / nr, 9) ELSE 0 END AS ref_mapq255_prop, CASE WHEN na > 0 THEN round(aq / na, 9) ELSE 0 END AS alt_mapq255_prop, CASE WHEN nr + na > 0 THEN round((rq + aq) / (nr + na), 9) ELSE 0 END AS mapq255_prop,
  round(del / dp, 9) AS indel_proportion_for_site, alt2_proportion_per_UMI, CASE WHEN nr > 0 THEN round(softclip_prop_ref_y / nr, 9) END AS ref_softclip_prop, CASE WHEN nr > 0 AND na > 0 THEN round(softclip_prop_alt_y / na, 9) END AS alt_softclip_prop,
  CASE WHEN nr > 0 AND na > 0 THEN round((softclip_prop_ref_y + softclip_prop_alt_y) / (nr + na), 9) END AS softclip_prop, round(rb, 9) AS ref_baseq_mean, round(ab, 9) AS alt_baseq_mean, round(bb, 9) AS baseq_mean, round(rm, 9) AS ref_mismatches_mean, round(am, 9) AS alt_mismatches_mean, qn AS alt_querypos_num,
  um2.* EXCLUDE (chrom, pos, ref, alt)
FROM wd LEFT JOIN bh USING (chrom, pos, ref, alt) LEFT JOIN um2 USING (chrom, pos, ref, alt) LEFT JOIN al2 USING (chrom, pos, ref, alt)"""
