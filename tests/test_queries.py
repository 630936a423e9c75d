"""Some queries against their SQL, at the smallest size; the driver holds all of them."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from spotweave.plans.oracle import ORACLE_SQL
from spotweave.plans.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x) -> str:
    """A value as text, whatever type pandas gives a column that has nulls."""
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    return repr(float(x)) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["interval_join_gene_het", "interval_join_cluster_region", "interval_subtract_bed", "asof_mappability", "win_merge_intervals", "win_gap_sessionize", "umi_consensus", "join_cluster_vaf_calc", "interval_left_gene", "rule_filtration", "umi_event_explode", "filter_reads_quality", "filter_reads_by_barcode", "filter_ase_germline", "join_prior_lookup", "RNA_editing", "agg_phase_haplotypes", "haplotype_balance_gate", "discordant_prop", "fisher_2x2", "read_features", "signature_fit", "hFDR", "phase_classify", "mutation_origin", "cluster_events", "agg_phase_summary", "agg_site_spatial", "individual_posterior", "join_prior_left", "join_wide_features", "set_except", "sample_reservoir", "umi_histogram", "spot_histogram", "cluster_histogram", "allele_filter_histogram", "individual_histogram", "individual_genotype", "individual_germline", "spot_genotype"])
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, str(FOLDER)).toPandas()[list(want.columns)]
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_germline_site_without_a_third_allele(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_orderkey % 97 < 90").write.parquet(f"{tmp_path}/lineitem.parquet")  # the others have the third alleles
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["cross_mosaic_hsnp"](spark, str(tmp_path)).select("chrom", "region", "pos", "snp_pos").collect())
    assert got and got == sorted(c.sql(ORACLE_SQL["cross_mosaic_hsnp"]).fetchall())
    assert {r[3] for r in got} == {1000 + 4 * s for s in range(11, 60, 12)}
