"""Queries against their SQL in DuckDB on the smallest tables, and the registry's shape."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["af_per_anc", "append_snp_info", "lanc_impute", "lanc_encode", "align_snp", "merge_indiv", "assoc_tractor", "assoc_joint", "grm_std", "admix_ld", "partial_pgs_ref", "hdi", "he_design", "meta_random", "liftover_map", "genetic_interp", "rfmix_range_join", "manhattan_data", "ld_prune", "clump_pairs", "clump", "residual_alleles", "kernel_growing", "liftover_table_function", "decode_table_function", "breakpoints_read", "sample_blocks_read", "rfmix_assign", "bim_read", "digits_written", "lanc_written", "table_written", "columns_appended"]


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
