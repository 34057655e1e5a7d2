"""A cross-section of registered queries against their SQL, at the smallest size."""

import os

import duckdb
import pytest

from platewise import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
NAMES = [
    "flagship_treatment_profiles",
    "b09_b12_flag_wells",
    "c01_metadata_join",
    "c04_match_proteins",
    "c13_as_of",
    "d09_normalised",
    "d10_control_statistics",
    "d13_correct_robust",
    "d13_correct_reference",
    "d20_spearman_matrix",
    "d36_pearson",
    "e04_rank",
    "g07_merge_keep_last",
    "h07_dipeptides",
    "h09_isoelectric_point",
    "h10_instability",
    "i08_enrichment",
    "i09_farthest_points",
    "i24_random_split",
    "i32_curation",
    "i32_training_set",
    "d28_curation_report",
    "i04_linkage_cuts",
    "i06_silhouettes",
    "i10_kmeans_parallel",
    "i12_dpp",
    "i14_hybrid",
    "i15_batch_greedy",
    "e01_rolling_percentile",
    "j03_j06_drift",
    "a03_load_plates",
    "a05_a13_fasta",
    "d47_pool_tokens",
    "h32_h33_fuse_weighted",
]


def plain(x):
    if isinstance(x, float):
        return repr(float(x) + 0.0)
    return str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    res = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == order
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in res.fetchall())
    assert got == want


def test_every_query_has_a_docstring_or_sql():
    for name, f in catalog.queries().items():
        assert name in catalog.oracle_sql() or f.__doc__ or name[0] in "hij", name
