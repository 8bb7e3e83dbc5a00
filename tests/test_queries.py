"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from lagwise.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query at least of each family; the whole list takes minutes.
CHOSEN = [
    "s06_paired_entities", "s08_ingest_report", "c04_finite_values", "c05_interpolate", "c07_standardise", "c11_text_label", "c13_long_enough", "c14_check_lengths",
    "w01_sliding_windows", "w02_environments", "w03_lag_windows", "w05_chunks", "e01_segments", "e04_user_ranges", "e06_median_length", "e09_merge_buffered", "e10_soft_labels", "e11_soft_labels_share",
    "flagship_rank_quality", "q05_point_adjust", "q06_adjusted_f1", "q10_range_f1", "q18_affiliation_f", "q19_vus", "q21_range_auc", "q21_range_auc_share", "q22_vus_of_predictions", "q23_classic_report", "q23_report_of_predictions", "q29_batch_affiliation", "q01_evaluation_slice", "p03_transfer_entropy", "p11_graph_prior", "p15_density", "p14_priors_to_compute", "p14_stored_priors",
    "f05_forecast", "f07_reference", "f08_gain_references", "i01_permuted_source", "i03_drawn_edges", "i05_rollups", "m02_edge_monitors", "g05_weight_deviation", "g07_robust_scale", "g10_scored_quality", "q14_affiliation_zones", "g09_timeline", "u01_applied_model",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def ordered(rows, columns):
    """Rows of values by column name, by what is not a float first: floats may differ in their last places."""
    rows = [[r[c] for c in columns] for r in rows]
    return sorted(rows, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), repr([round(v, 4) for v in r if isinstance(v, float)])))


def alike(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = ordered([r.asDict() for r in df.collect()], columns)
    expected = ordered([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)
    assert len(got) == len(expected)
    assert all(alike(x, y) for a, b in zip(got, expected, strict=True) for x, y in zip(a, b, strict=True))


def test_planted_confounders_are_found_and_used(spark, con):
    for name in ("p05_driven_confounders", "p04_driven_conditional_entropy", "p06_driven_conditional_prior"):
        test_against_sql(spark, con, name)
    assert con.sql(registry.ORACLES["p04_driven_conditional_entropy"]).fetchall()


def test_every_query_but_three_fits_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"f06_ridge_values", "f06_weighted_values", "p12_lag_graph"}


def test_entry_points(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(registry.QUERIES) > 90
    assert __spark_entry__.entry(spark).count() > 0
