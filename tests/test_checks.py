"""Registered queries against their SQL twins on the smallest tables, one per operator family."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry_module

sys.path.insert(0, "tools")
from tools.check_queries import TABLES, normal, same  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "code26_metric_row", "code19_penalty_details", "code16_flow_elements", "agg1_average_metrics", "agg2_variant_totals",
    "prm8_scored_prompts", "prm9_standard_prompt", "sim4_tfidf_cosine", "sim5_bm25", "sim6_embedding_cosine", "cor4_bleu",
    "agg5_pair_moments", "agg6_metric_moments", "agg8_group_statistics", "st1_shapiro_w", "st5_mann_whitney_u", "st16_qq_points",
    "st17_histogram", "st18_density", "win2_ranking", "win7_stratified_sample", "blk5_manifest", "join5_prefix_match",
    "src4_row_range", "snk3_streamed_scores",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = normal(entry_module.queries()[name](spark, FOLDER).toPandas())
    want = normal(duck.execute(entry_module.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    different = [(c, i) for c in got.columns for i in range(len(got)) if not same(got[c][i], want[c][i])]
    assert different == []


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs(spark):
    assert entry_module.entry(spark).filter("column_name = 'TOTAL'").count() == 1
