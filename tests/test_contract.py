"""The driver's contract, and a cross-section of queries against DuckDB at the smallest scale."""

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
CROSS_SECTION = ["D2_kpi_block", "D6_quality_report", "D12_concentration", "D15_discount_given", "E1_rfm_scores", "C1_fact_view", "C5_find_relationships",
                 "I8_impute", "I11_harmonize_categories", "D23_customer_features", "K2_feature_panel", "L4_pruned_slices", "J17_backtest", "C16_as_of_join",
                 "B7_deliver_findings", "A13_replace_snapshot", "O3_customer_counters", "C20_figure_to_source"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", CROSS_SECTION)
def test_against_duckdb(spark, name):
    got = check_oracle.frame(entry.queries()[name](spark, SF))
    rel = check_oracle.duck(SF).execute(entry.oracle_sql()[name])
    want = pd.DataFrame(rel.fetchall(), columns=[d[0] for d in rel.description], dtype=object)
    assert check_oracle.compare(got, want) is None
