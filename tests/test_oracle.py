"""Queries against their SQL.  METERBOOK_ALL=1 runs every query, METERBOOK_SF another folder."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from meterbook import catalog

FOLDER = os.environ.get("METERBOOK_SF", "/root/testdata/sf0.001")
SAMPLE = """w01_running_cost a01_daily_by_supplier w03_ranked_sessions w04_cumulative_share a09_weekday_hours a16_reconstruction a24_quota
a25_usage_by_client a26_plugins a28_concentration a33_rollout_stats f03_append_counts_by_user f06_scoped_switch p06_repository p08_project_alias p12_event_id
j10_device_labels j11_ambiguous_points j14_worktree_parents u01_ledger_union u03_exact_dedup u04_near_time_dedup u05_multiset_merge s03_portable_csv
s04_session_export s10_device_ledgers s13_report_sink q02_label_rules q08_dates q23_secret_scan v04_project_periods v06_date_hours
u03_null_swapped_copies s03_csv_column_orders s14_escaped_fields q03_undated_times q06_large_amounts q13_sessions_in_texts q13_paths_in_arrays
p11_shared_prefix p19_blank_spellings a18_merge_balance a18_merge_unbalanced s12_ledger_round_trip u06_merge_ledgers u06_refused_ambiguous
u06_refused_zones u06_merge_records""".split()
ALL = list(entry.oracle_sql())
NAMES = ALL if os.environ.get("METERBOOK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    if not os.path.exists(f"{FOLDER}/events.parquet"):
        pytest.skip("test tables are not there")
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) == []


def test_every_query_has_sql():
    catalog.load()
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_runs(spark, duck):
    frame = entry.entry(spark)
    assert frame.count() > 0 and "cumulative_cost" in frame.columns
