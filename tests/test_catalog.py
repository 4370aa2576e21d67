"""Registered queries equal their SQL twins (a fast selection; ``python verify.py`` runs all of them)."""

import duckdb
import pytest

import __spark_entry__ as entry
from verify import TABLES, rows

FAST = (
    "extracted_ids", "parsed_times", "time_features", "risk_reasons", "conformed_features", "hashed_emails", "hashed_phones", "hashed_addresses_v4",
    "asof_forward_else_backward", "flagged_rate_by_hour", "propagated_flag", "overlap_remove_both", "encoded_categories", "related_by_identity",
    "entity_profiles", "median_imputed", "price_histogram", "rate_by_membership", "first_event_per_status", "identity_history", "precision_at_k",
    "temporal_split", "expanding_windows", "row_fraction_folds", "ranking_metrics_by_window", "best_f1_threshold", "population_stability",
    "sharing_edges", "link_counts_before_event", "cluster_features", "class_rules", "review_queue", "merged_feeds",
)


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql_twin(spark, db, folder, name):
    df = entry.queries()[name](spark, folder)
    cursor = db.execute(entry.oracle_sql()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_twin_belongs_to_a_query_and_entry_runs(spark):
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 150
    assert entry.entry(spark).count() > 0
