"""The registered queries: every SQL has its query, and the entry runs."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["host", "pages", "mean_score", "accepted_share"] and df.count() > 0
