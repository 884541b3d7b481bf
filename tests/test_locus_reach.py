"""Links reach as far as the operators do, not as far as a query's window."""
import datetime

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def far(spark, tmp_path):
    """Two signups and a click of one user class: 100,000 s from one, 400,000 s from the other."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(0), 22, "signup", 5.0), (2, at(503_600), 44, "signup", 5.0), (3, at(103_600), 0, "click", 5.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def both(spark, far, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, far)
    order = [[d[0] for d in cur.description].index(c) for c in got.columns]
    return sorted(tuple(r) for r in got.collect()), sorted(tuple(r[i] for i in order) for r in cur.fetchall())


def test_link_prob_lists_far_links(spark, far):
    got, want = both(spark, far, "link_prob")
    assert got == want == [(3, 1, 0.109291)]


def test_signal_entity_prob_lists_far_links(spark, far):
    got, want = both(spark, far, "signal_entity_prob")
    assert got == want == [("0:2", 1, 0.9)]
