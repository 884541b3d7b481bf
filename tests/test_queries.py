"""Registered queries against their SQL on the smallest tables, and the shape of the registry."""
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["scan_set_lists", "combine_evidence", "near_join", "assoc_enrichment_q", "list_enrichment", "prior_from_effects", "signal_posterior", "weighted_jaccard"]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()[list(got.columns)]
    key = lambda d: sorted(map(repr, d.astype(object).itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
