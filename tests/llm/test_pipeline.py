"""Stages on odd rows, and the registered queries with SQL on the smallest tables."""
import os

import corpus_pipeline
import duckdb
import pytest
from cases import no_documents, odd_documents

from evisets.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        own = docs
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, "")
            if name != "bpe":
                assert docs.columns == own.columns, name
            if name == "pii":
                assert docs.count() == before.count()
        docs.collect()
    kept = corpus_pipeline.language_id(spark, odd_documents(spark), "")
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 7, 8, 9, 11, 12}
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, kept, "").collect()} - {11} == {None, 1, 7, 8, 9, 12}  # 2 copies 1, 11 is near it


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(sorted(zip(names, r, strict=True))) for r in cursor.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in got.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_all_queries_return_rows(spark):
    for name, q in {**queries.QUERIES, **corpus_pipeline.QUERIES}.items():
        assert q(spark, SF).count() > 0, name
