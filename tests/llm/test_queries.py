"""The registered queries: their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from emberlog.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.project(", ".join(columns)).fetchall(), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    now, kept = docs, set(before)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        ids = {r["doc_id"] for r in now.collect()}
        assert ids <= kept and (ids == kept) == (name == "pii")
        kept = ids
    last = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(last) == kept
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect() if r["text"] != before[r["doc_id"]]["text"])
