"""The registered corpus queries against SQL, and the pipeline's stages against plain Python."""

import math

import corpus_pipeline
import duckdb
import pytest

from tapewatch.llm.queries import QUERIES, SQL
from tapewatch.session import cut


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    df, rel = QUERIES[name](spark, data), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    rows = [sorted((tuple(plain(r[c.index(x)]) for x in sorted(c)) for r in found), key=repr)
            for c, found in ((df.columns, df.collect()), (rel.columns, rel.fetchall()))]
    assert rows[0] == rows[1]


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, seen, data), name)
        rows = [r.doc_id for r in out.select("doc_id").collect()]
        assert rows and set(rows) <= ids
        if name == "packed_sequences":
            assert out.filter("piece = 0").count() == seen.count()
        else:
            assert out.columns == docs.columns
            assert name == "mixed_sources" or len(rows) == len(set(rows))
            assert name != "surrogates" or set(rows) == ids
        seen, ids = out, set(rows)
