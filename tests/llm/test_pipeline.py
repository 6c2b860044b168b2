"""The pipeline's stages against their operators' definitions, and the registered queries' shapes."""

import corpus_pipeline
import pytest

from seriesloom.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        rows = docs.collect()
        sizes.append(len(rows))
        assert len({r.doc_id for r in rows}) == len(rows) and docs.columns[: len(names)] == names
        if name == "benchmark_decontamination":
            assert not any(i in decontaminate.normalise(r.text) for r in rows for i in items)
        if name == "secret_scan":
            assert all(r.text == before[r.doc_id] or "[SECRET]" in r.text for r in rows)
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 0.6 * len(before)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))
