"""Every query with SQL gives what DuckDB gives, at the smallest size."""

import math
import os

import duckdb
import pytest

from lamina.plans import alignment_queries, document_queries, feature_queries, recipe_queries, registry, table_queries, window_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [same(x) for x in v]
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted({*registry.QUERIES, *registry.FIXTURES}))
def test_query(spark, duck, name):
    made, sql = registry.FIXTURES.get(name) or (registry.QUERIES[name], registry.ORACLES.get(name))
    df = made(spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(str([same(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(str([same(r[i]) for i in at]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_read_tables(spark, name):
    with pytest.raises(Exception, match="(?i)path.*not.*exist|no such file"):
        registry.QUERIES[name](spark, "/nowhere").collect()


def test_stream_of_documents(spark, tmp_path):
    from lamina.operators import layers
    from lamina.streaming.ingest import stream_layer

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(source)
    run = lambda: stream_layer(
        spark, source, "doc_id long, text string", lambda b: layers.tokens(layers.spread(b)), str(tmp_path / "out"), str(tmp_path / "ck")
    ).awaitTermination()
    run()
    spark.createDataFrame([(3, "d e f")], "doc_id long, text string").write.mode("append").parquet(source)
    run()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list("abcdef")
