"""The table function and the format of documents against their DataFrame forms."""

import json

import pytest
from pyspark.sql import functions as F

from lamina.operators import layers, table_functions
from lamina.sources import document_format, documents

TEXTS = [(1, "A b. C d!\ne\n\nf"), (2, None), (3, ""), (None, "x y"), (4, "é 𝒳. " * 300 + "\n" * 90), (5, "same"), (5, "same")]


@pytest.mark.parametrize("layer", sorted(table_functions.COLUMNS))
def test_table_function_is_the_dataframe_form(spark, layer):
    table_functions.register(spark)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").where("doc_id is null or doc_id < 5")
    docs.withColumn("pos", F.lit("clash")).createOrReplaceTempView("texts_of_test")
    got = spark.sql(f"SELECT * FROM layer_of(TABLE(texts_of_test) PARTITION BY (doc_id), '{layer}')")
    spread = layers.spread(docs)
    want = layers.pages(layers.rows(spread)) if layer == "pages" else getattr(layers, layer)(spread)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda rows: sorted(tuple(str(r[c]) for c in columns) for r in rows.collect())
    assert key(got) == key(want)


def test_table_function_of_odd_arguments(spark):
    table_functions.register(spark)
    spark.createDataFrame(TEXTS, "doc_id long, text string").createOrReplaceTempView("texts_of_test")
    assert spark.sql("SELECT * FROM layer_of(TABLE(texts_of_test) PARTITION BY (doc_id), 'tokens') WHERE doc_id = 5").count() == 2
    assert spark.sql("SELECT * FROM layer_of(TABLE(SELECT * FROM texts_of_test WHERE false) PARTITION BY (doc_id), 'rows')").count() == 0
    for sql in ("layer_of(TABLE(texts_of_test) PARTITION BY (doc_id), 'chapters')", "layer_of(TABLE(SELECT 1 AS a), 'rows')"):
        with pytest.raises(Exception, match="no such layer|doc_id and text are wanted"):
            spark.sql(f"SELECT * FROM {sql}").collect()


BOX = {"left": 0.1, "top": 0.2, "width": 0.3, "height": 0.4, "page": 1}
DOCUMENTS = {
    "a.json": {"symbols": "one two", "metadata": {"k": "v"}, "images": [], "tokens": [
        {"spans": [{"start": 0, "end": 3, "box": BOX}], "id": 0, "metadata": {"type": "word", "text": "one"}}, {"spans": [{"start": 4, "end": 7}], "id": 1},
    ], "boxes": [{"spans": [], "box_group": {"boxes": [BOX, BOX]}, "type": "old", "text": "form"}]},
    "b.json": {"symbols": "é\n𝒳", "rows": []},
    "c.json": {"symbols": ""},
}


def test_round_trip_is_the_dataframe_form(spark, tmp_path):
    spark.dataSource.register(document_format.DocumentFormat)
    folder = str(tmp_path / "docs")
    rows = spark.createDataFrame([(n, json.dumps(d)) for n, d in DOCUMENTS.items()], "file string, json string")
    rows.repartition(2).write.format("layered_documents").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "docs").iterdir()) == sorted(DOCUMENTS)
    read = lambda **o: spark.read.format("layered_documents").options(filesPerTask=2, **o).load(folder)
    assert {r.file: r.symbols for r in read().collect()} == {n: d["symbols"] for n, d in DOCUMENTS.items()}
    assert read().rdd.getNumPartitions() == 2
    native = documents.annotations(documents.parse(rows.withColumnRenamed("file", "doc_id"))).withColumnRenamed("doc_id", "file")
    key = lambda df: sorted(str(r) for r in df.select(*sorted(native.columns)).collect())
    assert key(read(layers="*")) == key(native) and len(key(native)) == 3
    assert key(read(layers="tokens,none")) == key(native.where("field = 'tokens'"))


def test_stream_and_bad_rows(spark, tmp_path):
    spark.dataSource.register(document_format.DocumentFormat)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        q = spark.readStream.format("layered_documents").option("layers", "*").load(str(folder))
        q.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).format("parquet").start(out).awaitTermination()

    for name in ("a.json", "b.json"):
        (folder / name).write_text(json.dumps(DOCUMENTS[name]))
    run()
    assert spark.read.parquet(out).count() == 3
    (folder / "c.json").write_text(json.dumps(DOCUMENTS["a.json"]))
    run()
    assert sorted(r["count"] for r in spark.read.parquet(out).groupBy("file").count().collect()) == [3, 3]
    bad = spark.createDataFrame([("../x.json", "{}")], "file string, json string")
    with pytest.raises(Exception, match="no name for a document"):
        bad.write.format("layered_documents").mode("append").save(str(folder))


def test_images_are_one_line(spark):
    import base64

    from lamina.sources import documents

    sizes = (0, 1, 57, 58, 300)
    files = spark.createDataFrame([(n, 0, bytearray(range(n % 256)) * (1 + n // 256)) for n in sizes], "doc_id long, page int, content binary")
    found = {r.doc_id: r.content for r in documents.images(files).collect()}
    assert found == {r.doc_id: base64.b64encode(bytes(r.content)).decode() for r in files.collect()}
