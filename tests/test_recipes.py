"""Metadata, outlines, types, sub-words, baselines and recipes on small cases."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import metadata, text
from lamina.operators import predictors, recipes, segments
from lamina.sources import documents


def test_metadata_tells_null_from_missing(spark):
    rows = spark.createDataFrame([(1, '{"a": null, "b": 2}'), (2, None), (3, "[1]"), (4, "no json")], "id long, m string")
    m = metadata.parse(F.col("m"))
    got = rows.select(
        "id", metadata.has(m, "a").alias("a"), metadata.has(m, "z").alias("z"), metadata.get(m, "a", "long", F.lit(7)).alias("ga"),
        metadata.get(m, "z", "long", F.lit(7)).alias("gz"), metadata.size(m).alias("n"), metadata.to_json(m).alias("j"),
        metadata.equal(metadata.put(m, "c", F.lit("x")), metadata.put(metadata.put(m, "c", F.lit("y")), "c", F.lit("x"))).alias("same"),
    ).orderBy("id").collect()
    assert tuple(got[0]) == (1, True, False, None, 7, 2, '{"a":null,"b":2}', True)
    assert all(tuple(r)[1:] == (False, False, 7, 7, 0, "{}", True) for r in got[1:])
    with pytest.raises(ValueError):
        metadata.put(m, "not a name", F.lit(1))
    with pytest.raises(Exception, match="z not found"):
        rows.select(metadata.require(m, "z", "long")).collect()


def test_label_of_a_word(spark):
    cases = [(["B", "I"], "I"), (["B", "L"], "B"), (["I", "U", "B"], "U"), (["O", "L"], "O"), (["L"], "L"), (["O", "I"], "I"), ([], None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, a array<string>")
    assert [r[0] for r in rows.orderBy("i").select(segments.word_label(F.col("a"))).collect()] == [c[1] for c in cases]


def test_outline_is_voided_by_its_first_error(spark):
    items = spark.createDataFrame(
        [(1, 0, "a", 0, 5, "XYZ", 10.0, 50.0), (1, 1, "b", 0, None, None, None, None), (2, 0, "a", 0, 5, "XYZ", None, 1.0), (2, 1, "b", 0, 9, "XYZ", 1.0, 1.0),
         (3, 0, "a", 0, None, None, None, None), (4, 0, "a", 0, 5, "Fit", 1.0, 1.0)],
        "doc_id long, pos long, title string, level int, page_id long, kind string, left double, top double",
    )
    pages = spark.createDataFrame([(d, 5, 0, 100.0, 200.0) for d in range(1, 5)], "doc_id long, page_id long, page int, width double, height double")
    placed, errors = documents.resolve_outline(items, pages)
    assert [tuple(r) for r in placed.collect()] == [(1, 0, "a", 0, 0, 0.1, 0.75)]
    assert {tuple(r) for r in errors.collect()} == {(2, "destination location missing"), (3, "no usable destinations"), (4, "unsupported destination")}
    with pytest.raises(Exception, match="outline of document"):
        documents.resolve_outline(items, pages, raise_errors=True)[0].collect()
    assert documents.resolve_outline(items.limit(0), pages)[0].count() == 0


def test_random_letters(spark):
    rows = spark.createDataFrame([(1, 0), (2, 30), (3, None)], "k long, n int")
    got = [r[0] for r in rows.orderBy("k").select(text.random_letters(F.col("n"), F.col("k"))).collect()]
    assert got[0] == "" and len(got[1]) == 30 and got[1].islower() and len(set(got[1])) > 5 and got[2] is None
    other = rows.where("k = 2").select(text.random_letters(F.col("n"), F.col("k"), seed=1)).first()[0]
    assert other != got[1]


def test_entities_of_unknown_names(spark):
    groups = spark.createDataFrame([(1, 0), (2, 12), (3, 99), (4, None)], "id long, type int")
    assert [tuple(r) for r in predictors.entities(groups, predictors.GROTOAP2, ["title"]).collect()] == [(2, 12, "title")]
    with pytest.raises(KeyError):
        predictors.entities(groups, predictors.DOCBANK, ["nothing"])


def test_recipe_runs_its_predictors_in_order(spark):
    docs = spark.createDataFrame([(1, "a b\nc 1"), (2, None)], "doc_id long, text string")
    rows = lambda x: x["rows"].select("doc_id", "pos", "start", "end")
    recipe = recipes.CoreRecipe(
        recipes.Step(("tokens",), lambda x: x["tokens"]), recipes.Step(("words",), rows), recipes.Step(("layout",), lambda x: rows(x).where("pos = 1")),
        recipes.Step(("blocks", "equations"), lambda x: x["blocks"]),
    )
    made = recipe.from_docs(docs)
    assert sorted((r.doc_id, r.pos, r.start) for r in made["labels"].collect()) == [(1, 0, 0), (1, 1, 4), (1, 2, 4), (2, 0, 0)]
    with pytest.raises(AssertionError):
        recipes.CoreRecipe(recipes.Step(("blocks",), rows), recipe.layout, recipe.equations, recipe.labels).from_docs(docs)
