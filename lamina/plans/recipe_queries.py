"""Queries over metadata, outlines, types, sub-words, baselines and the composed recipe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import metadata, text
from lamina.operators import predictors, recipes, segments
from lamina.plans.registry import query, table, with_layers
from lamina.plans.table_queries import _BILOU, _TURNS, _pick, _turns
from lamina.sources import documents


@query("""
    SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, false AS has_z, (props->>'$.k')::BIGINT AS k, -1::BIGINT AS z,
           array_to_string(list_sort(list_append(coalesce(json_keys(props), []), 'source')), ',') AS names,
           (len(coalesce(json_keys(props), [])) + 1)::INT AS n, '{"source":"' || event_type || '"}' AS rest, true AS same FROM events""")
def metadata_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading, adding and removing names in the metadata of events."""
    m = metadata.parse(F.col("props"))
    more = metadata.put(m, "source", F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", metadata.has(m, "k").alias("has_k"), metadata.has(m, "z").alias("has_z"), metadata.get(m, "k", "bigint").alias("k"),
        metadata.get(m, "z", "bigint", F.lit(-1).cast("bigint")).alias("z"), F.array_join(F.array_sort(metadata.names(more)), ",").alias("names"),
        metadata.size(more).alias("n"), metadata.to_json(metadata.without(more, "k")).alias("rest"),
        metadata.equal(metadata.put(metadata.without(more, "k"), "k", metadata.get(m, "k", "bigint")), more).alias("same"),
    )


_PARTS = ", ".join(f"{_BILOU}[(doc_id * 3 + pos * 5 + {i} * 3) % 8 + 1]" for i in range(3))


@query(f"""{_TURNS}, a AS (SELECT doc_id, pos, [{_PARTS}] AS a FROM t)
    SELECT doc_id, pos, CASE WHEN list_contains(a, 'B')::INT + list_contains(a, 'L')::INT + list_contains(a, 'U')::INT > 1
                             THEN list_filter(a, lambda x: x <> 'I' AND x <> 'O')[1]
                             WHEN list_contains(a, 'I') THEN 'I' ELSE a[1] END AS label FROM a""")
def labels_of_subwords_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as words of three labelled parts each."""
    parts = _turns(spark, sf_dir).select("doc_id", "pos", F.explode(F.array(*map(F.lit, range(3)))).alias("part"))
    return segments.labels_of_words(parts.withColumn("label", _pick(_BILOU, "doc_id * 3 + pos * 5 + part * 3")), "doc_id", "pos", "part")


_NAMES = list(predictors.DOCBANK)


@query(f"""{_TURNS}, n AS (SELECT doc_id, pos, (doc_id * 5 + pos) % 13 AS type, {_NAMES}[(doc_id * 5 + pos) % 13 + 1] AS name FROM t)
    SELECT * FROM n WHERE name IN ('title', 'abstract', 'section')""")
def entities_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as groups of numbered types."""
    groups = _turns(spark, sf_dir).select("doc_id", "pos", F.expr("(doc_id * 5 + pos) % 13").alias("type"))
    return predictors.entities(groups, predictors.DOCBANK, ["title", "abstract", "section"])


@query("SELECT p_partkey, length(p_name)::INT AS n, true AS letters, true AS again FROM part")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by chance, as long as the text that a system is to find."""
    made = text.random_letters(F.length("p_name"), F.col("p_partkey"))
    again = text.random_letters(F.length("p_name"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.length(made).alias("n"), made.rlike("^[a-z]*$").alias("letters"), (made == again).alias("again")
    )


_ITEM = [
    "CASE WHEN doc_id % 11 = 0 OR (doc_id + pos) % 3 = 0 THEN NULL ELSE pos % 4 END AS page_id",
    "CASE WHEN (doc_id * 5 + pos) % 23 = 0 THEN 'Fit' WHEN pos % 2 = 0 THEN 'FitR' ELSE 'XYZ' END AS kind",
    "CAST(pos AS DOUBLE) AS x",
    "CASE WHEN (doc_id + pos * 3) % 29 = 0 THEN NULL ELSE CAST(pos * 10 AS DOUBLE) END AS y",
]
_OUTLINE = f"""{_TURNS}, i AS (SELECT doc_id, pos, {', '.join(_ITEM)} FROM t),
    e AS (SELECT *, page_id IS NOT NULL AS leads,
        CASE WHEN page_id IS NULL THEN NULL WHEN page_id = 3 AND doc_id % 7 = 0 THEN 'page missing'
             WHEN kind = 'XYZ' AND y IS NULL THEN 'destination location missing' WHEN kind = 'Fit' THEN 'unsupported destination' END AS problem FROM i),
    s AS (SELECT doc_id, coalesce(arg_min(problem, pos) FILTER (problem IS NOT NULL), CASE WHEN NOT bool_or(leads) THEN 'no usable destinations' END) AS error
          FROM e GROUP BY 1)"""


def _outline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as items of an outline, to pages of 200 by 400; every seventh document lacks its last page."""
    items = _turns(spark, sf_dir).withColumnRenamed("role", "title").selectExpr("doc_id", "pos", "title", "0 AS level", *_ITEM)
    items = items.withColumnsRenamed({"x": "left", "y": "top"})
    pages = items.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page")).where("page < 3 OR doc_id % 7 <> 0")
    pages = pages.select("doc_id", F.col("page").alias("page_id"), "page", F.lit(200.0).alias("width"), F.lit(400.0).alias("height"))
    return documents.resolve_outline(items, pages)


@query(f"""{_OUTLINE} SELECT doc_id, error FROM s WHERE error IS NOT NULL""")
def outline_errors_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(spark, sf_dir)[1]


@query(f"""{_OUTLINE} SELECT doc_id, pos, page_id::INT AS page, round(x / 200, 9) AS l, round((400 - y) / 400, 9) AS t
    FROM e JOIN s USING (doc_id) WHERE error IS NULL AND leads""")
def outline_items_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(spark, sf_dir)[0].select("doc_id", "pos", F.col("page").cast("int").alias("page"), F.round("l", 9).alias("l"), F.round("t", 9).alias("t"))


def _rule_recipe() -> recipes.CoreRecipe:
    """Rules in place of models: words are tokens, blocks five rows, equations rows with a digit, labels the kinds of blocks."""
    five = lambda x: x["rows"].groupBy("doc_id", "page", F.floor(F.col("pos") / 5).alias("pos")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    digits = lambda x: x["rows"].where(F.col("text").rlike("[0-9]")).select("doc_id", "page", "pos", "start", "end")
    return recipes.CoreRecipe(
        words=recipes.Step(("tokens",), lambda x: x["tokens"]), layout=recipes.Step(("rows",), five), equations=recipes.Step(("rows",), digits),
        labels=recipes.Step(("blocks",), lambda x: x["blocks"].where(F.col("end") - F.col("start") > 40)),
    )


@query(with_layers("""
    SELECT * FROM (
        WITH five AS (SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM rows_ GROUP BY doc_id, pos // 5, page),
        both_ AS (SELECT * FROM five UNION ALL SELECT doc_id, "start", "end" FROM rows_ WHERE regexp_matches(text, '[0-9]'))
        SELECT doc_id, 'words' AS layer, count(*) AS n FROM tokens GROUP BY 1 UNION ALL
        SELECT doc_id, 'pages', count(*) FROM pages_ GROUP BY 1 UNION ALL
        SELECT doc_id, 'blocks', count(*) FROM both_ GROUP BY 1 UNION ALL
        SELECT doc_id, 'labels', count(*) FROM both_ WHERE "end" - "start" > 40 GROUP BY 1)"""))
def core_recipe_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of annotations in the layers that the recipe makes of each document."""
    made = _rule_recipe().from_path(lambda path: table(spark, path, "documents"), sf_dir)
    counts = [made[x].groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(x).alias("layer"), "n") for x in ("words", "pages", "blocks", "labels")]
    return reduce(DataFrame.unionByName, counts)
