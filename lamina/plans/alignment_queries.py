"""Queries of alignment, sentences, sections and services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import alignment, inrow, predictors
from lamina.plans.feature_queries import _rows
from lamina.plans.registry import fixture, query, table, with_layers
from lamina.sources import documents, services


@query(with_layers("""
    SELECT s.doc_id, s.pos, min(t.pos) AS first, max(t.pos) AS last, count(*) AS n_tokens, min(t."start") AS "start", max(t."end") AS "end"
    FROM sentences s JOIN tokens t ON s.doc_id = t.doc_id AND t."start" < s."end" AND t."end" > s."start" GROUP BY 1, 2"""))  # fmt: skip
def sentence_token_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inrow.tokens_of_sentences(table(spark, sf_dir, "documents"))


@query(with_layers("""
    SELECT doc_id, pos AS coarse_pos, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_]'))::BIGINT AS n_fine FROM tokens"""))
def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inrow.aligned_tokens(table(spark, sf_dir, "documents"))


@fixture("SELECT * FROM (VALUES (1, 0, 9), (1, 1, 0), (1, 2, 0), (1, 3, 8), (1, 4, 0), (1, 5, 9)) v(entry, word_id, label)")
def subword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "(1, 0, NULL, 0), (1, 1, 0, 9), (1, 2, 0, 9), (1, 3, 1, 0), (1, 4, 3, 8), (1, 5, 3, 9), (1, 6, 5, 9), (1, 7, NULL, 4)"
    return alignment.word_labels(_rows(spark, rows, "entry, pos, word_id, label")).where("word_id is not null")


@fixture("""SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 0, 2::BIGINT, 9::BIGINT, 0.1::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE),
    (1, 0, 0, 21, 24, 0.1, 0.3, 0.2, 0.1)) v(doc_id, mention, page, "start", "end", l, t, w, h)""")
def mention_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = "(1L, 0L, 2L, 5L, 0, 0.1D, 0.1D, 0.2D, 0.1D), (1L, 0L, 6L, 9L, 0, 0.4D, 0.1D, 0.2D, 0.1D), (1L, 0L, 21L, 24L, 0, 0.1D, 0.3D, 0.2D, 0.1D)"
    rows = _rows(spark, "(1L, 0L, 0L, 20L), (1L, 1L, 20L, 40L)", "doc_id, pos, start, end")
    made = alignment.merge_mention_boxes(_rows(spark, parts, "doc_id, mention, start, end, page, l, t, w, h"), rows)
    return made.select("doc_id", "mention", "page", "start", "end", *[F.round(c, 9).alias(c) for c in "ltwh"])


@fixture("SELECT 1::BIGINT AS doc_id, 0::BIGINT AS pos, 1::BIGINT AS level, 'Deep Nets' AS title, 'Deep Nets' AS text, 10::BIGINT AS \"start\", 19::BIGINT AS \"end\", 0.0::DOUBLE AS distance")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = "(1L, 0L, 10L, 14L, 'Deep', 0.1D, 0.2D, 0.05D, 0.01D), (1L, 0L, 15L, 19L, 'Nets', 0.16D, 0.2D, 0.05D, 0.01D), (1L, 0L, 20L, 24L, 'body', 0.1D, 0.3D, 0.05D, 0.01D)"
    items = "(1L, 0L, 0L, 'Deep Nets', 1L, 0.1D, 0.19D)"
    return alignment.section_headers(
        _rows(spark, items, "doc_id, pos, page, title, level, l, t"), _rows(spark, tokens, "doc_id, page, start, end, text, l, t, w, h")
    )


@fixture("""SELECT 1::BIGINT AS doc_id, '{"links":[{"pos":0,"entry_pos":0,"score":1.0}]}' AS json""")
def citation_link_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame(
        [(1, '{"symbols":"x","mentions":[{"start":0,"end":4,"text":"Wu, 2018"}],"bibs":[{"start":5,"end":9,"text":"H. Wu. A paper. 2018"}]}')],
        "doc_id long, json string",
    )
    return services.serve(raw, "citation_links", lambda x: predictors.citation_links(x["mentions"], x["bibs"]))


@fixture("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 'a'), (1, 1, 'a'), (1, 2, 'b')) v(doc_id, word_pos, label)")
def repeated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.repeat_labels(_rows(spark, "(1L, 0L, 'a', 2), (1L, 1L, 'c', 0), (1L, 2L, 'b', 1)", "doc_id, pos, label, n_words"))


@query("SELECT page_id, to_base64(encode(url)) AS content FROM pages")
def base64_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page"), F.col("url").cast("binary").alias("content"))
    return documents.images(files).select(F.col("doc_id").alias("page_id"), "content")


@query("""
    SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, NULL, NULL FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def labels_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its label, or nulls."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
