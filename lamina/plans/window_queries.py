"""Queries over windows of words, records of bibliographies, and trees of full texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import bibliography, inrow, table_functions, windows
from lamina.operators.layers import ROWS_PER_PAGE
from lamina.plans.registry import query, table, with_layers
from lamina.plans.table_queries import _pairs
from lamina.sources import tei


@query(with_layers("""
    , k AS (SELECT doc_id, page, pos, "start", "end", regexp_matches(text, '^[A-Z]') AS up FROM boxed),
    w AS (SELECT *, row_number() OVER d - 1 AS word, coalesce(lag(up) OVER d, false) AS b, coalesce(lead(up) OVER d, false) AS f
          FROM k WINDOW d AS (PARTITION BY doc_id, page ORDER BY pos)),
    l AS (SELECT *, CASE WHEN b AND f THEN 'I' WHEN b THEN 'L' WHEN f THEN 'B' ELSE 'U' END AS label FROM w WHERE up AND word > 0),
    o AS (SELECT *, label IN ('B', 'U') OR coalesce(lag(label) OVER (PARTITION BY doc_id, page ORDER BY pos) IN ('L', 'U'), true) AS opens FROM l),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, page ORDER BY pos) AS span FROM o)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, span) - 1 AS pos, page AS part, min(word) AS first, max(word) AS last, count(*) AS n,
           min("start") AS "start", max("end") AS "end" FROM s GROUP BY doc_id, page, span"""))  # fmt: skip
def mentions_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages in windows of 512 sub-words; the SQL labels whole pages, so both agree only where windows leave no trace."""
    labelled = windows.label_words(table(spark, sf_dir, "documents"), windows.rule_mentions, windows.pages)
    return windows.mentions(labelled).withColumns({"first": F.col("first").cast("long"), "last": F.col("last").cast("long")})


_ENTRIES = with_layers("""
    , w AS (SELECT s.doc_id, s.pos AS entry, s."start" AS base, s.text AS whole, t."start" - s."start" AS a, t."end" - s."start" AS b, t.text,
                   row_number() OVER (PARTITION BY s.doc_id, s.pos ORDER BY t.pos) - 1 AS i
            FROM sentences s JOIN tokens t ON s.doc_id = t.doc_id AND t."start" < s."end" AND t."end" > s."start"),
    l AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]') THEN CASE WHEN i = 0 THEN 'number' WHEN b - a <= 4 THEN 'year' WHEN b - a <= 8 THEN 'page' ELSE 'doi' END
                         WHEN regexp_matches(text, '^[A-Z]') THEN 'author' WHEN regexp_matches(text, '^[a-z]') THEN 'title' ELSE 'venue' END AS label FROM w),
    c AS (SELECT *, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id, entry ORDER BY i))::INT AS changed FROM l),
    g AS (SELECT *, sum(changed) OVER (PARTITION BY doc_id, entry ORDER BY i) AS run FROM c),
    r AS (SELECT doc_id, entry, any_value(base) AS base, any_value(whole) AS whole, run, any_value(label) AS label, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2, 5),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entry, label ORDER BY run) AS nth, run = max(run) OVER (PARTITION BY doc_id, entry) AS final,
                 substring(whole, a + 1, b - a) AS text FROM r)
""")


@query(_ENTRIES + r"""
    , x AS (SELECT doc_id, entry, max(text) FILTER (label = 'number') AS number, string_agg(text, ' | ' ORDER BY run) FILTER (label = 'author' AND NOT final) AS authors,
            max(text) FILTER (label = 'title' AND nth = 1) AS title, max(text) FILTER (label = 'venue' AND nth = 1) AS venue,
            max(text) FILTER (label = 'year' AND nth = 1) AS year, max(text) FILTER (label = 'doi' AND nth = 1) AS doi FROM f GROUP BY 1, 2)
    SELECT doc_id, entry, number, coalesce(authors, '') AS authors, nullif(regexp_replace(replace(strip_accents(title), 'ß', 'ss'), '-\s+', '', 'g'), '') AS title,
           venue, year, CASE WHEN starts_with(doi, '10.') THEN lower(doi) END AS doi, NULL::VARCHAR AS url FROM x""")
def bibliography_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences stand for entries."""
    labelled = windows.label_words(table(spark, sf_dir, "documents"), bibliography.rule_labels, inrow.Texts.sentences)
    return bibliography.records(bibliography.fields(labelled)).withColumn("authors", F.array_join("authors", " | "))


@query(_ENTRIES + """
    SELECT doc_id, entry, CASE label WHEN 'author' THEN 'authors' ELSE label END AS field, CASE WHEN label = 'author' THEN nth - 1 ELSE 0 END AS pos,
           base + a AS "start", base + b AS "end" FROM f WHERE label <> 'page' AND CASE WHEN label = 'author' THEN NOT final ELSE nth = 1 END""")
def bibliography_layers_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = windows.label_words(table(spark, sf_dir, "documents"), bibliography.rule_labels, inrow.Texts.sentences)
    return bibliography.layers(bibliography.fields(labelled)).withColumn("pos", F.col("pos").cast("long"))


@query(with_layers('SELECT doc_id, pos, "start", "end", text FROM sentences'))
def layer_function_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function ``layer_of``, its texts dealt out by doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return F.udtf(table_functions.LayerOf)(docs.asTable().partitionBy("doc_id"), F.lit("sentences"))


@query()
def fuzz_ratio_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature of mentions and entries that DuckDB has no function for; the tests compare it with a plain table."""
    mentions, entries = _pairs(spark, sf_dir)
    pairs = mentions.join(entries.select("doc_id", F.col("pos").alias("entry_pos"), F.col("text").alias("entry")), "doc_id")
    return pairs.select("pos", "entry_pos", text.indel_ratio(F.col("text"), F.col("entry")).alias("fuzz_ratio"))


#: Rows of a section of the full texts below, the first of which is its heading, and of a paragraph.
_SECTION, _PARAGRAPH = 20, 5


def _full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TEI: rows are sentences of five to a paragraph, behind a heading to every twenty rows; pages are 100 by 40."""
    rows = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    n = F.size(rows)
    box = lambda i: F.format_string("%d,0,%d,%d,1", F.floor(i / ROWS_PER_PAGE) + 1, i % ROWS_PER_PAGE, F.length(F.element_at(rows, i + 1)))
    sentence = lambda i: F.concat(F.lit('<s coords="'), box(i), F.lit('"/>'))
    each = lambda a, f: F.array_join(F.transform(a, f), "")

    def section(a):
        starts = F.when(a + 1 < n, F.sequence(a + 1, F.least(a + _SECTION, n) - 1, F.lit(_PARAGRAPH))).otherwise(F.array().cast("array<int>"))
        # The last paragraph of a section is shorter, as the heading is a row too.
        part = lambda s: F.concat(F.lit("<p>"), each(F.sequence(s, F.least(s + _PARAGRAPH, a + _SECTION, n) - 1), sentence), F.lit("</p>"))
        number = F.floor(a / _SECTION) + 1
        head = F.format_string('<div><head n="%d" coords="%s">Part %d</head>', number, box(a), number)
        return F.concat(head, each(starts, part), F.lit("</div>"))

    surfaces = each(F.sequence(F.lit(1), F.ceil(n / ROWS_PER_PAGE)), lambda p: F.format_string(f'<surface n="%d" lrx="100" lry="{ROWS_PER_PAGE}"/>', p))
    body = each(F.sequence(F.lit(0), n - 1, F.lit(_SECTION)), section)
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><facsimile>'), surfaces, F.lit("</facsimile><text><body>"), body, F.lit("</body></text></TEI>"))
    return table(spark, sf_dir, "documents").select("doc_id", xml.alias("tei"))


@query(with_layers(f"""
    , r AS (SELECT doc_id, pos, pos // {_SECTION} AS section, CASE WHEN pos % {_SECTION} > 0 THEN (pos % {_SECTION} - 1) // {_PARAGRAPH} END AS paragraph FROM rows_),
    k AS (SELECT doc_id, row_pos, "start", "end", "start" - lag("end") OVER (PARTITION BY doc_id, row_pos ORDER BY pos) AS gap FROM boxed),
    h AS (SELECT doc_id, row_pos, count(*) FILTER (gap IS NULL OR gap > 1) AS n, min("start") AS a, max("end") AS b FROM k GROUP BY 1, 2),
    m AS (SELECT r.*, coalesce(n, 0) AS n, a, b, paragraph IS NULL OR bool_and(n IS NOT NULL) OVER (PARTITION BY r.doc_id, section, paragraph) AS ok
          FROM r LEFT JOIN h ON r.doc_id = h.doc_id AND r.pos = h.row_pos),
    p AS (SELECT doc_id, CASE WHEN paragraph IS NULL THEN 'heading' ELSE 'sentence' END AS level, section, pos, n, a, b FROM m WHERE ok
          UNION ALL SELECT doc_id, 'paragraph', section, min(pos), sum(n), min(a), max(b) FROM m WHERE ok AND paragraph IS NOT NULL GROUP BY doc_id, section, paragraph
          UNION ALL SELECT doc_id, 'section', section, min(pos), sum(n), min(a), max(b) FROM m WHERE ok GROUP BY doc_id, section)
    SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id, level ORDER BY pos) - 1 AS id,
           CASE WHEN level IN ('section', 'heading') THEN 'Part ' || section + 1 END AS title, n::BIGINT AS n_spans, a AS "start", b AS "end" FROM p"""))  # fmt: skip
def tei_tree_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tei.tree_layers(tei.tree(_full_text(spark, sf_dir)), inrow.boxed_tokens(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "level", F.col("id").cast("long").alias("id"), "title", "n_spans", "start", "end")
