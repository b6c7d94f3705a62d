"""Queries over strings, metadata, small fixtures and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import spans, text
from lamina.operators import grouped, inrow, layers, predictors, segments, words
from lamina.plans.registry import FIXTURES, fixture, query, table, with_layers
from lamina.sources import documents, scraper, tei
from lamina.streaming.ingest import event_windows


def _rows(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """A literal table, from the same text that the SQL has."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS v({columns})")


@query("""
    SELECT p_partkey, levenshtein(p_name, p_type)::INTEGER AS distance, levenshtein(lower(p_name), lower(p_brand))::INTEGER AS to_brand,
           round(levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 9) AS normalized,
           round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 9) AS similarity FROM part""")
def levenshtein_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.levenshtein(a, b).alias("distance"), text.levenshtein(a, F.col("p_brand"), case_sensitive=False).alias("to_brand"),
        F.round(text.levenshtein(a, b, normalize=True), 9).alias("normalized"), F.round(text.similarity(a, b), 9).alias("similarity"),
    )


_GRAMS = "CASE WHEN length({0}) < 3 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3))) END"


@query(f"""
    WITH g AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS a, {_GRAMS.format("p_type")} AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM g""")
def char_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.jaccard_ngrams(F.col("p_name"), F.col("p_type"), 3), 9).alias("jaccard"))


MENTIONS = """(1L, 0L, 'Smith et al., 2019'), (1L, 1L, '[2]'), (1L, 2L, 'Lee and Kim (2020)'), (1L, 3L, ''), (2L, 0L, 'Wu, 2018')"""
ENTRIES = """(1L, 0L, '[1] J. Smith, A. Doe. Deep things. 2019.'), (1L, 1L, '[2] K. Lee and S. Kim. Other things. 2020.'),
    (1L, 2L, 'Smith P. More things, 2021'), (2L, 0L, 'H. Wu. A paper. 2018')"""
_FLAT = "list_filter(string_split_regex(lower(regexp_replace({0}, '[()\\[\\],.&;]', '', 'g')), '\\s+'), lambda t: t <> '')"
_SQL_ROWS = lambda v: v.replace("L,", ",")


@fixture(f"""
    WITH m(doc_id, pos, text) AS (VALUES {_SQL_ROWS(MENTIONS)}), e(doc_id, entry_pos, entry) AS (VALUES {_SQL_ROWS(ENTRIES)}),
    p AS (SELECT m.doc_id, pos, entry_pos, text, entry, {_FLAT.format("text")} AS w, {_FLAT.format("entry")} AS ew, {_FLAT.format("entry[1:50]")} AS e50,
          regexp_extract_all(text, '[0-9]+') AS nums, regexp_extract_all(entry[1:100], '[0-9]+') AS enums FROM m JOIN e ON m.doc_id = e.doc_id)
    SELECT doc_id::BIGINT AS doc_id, pos::BIGINT AS pos, entry_pos::BIGINT AS entry_pos, (trim(text) <> '')::INTEGER AS has_text,
      (len(list_filter(nums, lambda n: NOT list_contains(enums, n))) = 0)::INTEGER AS match_numeric,
      round(coalesce(len(list_intersect(nums, enums)) / nullif(len(list_distinct(list_concat(nums, enums))), 0), 0), 9) AS jaccard_numeric,
      (len(w) > 0 AND len(list_filter(w, lambda t: t NOT IN ('et', 'al', 'and') AND NOT list_contains(ew, t))) = 0)::INTEGER AS match_source_tokens,
      (len(w) > 0 AND list_contains(e50, w[1]))::INTEGER AS match_first_token,
      coalesce(list_position(e50, w[1]) - 1, -1)::DOUBLE AS first_position FROM p""")  # fmt: skip
def citation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _rows(spark, MENTIONS, "doc_id, pos, text")
    e = _rows(spark, ENTRIES, "doc_id, entry_pos, entry")
    f = text.citation_features(F.col("text"), F.col("entry"))
    place = F.nanvl(f["first_position"], F.lit(-1.0))
    return m.join(e, "doc_id").select(
        "doc_id", "pos", "entry_pos", f["has_source_text"].alias("has_text"), f["match_numeric"].alias("match_numeric"),
        F.round(f["jaccard_numeric"], 9).alias("jaccard_numeric"), f["heuristic"].alias("match_source_tokens"),
        f["match_first_token"].alias("match_first_token"), place.alias("first_position"),
    )


@fixture(f"""
    WITH f AS ({FIXTURES["citation_features"][1]}),
    s AS (SELECT doc_id, pos, entry_pos, round(0.5 * match_source_tokens + 0.3 * match_first_token + 0.2 * match_numeric, 9)::DOUBLE AS score FROM f)
    SELECT doc_id, pos, arg_max(entry_pos, (score, -entry_pos)) AS entry_pos, max(score) AS score FROM s WHERE score >= 0.8 GROUP BY 1, 2""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.citation_links(_rows(spark, MENTIONS, "doc_id, pos, text"), _rows(spark, ENTRIES, "doc_id, pos, text"))


@fixture("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, NULL::VARCHAR AS joined FROM part WHERE false UNION ALL SELECT 'well', 'well-known' UNION ALL SELECT 'cus', 'custom'")
def hyphen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, "(1L, 0L, 0L, 5L, 'well-'), (1L, 1L, 6L, 11L, 'known'), (2L, 0L, 0L, 4L, 'cus-'), (2L, 1L, 5L, 8L, 'tom')", "doc_id, pos, start, end, text")
    joined = words.hyphen_words(rows, lambda a, b: F.when(F.length(a) >= 4, 1.0).otherwise(-9.0))
    return joined.select(F.regexp_extract("text", "^(well|cus)", 1).alias("word"), F.col("text").alias("joined"))


@query("""SELECT p_partkey, p_type AS word, regexp_extract(p_type, '^[^ ]+') || '-' || regexp_extract(p_type, '[^ ]+$') AS hyphenated,
    regexp_replace(regexp_extract(p_type, '^[^ ]+'), '\\w', 'x', 'g') AS prefix_shape, right(regexp_extract(p_type, '^[^ ]+'), 2) AS prefix_tail FROM part""")
def hyphen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.regexp_extract("p_type", "^([^ ]+)", 1), F.regexp_extract("p_type", "([^ ]+)$", 1)
    f = text.hyphen_features(first, last)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("word"), F.concat_ws("-", first, last).alias("hyphenated"),
        f["prefix_shape"].alias("prefix_shape"), f["prefix_tail"].alias("prefix_tail"),
    )


@fixture("""SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 'title', 0::BIGINT, 103::BIGINT, 110::BIGINT), (1, 0, 'title', 1, 200, 204), (1, 0, 'year', 1, 206, 210))
    v(doc_id, entry, field, span_pos, "start", "end")""")
def bib_range_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _rows(spark, "(1L, 0L, 0L, 100L, 110L), (1L, 0L, 1L, 200L, 220L)", "doc_id, entry, span_pos, start, end")
    ranges = _rows(spark, "(1L, 0L, 'title', 3L, 15L), (1L, 0L, 'year', 17L, 21L)", "doc_id, entry, field, from, to")
    return predictors.map_ranges(entries, ranges)


@fixture("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 1::BIGINT, 3::BIGINT, 3::BIGINT), (1, 1, 5, 5, 1), (1, 2, 6, 7, 2)) v(doc_id, span, first, last, n)")
def bilou_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = "(1L, 0L, 'B'), (1L, 1L, 'B'), (1L, 2L, 'I'), (1L, 3L, 'L'), (1L, 4L, 'O'), (1L, 5L, 'U'), (1L, 6L, 'I'), (1L, 7L, 'L'), (1L, 8L, 'O')"
    return segments.bilou_spans(_rows(spark, labels, "doc_id, pos, label"), "doc_id", "pos")


@fixture("SELECT 1::BIGINT AS doc_id, 1::BIGINT AS first, 2::BIGINT AS last")
def author_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = "(1L, 0L, 'MISC'), (1L, 1L, 'START'), (1L, 2L, 'MIDDLE'), (1L, 3L, 'MISC'), (1L, 4L, 'START')"
    return segments.author_spans(_rows(spark, labels, "doc_id, pos, label"), "doc_id", "pos")


@fixture("SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'Intro', 0), (1, 2, 'Part', 1), (2, 0, 'A', 0), (2, 1, 'B', 0)) v(doc_id, pos, title, level)")
def outline_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = "(1L, 0L, 'Paper', 0), (1L, 1L, 'Intro', 1), (1L, 2L, 'Part', 2), (2L, 0L, 'A', 0), (2L, 1L, 'B', 0)"
    return documents.normalise_outline(_rows(spark, items, "doc_id, pos, title, level"))


@fixture("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, '1', -1::BIGINT), (1, 1, '1.1', 0), (1, 2, '1.1.1', 1), (1, 3, '2', -1), (1, 4, '2.1', 3)) v(doc_id, pos, number, parent)")
def section_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.nest_sections(_rows(spark, "(1L, 0L, '1'), (1L, 1L, '1.1'), (1L, 2L, '1.1.1'), (1L, 3L, '2'), (1L, 4L, '2.1')", "doc_id, pos, number"))


@query("""
    SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1))::BIGINT AS n_paragraphs,
           coalesce(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)[1], '') AS first_paragraph FROM pages""")
def html_title_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tei.html_header(table(spark, sf_dir, "pages"))


TEI = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A Title</title></titleStmt><sourceDesc><biblStruct>'
    '<title>Another</title><persName coords="1,10,20,30,5">A</persName></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>One.</p><p>Two.</p></abstract>'
    '</profileDesc></teiHeader><facsimile><surface n="1" lrx="100" lry="200"/><surface n="2" lrx="100" lry="200"/></facsimile><text><body><div><head coords="1,5,5,10,10">H</head>'
    '<p><s coords="1,0,50,50,10;2,0,10,50,10">S<ref type="bibr" target="#b0" coords="2,1,2,3,4">1</ref></s></p></div></body><back><listBibl>'
    '<biblStruct coords="2,10,100,50,bad;2,10,100,50,20">B</biblStruct></listBibl></back></text></TEI>'
)


def _tei(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, TEI)], "doc_id long, tei string")


@fixture("SELECT 1::BIGINT AS doc_id, 'A Title' AS title, 'One.' || chr(10) || 'Two.' AS abstract, 'A Title' || chr(10) || 'One.' || chr(10) || 'Two.' AS symbols")
def tei_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tei.header(_tei(spark))


@fixture("""SELECT * FROM (VALUES (1::BIGINT, 'authors', 0, 0, 0, 0.1::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE, 0.025::DOUBLE), (1, 'bibs', 0, 0, 1, 0.1, 0.5, 0.5, 0.1),
    (1, 'mentions', 0, 0, 1, 0.01, 0.01, 0.03, 0.02), (1, 'headings', 0, 0, 0, 0.05, 0.025, 0.1, 0.05), (1, 'sentences', 0, 0, 0, 0.0, 0.25, 0.5, 0.05),
    (1, 'sentences', 0, 1, 1, 0.0, 0.05, 0.5, 0.05)) v(doc_id, layer, pos, box_pos, page, l, t, w, h)""")
def tei_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tei.full_text(_tei(spark))


_LETTERS = "trim(regexp_replace(substr(coalesce(text, ''), {}, 60), '[^A-Za-z ]+', '', 'g'))"


@query(f"""WITH p AS (SELECT doc_id, {_LETTERS.format(1)} AS t, {_LETTERS.format(61)} AS a, {_LETTERS.format(121)} AS b FROM documents),
    h AS (SELECT doc_id, nullif(t, '') AS title, nullif(concat_ws(chr(10), nullif(a, ''), nullif(b, '')), '') AS abstract FROM p)
    SELECT doc_id, title, abstract, concat_ws(chr(10), title, abstract) AS symbols FROM h""")
def tei_header_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TEI: the letters of the first sixty characters are a title, those of the next two sixties paragraphs of an abstract."""
    part = lambda n: F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), n, 60), "[^A-Za-z ]+", "")
    xml = F.format_string(
        "<TEI><teiHeader><fileDesc><titleStmt><title>%s</title></titleStmt></fileDesc><profileDesc><abstract><p>%s</p><p>%s</p></abstract></profileDesc></teiHeader></TEI>",
        part(1), part(61), part(121),
    )
    return tei.header(table(spark, sf_dir, "documents").select("doc_id", xml.alias("tei")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN trim(nullif(t, '')) END AS title
    FROM (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 60), '[^A-Za-z ]+', '', 'g') AS t FROM documents)""")
def citation_titles_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lists of citations: without a title, with two of which the first counts, and with an empty one first."""
    letters = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "[^A-Za-z ]+", "")
    titles = F.when(F.col("doc_id") % 3 == 1, F.format_string("<title level='a'>%s<hi>x</hi>y</title><title level='j'>Journal</title>", letters))
    titles = titles.when(F.col("doc_id") % 3 == 2, F.format_string("<title/><title>%s</title>", letters)).otherwise("<note>none</note>")
    xml = F.format_string("<TEI><listBibl><biblStruct><analytic>%s</analytic></biblStruct></listBibl></TEI>", titles)
    return tei.citation_title(table(spark, sf_dir, "documents").select("doc_id", xml.alias("tei")))


@query(with_layers("""
    SELECT doc_id, 'sentences' AS layer, pos::INT AS pos, 0 AS box_pos, page::INT AS page, 0.0::DOUBLE AS l, (pos % 40)::DOUBLE / 40 AS t,
           length(text)::DOUBLE / 100 AS w, 1.0::DOUBLE / 40 AS h FROM rows_"""))
def tei_boxes_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TEI with the box of every row: pages of a hundred characters by forty rows."""

    def make(t: inrow.Texts):
        rows = t.rows()
        return rows.owner, [rows.pos, rows.end - rows.start]

    rows = inrow.over_texts(table(spark, sf_dir, "documents"), "pos bigint, n bigint", make)
    height = layers.ROWS_PER_PAGE
    boxes_ = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "n"))),
        lambda r: F.format_string('<s coords="%d,0,%d,%d,1"/>', F.floor(r["pos"] / height) + 1, r["pos"] % height, r["n"]),
    )
    pages = F.transform(F.sequence(F.lit(1), F.floor(F.max("pos") / height) + 1), lambda n: F.format_string(f'<surface n="%d" lrx="100" lry="{height}"/>', n))
    xml = F.concat(F.lit("<TEI><facsimile>"), F.array_join(pages, ""), F.lit("</facsimile><text><body><div><p>"), F.array_join(boxes_, ""), F.lit("</p></div></body></text></TEI>"))
    made = rows.groupBy("doc_id").agg(xml.alias("tei"))
    return tei.box_groups(made, tei.LAYERS["sentences"], "sentences")


@fixture("""SELECT * FROM (VALUES (1::BIGINT, 1, 1, 1, 'Hi', 0.1::DOUBLE, 0.7::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE)) v(doc_id, page, row_id, word_id, text, l, t, w, h)""")
def scraper_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ["<pagemetrics>", "<page>", "<no>1</no>", "<pagewidth>100</pagewidth>", "<pageheight>100</pageheight>", "<lines>1</lines>", "<words>1</words>", "</page>"]
    body = ['<Page id="1">', '<Line id="1">', '<Word id="1">', '<Char id="1" BBOX="(10, 20, 10, 10)">H</Char>', '<Char id="2" BBOX="(20, 20, 10, 10)">i</Char>',
            '<Char id="3" BBOX="(NaN, 1, 1, 1)">x</Char>', "</Word>", "</Line>", "</Page>"]
    frame = lambda lines: spark.createDataFrame([(1, n, x) for n, x in enumerate(lines)], "doc_id long, n long, line string")
    made = scraper.tokens(frame(body), scraper.page_metrics(frame(metrics)).select("doc_id", "page", "width", "height"))
    return made.select("doc_id", "page", "row_id", "word_id", "text", *[F.round(c, 9).alias(c) for c in "ltwh"])


@fixture("SELECT * FROM (VALUES (1::BIGINT, 0, 1, 0.1::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE, 0.1::DOUBLE)) v(doc_id, page, id, l, t, w, h)")
def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ocr = "(1L, 0, 1, 10.0D, 20.0D, 10.0D, 20.0D, 'a', 100.0D, 200.0D), (1L, 0, 1, 20.0D, 20.0D, 20.0D, 10.0D, 'b', 100.0D, 200.0D), (1L, 0, 2, 0.0D, 0.0D, 100.0D, 200.0D, 'c', 100.0D, 200.0D), (1L, 0, 3, 0.0D, 0.0D, 1.0D, 2.0D, ' ', 100.0D, 200.0D)"
    made = documents.ocr_blocks(_rows(spark, ocr, "doc_id, page, block_num, left, top, width, height, text, page_width, page_height"))
    return made.select("doc_id", "page", "id", *[F.round(c, 9).alias(c) for c in "ltwh"])


@fixture("""SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 'foo', 0::BIGINT, 3::BIGINT), (1, 1, 'bar', 3, 6), (1, 2, 'baz', 7, 10), (1, 3, 'qux', 11, 14)) v(doc_id, pos, text, "start", "end")""")
def nested_to_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = "(1L, 0L, 'foo', 0, 0, 0), (1L, 1L, 'bar', 0, 0, 0), (1L, 2L, 'baz', 1, 0, 0), (1L, 3L, 'qux', 2, 1, 0)"
    return documents.nested_to_layers(_rows(spark, tokens, "doc_id, pos, text, word_id, row_id, page_id")).select("doc_id", "pos", "text", "start", "end")


@query("SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events")
def metadata_variant_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.try_variant_get(metadata, "$.k", "bigint").alias("k"))


@query("""
    SELECT p_brand AS model, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS deviation FROM
    (SELECT p_brand, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) AS s FROM part) GROUP BY 1""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and count of similarities for each brand, as for each system under evaluation."""
    s = text.similarity(F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").withColumn("s", s).groupBy(F.col("p_brand").alias("model")).agg(
        F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_samp("s"), 6).alias("deviation")
    )


@query("""
    SELECT round(sum(((toxic = 1) AND (quality = 1))::INT) / sum((toxic = 1)::INT), 9) AS "precision",
           round(sum(((toxic = 1) AND (quality = 1))::INT) / sum((quality = 1)::INT), 9) AS recall FROM labels""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1))
    return table(spark, sf_dir, "labels").agg(
        F.round(both / F.count_if(F.col("toxic") == 1), 9).alias("precision"), F.round(both / F.count_if(F.col("quality") == 1), 9).alias("recall")
    )


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def event_type_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_windows(table(spark, sf_dir, "events")).withColumn("mean_value", F.round("mean_value", 6))


@query("""
    SELECT doc_id, round(exp(quality) / (exp(quality) + exp(toxic)), 9) AS p_quality FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select(
        "doc_id", F.round(F.element_at(text.softmax(logits), 1), 9).alias("p_quality")
    )


@query("""
    SELECT vec_id, min(v) AS low, max(v) AS high, count(DISTINCT v) AS n_sizes FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: round(x::DOUBLE, 4))) AS v FROM embeddings) GROUP BY 1""")
def distinct_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rounded sizes, as of the fonts of a document."""
    sizes = F.array_sort(F.array_distinct(F.transform("embedding", lambda x: F.round(x.cast("double"), 4))))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_min(sizes).alias("low"), F.array_max(sizes).alias("high"), F.size(sizes).cast("bigint").alias("n_sizes")
    )


@fixture("""SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT, 9::BIGINT, true, 'ab cd'), (2, 1, 4, false, 'bcd bc')) v(doc_id, "start", "end", disjoint, text)""")
def span_group_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(
        [(1, "ab.....cd", [(0, 2), (7, 9)]), (2, "abcd", [(1, 4), (1, 3)])], "doc_id long, symbols string, spans array<struct<start:long,end:long>>"
    )
    return rows.select(
        "doc_id", spans.group_start(F.col("spans")).alias("start"), spans.group_end(F.col("spans")).alias("end"),
        spans.are_disjoint(F.col("spans")).alias("disjoint"), spans.text_of(F.col("symbols"), F.col("spans")).alias("text"),
    )
