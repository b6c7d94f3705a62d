"""Operators of small fixtures once more, over whole tables.

Turns of conversations stand for words, rows and sections; what the tables lack, such as
labels, comes from rules that are stated in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import spans, text
from lamina.operators import alignment, grouped, inrow, predictors, segments, words
from lamina.plans.registry import query, table, with_layers
from lamina.sources import documents


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, role): conversations as documents of turns."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role")


_TURNS = "WITH t AS (SELECT conv_id AS doc_id, turn AS pos, role FROM conversations)"
_BILOU = ["O", "B", "I", "L", "U", "I", "O", "I"]


def _pick(values: list[str], number: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(number) % len(values) + 1).cast("int"))


@query(f"""{_TURNS},
    l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 'O'
                         ELSE {_BILOU}[(doc_id * 3 + pos * 5) % 8 + 1] END AS label FROM t),
    b AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l WHERE label <> 'O'),
    o AS (SELECT *, (label IN ('B', 'U') OR coalesce(before IN ('L', 'U'), true))::INT AS opens FROM b),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS span FROM o)
    SELECT doc_id, span::BIGINT AS span, min(pos) AS first, max(pos) AS last, count(*) AS n FROM s GROUP BY 1, 2""")
def bilou_spans_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _turns(spark, sf_dir).withColumn("label", _pick(_BILOU, "doc_id * 3 + pos * 5"))
    return segments.bilou_spans(labels, "doc_id", "pos")


_AUTHORS = ["MISC", "START", "MIDDLE", "MISC", "MIDDLE", "START", "MISC"]


@query(f"""{_TURNS},
    l AS (SELECT *, {_AUTHORS}[(doc_id + pos * 3) % 7 + 1] AS label, max(pos) OVER (PARTITION BY doc_id) AS final FROM t),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l WHERE label <> 'MISC'),
    r AS (SELECT doc_id, island, min(pos) FILTER (label = 'START') AS first, max(pos) AS last, max(final) AS final FROM g GROUP BY 1, 2)
    SELECT doc_id, first, last FROM r WHERE first IS NOT NULL AND last < final""")
def author_spans_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.author_spans(_turns(spark, sf_dir).withColumn("label", _pick(_AUTHORS, "doc_id + pos * 3")), "doc_id", "pos")


@query(f"""{_TURNS}, e AS (SELECT doc_id, pos, role, unnest(range(1 + (doc_id + pos) % 3)) AS k FROM t)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS word_pos, role AS label FROM e""")
def labels_of_words_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of a turn for each of its words, of which there are up to three."""
    lines = _turns(spark, sf_dir).select("doc_id", "pos", F.col("role").alias("label"), ((F.col("doc_id") + F.col("pos")) % 3 + 1).alias("n_words"))
    return alignment.repeat_labels(lines)


@query(f"""{_TURNS},
    s AS (SELECT doc_id AS entry, pos, (pos // 2) * 2 AS word_id, pos * 7 % 5 AS label FROM t WHERE (doc_id + pos) % 6 <> 5),
    f AS (SELECT entry, word_id, arg_min(label, pos) AS label FROM s GROUP BY 1, 2),
    g AS (SELECT *, lag(word_id) OVER (PARTITION BY entry ORDER BY word_id) AS gap FROM f)
    SELECT entry, word_id, label FROM f UNION ALL SELECT entry, unnest(range(gap + 1, word_id)), 0 FROM g WHERE word_id - gap > 1""")
def word_labels_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns are the sub-words of a word; every second word has none, and some sub-words belong to no word."""
    word = F.when((F.col("doc_id") + F.col("pos")) % 6 != 5, F.floor(F.col("pos") / 2) * 2)
    labels = _turns(spark, sf_dir).select(F.col("doc_id").alias("entry"), "pos", word.alias("word_id"), (F.col("pos") * 7 % 5).alias("label"))
    return alignment.word_labels(labels)


@query(f"""{_TURNS},
    n AS (SELECT doc_id, pos, (pos // 4 + 1)::VARCHAR || ['', '.1', '.1.1', '.2'][pos % 4 + 1] AS number FROM t),
    w AS (SELECT *, CASE WHEN contains(number, '.') THEN regexp_replace(number, '\\.[^.]*$', '') END AS wanted FROM n)
    SELECT a.doc_id, a.pos, a.number, coalesce(max(b.pos), -1) AS parent FROM w a LEFT JOIN w b
    ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.number = a.wanted GROUP BY 1, 2, 3""")
def sections_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns are a section with a part, a part of that, and another part."""
    number = F.concat((F.floor(F.col("pos") / 4) + 1).cast("string"), _pick(["", ".1", ".1.1", ".2"], "pos"))
    return grouped.nest_sections(_turns(spark, sf_dir).select("doc_id", "pos", number.alias("number")))


@query(f"""{_TURNS},
    s AS (SELECT doc_id, 0::BIGINT AS entry, pos AS span_pos, pos * 100 AS "start", pos * 100 + 10 + pos % 4 AS "end" FROM t),
    p AS (SELECT *, sum("end" - "start" + 1) OVER (PARTITION BY doc_id ORDER BY span_pos) - ("end" - "start") - 1 AS off FROM s),
    r AS (SELECT DISTINCT doc_id, f AS field, CASE f WHEN 'title' THEN 3 ELSE 17 + doc_id % 5 END AS a,
                 CASE f WHEN 'title' THEN 15 + doc_id % 7 ELSE 40 END AS b FROM t, (VALUES ('title'), ('year')) v(f))
    SELECT p.doc_id, entry, field, span_pos, ("start" + greatest(a - off, 0))::BIGINT AS "start", ("start" + least(b - off, "end" - "start"))::BIGINT AS "end"
    FROM p JOIN r ON p.doc_id = r.doc_id AND a < off + "end" - "start" AND b > off""")  # fmt: skip
def ranges_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are the spans of one entry each conversation, in whose joined text two fields are marked."""
    turns = _turns(spark, sf_dir)
    start = F.col("pos") * 100
    entries = turns.select("doc_id", F.lit(0).cast("bigint").alias("entry"), F.col("pos").alias("span_pos"), start.alias("start"), (start + 10 + F.col("pos") % 4).alias("end"))
    ids = turns.select("doc_id", F.lit(0).cast("bigint").alias("entry")).distinct()
    ranges = ids.select("*", F.lit("title").alias("field"), F.lit(3).alias("from"), (15 + F.col("doc_id") % 7).alias("to")).unionByName(
        ids.select("*", F.lit("year").alias("field"), (17 + F.col("doc_id") % 5).alias("from"), F.lit(40).alias("to"))
    )
    return predictors.map_ranges(entries, ranges)


@query(f"""{_TURNS}, w AS (SELECT doc_id, pos, role AS text, pos // 2 AS word_id, pos // 4 AS row_id FROM t),
    g AS (SELECT *, (word_id IS DISTINCT FROM lag(word_id) OVER (PARTITION BY doc_id ORDER BY pos))::INT
                    - (row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1)::INT AS gap FROM w),
    p AS (SELECT *, sum(gap + length(text)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM g)
    SELECT doc_id, pos, text, (e - length(text))::BIGINT AS "start", e::BIGINT AS "end" FROM p""")
def nested_layers_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are tokens, two of which make a word and four a row."""
    tokens = _turns(spark, sf_dir).select(
        "doc_id", "pos", F.col("role").alias("text"), F.floor(F.col("pos") / 2).alias("word_id"), F.floor(F.col("pos") / 4).alias("row_id"), F.lit(0).alias("page_id")
    )
    return documents.nested_to_layers(tokens).select("doc_id", "pos", "text", "start", "end")


@query("""WITH d AS (SELECT doc_id, text, doc_id % 9 AS a FROM documents WHERE length(text) >= 12)
    SELECT doc_id, least(a, 7) AS "start", greatest(a + 2, 9)::BIGINT AS "end", NOT (a < 9 AND a + 2 > 7) AS disjoint,
           substring(text, a::INT + 1, 2) || ' ' || substring(text, 8, 2) AS text FROM d""")
def span_groups_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("doc_id") % 9
    both = F.array(F.struct(a.alias("start"), (a + 2).alias("end")), F.struct(F.lit(7).cast("bigint").alias("start"), F.lit(9).cast("bigint").alias("end")))
    rows = table(spark, sf_dir, "documents").where("length(text) >= 12").select("doc_id", F.col("text").alias("symbols"), both.alias("spans"))
    return rows.select(
        "doc_id", spans.group_start(F.col("spans")).alias("start"), spans.group_end(F.col("spans")).alias("end"),
        spans.are_disjoint(F.col("spans")).alias("disjoint"), spans.text_of(F.col("symbols"), F.col("spans")).alias("text"),
    )


@query(with_layers("""
    , w AS (SELECT doc_id, pos, "start", "end", CASE WHEN pos % 9 = 4 THEN text || '-' ELSE text END AS text FROM tokens),
    m AS (SELECT *, ends_with(text, '-') AND text <> '-' AND lead(text) OVER d IS NOT NULL AS opens, lead(text) OVER d AS nxt, lead("end") OVER d AS next_end
          FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    c AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY doc_id ORDER BY pos), false) AS closed, rtrim(text, '-') AS stem FROM m)
    SELECT doc_id, pos, "start", CASE WHEN opens THEN next_end ELSE "end" END AS "end",
           CASE WHEN NOT opens THEN text WHEN length(stem) >= 4 THEN text || nxt ELSE stem || nxt END AS text FROM c WHERE NOT closed"""))  # fmt: skip
def hyphen_words_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth token ends in a hyphen; a rule in place of a classifier keeps it behind four letters or more."""
    paired = inrow.hyphened_tokens(table(spark, sf_dir, "documents"), 9, 4)
    return words.scored_pairs(paired, lambda a, b: F.when(F.length(a) >= 4, 1.0).otherwise(-9.0))


@query(r"""
    WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), 'n ', 'n- '), 'ea', 'e-a') AS text FROM documents),
    parts AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS n FROM (
              SELECT doc_id, regexp_extract_all(text, '[!"#$%&''()*+,./:;<=>?@\[\\\]^`{|}~–§]|[^\s!"#$%&''()*+,./:;<=>?@\[\\\]^`{|}~–§]+|\s+') AS p FROM t)),
    placed AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM parts),
    w AS (SELECT doc_id, n, (e - length(text))::BIGINT AS s, e::BIGINT AS e, text FROM placed WHERE NOT regexp_matches(text, '^\s')),
    l AS (SELECT *, lead(text) OVER d AS nt, lead(e) OVER d AS ne FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
    o AS (SELECT *, coalesce(text LIKE '%-' AND text NOT LIKE '-%' AND nt NOT LIKE '%-', false) AS opens FROM l),
    c AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY doc_id ORDER BY n), false) AS closed FROM o),
    h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, s AS "start", CASE WHEN opens THEN ne ELSE e END AS "end",
                 opens, CASE WHEN opens THEN text || nt ELSE text END AS word, string_split(CASE WHEN opens THEN text || nt END, '-') AS p
          FROM c WHERE NOT closed)
    SELECT doc_id, pos, "start", "end", CASE WHEN opens THEN p[1] || array_to_string(list_transform(range(2, len(p) + 1),
             lambda i: CASE WHEN length(array_to_string(p[1:i - 1], '-')) % 2 = 0 THEN '-' ELSE '' END || p[i]), '') ELSE word END AS text FROM h""")
def classified_words_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to words in one go, over texts with a hyphen behind each n before a blank and in each ``ea``.

    A rule in place of a classifier keeps a hyphen behind an even number of characters. An underscore is a letter to the tokens here.
    """
    hyphened = F.replace(F.replace(F.col("text"), F.lit("n "), F.lit("n- ")), F.lit("ea"), F.lit("e-a"))
    docs = table(spark, sf_dir, "documents").select("doc_id", hyphened.alias("text"))
    opened, rest = (inrow.hyphen_words(docs, words.PUNCTUATION_WORDS.replace("_", ""), joined) for joined in (True, False))
    shares = spark.createDataFrame([], "word string, prob double")
    rule = lambda features: features.withColumn("score", F.when(F.col("p_len") % 2 == 0, 0.0).otherwise(-9.0))
    return words.classified_parts(opened, rest, rule, shares, 0.0)


_GRAMS = "CASE WHEN length({0}) < {1} THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({0}) - {1} + 2), lambda i: substring({0}, i, {1}))) END"
_JACCARD = "round(coalesce(len(list_intersect({0}, {1})) / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0), 9)"
_FLAT = "list_filter(string_split_regex(lower(regexp_replace({0}, '[()\\[\\],.&;]', '', 'g')), '\\s+'), lambda t: t <> '')"
_PAIRS = f"""
    d AS (SELECT doc_id, left(coalesce(text, ''), 150) AS text FROM documents),
    p AS (SELECT a.doc_id AS doc_id, b.doc_id AS entry_pos, substring(a.text, (1 + a.doc_id % 7)::INT, 24) AS s, b.text AS e
          FROM d a JOIN d b ON a.doc_id // 5 = b.doc_id // 5),
    f AS (SELECT doc_id, entry_pos, s, e, {_FLAT.format("s")} AS w, {_FLAT.format("e")} AS ew, {_FLAT.format("left(e, 50)")} AS e50,
          regexp_extract_all(s, '[0-9]+') AS nums, regexp_extract_all(left(e, 100), '[0-9]+') AS enums,
          regexp_extract_all(s, '[A-Za-z]+') AS alphas, regexp_extract_all(left(e, 50), '[A-Za-z]+') AS ealphas FROM p)
"""
_FEATURES = (
    ", ".join(f"{_JACCARD.format(_GRAMS.format('s', n), _GRAMS.format('left(e, 50)', n))} AS jaccard_{n}gram" for n in (1, 2, 3, 4))
    + f""", (len(w) > 0 AND len(list_filter(w, lambda t: t NOT IN ('et', 'al', 'and') AND NOT list_contains(ew, t))) = 0)::INTEGER AS heuristic,
      regexp_matches(s, '\\S')::INTEGER AS has_source_text, {_JACCARD.format("nums", "enums")} AS jaccard_numeric,
      (len(list_filter(nums, lambda n: NOT list_contains(enums, n))) = 0)::INTEGER AS match_numeric, {_JACCARD.format("alphas", "ealphas")} AS jaccard_alpha,
      (len(w) > 0 AND list_contains(e50, w[1]))::INTEGER AS match_first_token,
      CASE WHEN len(w) > 0 THEN list_position(e50, w[1]) - 1 END::DOUBLE AS first_position"""
)


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """24 characters of each document as a mention, and 150 as an entry, five documents to a bibliography."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(150)).alias("text"))
    group = F.floor(F.col("doc_id") / 5).alias("doc_id")
    mention = F.substring(F.col("text"), (F.col("doc_id") % 7 + 1).cast("int"), F.lit(24))
    return docs.select(group, F.col("doc_id").alias("pos"), mention.alias("text")), docs.select(group, F.col("doc_id").alias("pos"), "text")


@query(f"WITH {_PAIRS} SELECT doc_id AS pos, entry_pos, {_FEATURES} FROM f")
def citation_features_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features but the ratio of insertions and deletions, which DuckDB lacks; null for no first position."""
    mentions, entries = _pairs(spark, sf_dir)
    pairs = predictors.citation_pairs(mentions, entries)
    f = text.citation_features_of(F.col("source"), F.col("target"))
    shown = {k: F.nanvl(v, F.lit(None)) if k == "first_position" else F.round(v, 9) if k.startswith("jaccard") else v for k, v in f.items()}
    return pairs.select("pos", "entry_pos", *[v.alias(k) for k, v in shown.items()])


@query(f"""WITH {_PAIRS}, x AS (SELECT doc_id AS pos, entry_pos, {_FEATURES} FROM f),
    s AS (SELECT pos, entry_pos, round(0.5 * heuristic + 0.3 * match_first_token + 0.2 * match_numeric, 9)::DOUBLE AS score FROM x)
    SELECT pos, arg_max(entry_pos, (score, -entry_pos)) AS entry_pos, max(score) AS score FROM s WHERE score >= 0.8 GROUP BY 1""")
def citation_links_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.citation_links(*_pairs(spark, sf_dir)).select("pos", "entry_pos", F.round("score", 9).alias("score"))


@query("""
    WITH w AS (SELECT DISTINCT replace(p_name || ' ' || p_type, ' ', '-') AS word FROM part WHERE contains(p_name, ' ')),
    u AS (SELECT replace(p_name || ' ' || p_type, ' ', '-') AS word, avg(p_size) / 100 AS prob FROM part GROUP BY 1),
    h AS (SELECT word, string_split(word, '-') AS parts, unnest(range(1, len(string_split(word, '-')))) AS i FROM w),
    p AS (SELECT word, i, array_to_string(parts[1:i], '-') AS pre, array_to_string(parts[i + 1:], '-') AS suf FROM h)
    SELECT p.word, i AS hyphen, regexp_replace(p.word, '\\w', 'x', 'g') AS shape, lower(suf) AS s_lower, left(suf, 2) AS s_bg1,
           CASE WHEN length(suf) > 2 THEN suf[2:3] ELSE '' END AS s_bg2, CASE WHEN length(suf) > 3 THEN suf[3:4] ELSE '' END AS s_bg3,
           lower(pre) AS p_lower, reverse(CASE WHEN length(pre) > 1 THEN right(pre, 2) ELSE '' END) AS p_bg1,
           reverse(CASE WHEN length(pre) > 2 THEN left(right(pre, 3), 2) ELSE '' END) AS p_bg2,
           reverse(CASE WHEN length(pre) > 3 THEN left(right(pre, 4), 2) ELSE '' END) AS p_bg3,
           regexp_matches(pre, '^[A-Z]')::INT AS p_upper, regexp_full_match(pre, '[0-9]+')::INT AS p_number, regexp_full_match(pre, '[A-Za-z]+')::INT AS p_isalpha,
           length(pre)::INT AS p_len, regexp_matches(suf, '^[A-Z]')::INT AS s_upper, regexp_full_match(suf, '[0-9]+')::INT AS s_number,
           regexp_full_match(suf, '[A-Za-z]+')::INT AS s_isalpha, length(suf)::INT AS s_len,
           round(coalesce(a.prob, 0.001) - coalesce(b.prob, 0.001), 9) AS uni_prob, (length(p.word) - length(replace(p.word, '-', '')) > 1)::INT AS multi_hyphen
    FROM p LEFT JOIN u a ON p.word = a.word LEFT JOIN u b ON pre || suf = b.word""")  # fmt: skip
def hyphen_features_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts with hyphens for spaces; their mean sizes stand for the shares of words in a corpus."""
    part = table(spark, sf_dir, "part")
    hyphened = F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit("-"))
    shares = part.groupBy(hyphened.alias("word")).agg((F.avg("p_size") / 100).alias("prob"))
    made = words.hyphen_features(part.where("p_name like '% %'").select(hyphened.alias("word")).distinct(), shares, 0.001)
    return made.withColumn("uni_prob", F.round("uni_prob", 9))


@query("""
    WITH w AS (SELECT DISTINCT replace(p_name || ' ' || p_type, ' ', '-') AS word FROM part WHERE contains(p_name, ' ')),
    h AS (SELECT word, string_split(word, '-') AS parts FROM w)
    SELECT word AS original, parts[1] || array_to_string(list_transform(range(2, len(parts) + 1),
             lambda i: CASE WHEN length(array_to_string(parts[1:i - 1], '-')) % 2 = 0 THEN '-' ELSE '' END || parts[i]), '') AS new FROM h""")
def hyphen_edits_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule in place of a classifier keeps a hyphen behind an even number of characters."""
    part = table(spark, sf_dir, "part").where("p_name like '% %'").select(F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit("-")).alias("word")).distinct()
    shares = part.limit(0).select("word", F.lit(0.0).alias("prob"))
    scored = words.hyphen_features(part, shares, 0.0).withColumn("score", F.when(F.col("p_len") % 2 == 0, 0.0).otherwise(-9.0))
    return words.hyphen_edits(scored).select("original", "new")
