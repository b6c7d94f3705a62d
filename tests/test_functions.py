import pytest
from pyspark.sql import functions as F

from lamina.functions import boxes, text
from lamina.sources import documents


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "a, b, want", [("kitten", "sitting", 3), ("", "abc", 3), ("Na+", "Na⁺", 1), ("", "", 0)]
)
def test_levenshtein(spark, a, b, want):
    assert value(spark, text.levenshtein(F.lit(a), F.lit(b))) == want


def test_normalised_levenshtein(spark):
    assert value(spark, text.levenshtein(F.lit(""), F.lit(""), normalize=True)) == 0
    assert value(spark, text.levenshtein(F.lit("A b"), F.lit("ab"), case_sensitive=False, strip_spaces=True)) == 0
    assert value(spark, text.similarity(F.lit("abcd"), F.lit("abcx"))) == 0.75


def test_short_texts_have_no_ngrams(spark):
    assert value(spark, text.char_ngrams(F.lit("ab"), 3)) == []
    assert value(spark, text.char_ngrams(F.lit("abcd"), 3)) == ["abc", "bcd"]
    assert value(spark, text.jaccard_ngrams(F.lit(""), F.lit(""), 2)) == 0


@pytest.mark.parametrize(
    "heading, prefix, parent", [("1 Intro", "1", None), ("2.3. Part", "2.3", "2"), ("Intro", None, None), ("1.2.3 x", "1.2.3", "1.2")]
)
def test_number_prefix(spark, heading, prefix, parent):
    assert value(spark, text.number_prefix(F.lit(heading))) == prefix
    assert value(spark, text.implied_parent(F.lit(heading))) == parent


def test_heading_predicates(spark):
    assert value(spark, text.is_top_level_keyword(F.lit("I. Introduction:")))
    assert not value(spark, text.is_top_level_keyword(F.lit("a long introduction")))
    assert value(spark, text.has_period_prefix(F.lit("A. Proof")))
    assert not value(spark, text.has_period_prefix(F.lit("1.1. Proof")))
    assert value(spark, text.has_upper_letter_prefix(F.lit("A Proof")))


def test_punctuation_is_a_stretch_of_the_string(spark):
    assert value(spark, text.is_punctuation(F.lit("()")))
    assert not value(spark, text.is_punctuation(F.lit(")(")))
    assert value(spark, text.strip_punctuation(F.lit(" %Word.%"))) == "word"


def test_indel_ratio(spark):
    assert value(spark, text.indel_ratio(F.lit("abcd"), F.lit("abxd"))) == 75
    assert value(spark, text.indel_ratio(F.lit(""), F.lit(""))) == 100


def box(l, t, w, h):  # noqa: E741
    return boxes.Box(*[F.lit(float(x)) for x in (l, t, w, h)])


def test_overlap_share(spark):
    share = lambda a, b: value(spark, boxes.overlap_share(box(*a), box(*b)))
    assert share((0, 0, 2, 2), (1, 0, 4, 4)) == 0.5
    assert share((0, 0, 2, 2), (1, 1, 4, 4)) == 0.25
    assert share((1, 1, 1, 1), (0, 0, 4, 4)) == 1
    assert share((0, 0, 1, 1), (1, 0, 1, 1)) == 0


def test_caption_distance(spark):
    far = value(spark, boxes.caption_distance(box(0.1, 0.1, 0.1, 0.1), box(0.6, 0.2, 0.1, 0.1), F.lit("Figure")))
    near = value(spark, boxes.caption_distance(box(0.1, 0.1, 0.1, 0.1), box(0.1, 0.2, 0.1, 0.1), F.lit("Figure")))
    assert far == 900 and round(near, 9) == 0.15


def test_clipping(spark):
    made, changed = boxes.from_page_corners(*[F.lit(float(x)) for x in (-5, 10, 50, 300)], F.lit(100.0), F.lit(200.0))
    assert value(spark, boxes.struct(made)).asDict() == {"l": 0, "t": 10, "w": 50, "h": 190}
    assert value(spark, changed)


def test_json_round_trip(spark):
    raw = '{"symbols":"ab cd","tokens":[{"spans":[{"start":0,"end":2}],"id":0},{"spans":[{"start":3,"end":5}],"id":1,"type":"T","text":"x"}],"empty":[]}'
    parsed = documents.parse(spark.createDataFrame([(1, raw)], "doc_id long, json string"))
    layer = documents.annotations(parsed)
    assert [(r.field, r.pos, r.type, r.text) for r in layer.orderBy("pos").collect()] == [("tokens", 0, None, None), ("tokens", 1, "T", "x")]
    back = documents.parse(documents.to_json(parsed.select("doc_id", "symbols"), layer))
    again = documents.annotations(back)
    assert again.select("field", "pos", "id", "text", "spans").exceptAll(layer.select("field", "pos", "id", "text", "spans")).count() == 0
    assert back.first().symbols == "ab cd"


def test_indel_ratio_of_brute_force(spark):
    import random
    from functools import lru_cache

    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 12)))) for _ in range(200)]

    def want(a, b):
        @lru_cache(None)
        def common(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(common(i + 1, j), common(i, j + 1), 1 + common(i + 1, j + 1) if a[i] == b[j] else 0)

        return round(200 * common(0, 0) / (len(a) + len(b))) if a or b else 100

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == want(r.a, r.b) for r in got)


def test_citation_features_are_in_order(spark):
    made = text.citation_features(F.lit("\t\n"), F.lit("x"))
    assert list(made) == (
        "fuzz_ratio jaccard_1gram jaccard_2gram jaccard_3gram jaccard_4gram heuristic has_source_text jaccard_numeric match_numeric jaccard_alpha"
        " match_first_token first_position"
    ).split()
    assert value(spark, made["has_source_text"]) == 0 and value(spark, text.has_text(F.lit("\u00a0x"))) == 1


def test_hyphens_at_the_edge_are_errors(spark):
    import pytest

    from lamina.operators import words

    shares = spark.createDataFrame([("a-b", 0.5)], "word string, prob double")
    row = words.hyphen_features(spark.createDataFrame([("a-b",)], "word string"), shares, 0.1).first()
    assert len(row) == 21 and abs(row.uni_prob - 0.4) < 1e-12 and row.p_bg1 == "" and row.s_bg1 == "b"
    with pytest.raises(Exception, match="hyphens"):
        words.hyphen_features(spark.createDataFrame([("-b",)], "word string"), shares, 0.1).collect()


def test_spans_with_boxes_have_to_be_as_many(spark):
    from lamina.functions import spans

    kind = "spans array<struct<start:long,end:long>>, boxes array<struct<l:double,t:double,w:double,h:double,page:int>>"
    box = (0.1, 0.2, 0.3, 0.4, 0)
    zipped = lambda *rows: [r[0] for r in spark.createDataFrame(rows, kind).select(spans.with_boxes(F.col("spans"), F.col("boxes"))).collect()]
    got = zipped(([(0, 2), (3, 5)], [box, box]), ([], []), (None, [box]), ([(0, 1)], None))
    assert [None if g is None else [(s.start, s.end, tuple(s.box)) for s in g] for g in got] == [[(0, 2, box), (3, 5, box)], [], None, None]
    with pytest.raises(Exception, match="differ in number: 2, 1"):
        zipped(([(0, 2), (3, 5)], [box]))


def test_first_title_of_citations(spark):
    from lamina.sources import tei

    cases = {
        "<a><title> One </title><title>Two</title></a>": "One", "<a><b/></a>": None, "<a><title/><title>Two</title></a>": None,
        "<a><title><i>x</i>y</title></a>": None, "<a><title>x<i>y</i></title></a>": "x", "<a><b><title>\n deep\t</title></b></a>": "deep", "<a><title> </title></a>": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, tei string")
    assert [r.title for r in tei.citation_title(docs).orderBy("doc_id").collect()] == list(cases.values())


def test_citation_features_of_sides(spark):
    """What is made once for each side gives what is made for each pair."""
    from pyspark.sql import functions as F

    from lamina.functions import text
    from lamina.operators import predictors

    values = ["Smith et al., 2019", "[2]", "", " ", "Lee and Kim (2020) 11", "et al", "[1] J. Smith, A. Doe. Deep things. 2019.", "x" * 120 + " 7"]
    both = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(values)], "doc_id long, pos long, text string")
    pairs = predictors.citation_pairs(both, both)
    got = pairs.select("pos", "entry_pos", *[v.alias(k) for k, v in text.citation_features_of(F.col("source"), F.col("target")).items()])
    joined = both.join(both.select("doc_id", F.col("pos").alias("entry_pos"), F.col("text").alias("entry")), "doc_id")
    plain = {k: v for k, v in text.citation_features(F.col("text"), F.col("entry")).items() if k != "fuzz_ratio"}
    want = joined.select("pos", "entry_pos", *[v.alias(k) for k, v in plain.items()])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 32
