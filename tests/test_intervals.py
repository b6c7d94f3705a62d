import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.functions import boxes
from lamina.operators import intervals, layers, segments


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, pos long, start long, end long")


def test_half_open_overlap_of_groups(spark):
    layer = spans(spark, [(1, 0, 0, 2), (1, 1, 2, 5), (1, 2, 6, 10), (1, 3, 20, 22)])
    probe = spans(spark, [(1, 0, 1, 7), (1, 0, 9, 20)])
    met = intervals.interval_join(probe, layer, ["doc_id"])
    assert sorted({r.other_pos for r in met.collect()}) == [0, 1, 2]


@pytest.mark.parametrize("bucket", [None, 1, 7, 512])
def test_buckets_change_nothing(spark, bucket):
    rng = random.Random(5)
    a = [(d, i, s, s + rng.randint(1, 40)) for d in (1, 2) for i, s in enumerate(rng.sample(range(200), 20))]
    b = [(d, i, s, s + rng.randint(1, 40)) for d in (2, 3) for i, s in enumerate(rng.sample(range(200), 20))]
    met = intervals.interval_join(spans(spark, a), spans(spark, b), ["doc_id"], bucket=bucket)
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.doc_id, r.pos, r.other_pos) for r in met.collect()) == want


def test_layer_must_be_disjoint(spark):
    layer = spans(spark, [(1, 0, 0, 5), (1, 1, 5, 8), (1, 2, 7, 9)])
    assert [(r.pos, r.other_pos) for r in intervals.overlapping_pairs(layer).collect()] == [(1, 2)]


def test_asof(spark):
    rows = spans(spark, [(1, 0, 0, 9), (1, 1, 10, 19), (1, 2, 20, 29)])
    probe = spark.createDataFrame([(1, 0, 10), (1, 1, 19), (1, 2, 25), (2, 0, 5)], "doc_id long, pos long, start long")
    got = {(r.doc_id, r.pos): r.row_pos for r in intervals.asof_join(probe, rows).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (2, 0): None}


@pytest.mark.parametrize("distance, want", [(1, 1), (0, 3)])
def test_merge_by_distance(spark, distance, want):
    merged = segments.merge_by_distance(spans(spark, [(1, 0, 0, 10), (1, 1, 11, 20), (1, 2, 21, 30)]), distance)
    assert merged.count() == want


@pytest.mark.parametrize("distance, want", [(1, 2), (2, 2), (4, 2), (5, 1)])
def test_merge_at_a_gap_of_five(spark, distance, want):
    assert segments.merge_by_distance(spans(spark, [(1, 0, 0, 10), (1, 1, 15, 20)]), distance).count() == want


def test_tokens_agree_with_split(spark):
    texts = ["", " a  b\n c", "x", "one two\n\nthree ", "é 😀 ß"]
    docs = layers.spread(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {}
    for r in layers.tokens(docs).orderBy("doc_id", "pos").collect():
        assert texts[r.doc_id][r.start : r.end] == r.text
        found.setdefault(r.doc_id, []).append(r.text)
    assert found == {i: t.split() for i, t in enumerate(texts) if t.split()}
    for r in layers.rows(docs).collect():
        assert texts[r.doc_id][r.start : r.end] == r.text == texts[r.doc_id].split("\n")[r.pos]


def test_annotate_replaces_only_if_asked(spark):
    layer = spans(spark, [(1, 0, 0, 2)])
    one = layers.as_annotations(layer, "tokens")
    with pytest.raises(AssertionError):
        layers.annotate(one, layer, "tokens")
    assert layers.fields(layers.annotate(one, layer, "tokens", overwrite=True)) == ["tokens"]
    assert layers.fields(layers.annotate(one, layer.limit(0), "words")) == ["tokens"]
    with pytest.raises(ValueError):
        layers.as_annotations(layer, "symbols")


def test_required_fields(spark):
    both = layers.as_annotations(spans(spark, [(1, 0, 0, 2)]), "tokens")
    assert layers.require_fields(both, ["tokens"]).count() == 1
    with pytest.raises(Exception, match="missing layers"):
        layers.require_fields(both, ["rows"]).collect()


def test_boxes_that_touch_overlap(spark):
    a = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.5, 0.5)], "doc_id long, page long, pos long, l double, t double, w double, h double")
    b = a.withColumn("l", F.lit(0.5))
    assert intervals.box_join(a, b).count() == 1
    assert intervals.box_join(a, b, by_center=True).count() == 0
    assert intervals.unmatched(a, b, by_center=True).count() == 1


def grid_boxes(spark, n, seed, side):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        l, t = rng.choice([rng.random(), rng.randrange(17) / 16]), rng.choice([rng.random(), rng.randrange(17) / 16])  # noqa: E741
        rows.append((rng.choice([1, 1, 2]), i, rng.randrange(2), l, t, rng.choice([0.0, 1 / 16, rng.random() * side]), rng.random() * side))
    return rows


BOXES = "doc_id long, pos long, page long, l double, t double, w double, h double"


@pytest.mark.parametrize(("by_center", "pad"), [(False, 0.0), (False, 0.05), (True, 0.0), (True, 0.05)])
def test_boxes_of_a_grid_meet_as_all_pairs_do(spark, by_center, pad):
    a, b = grid_boxes(spark, 300, 1, 0.2), grid_boxes(spark, 80, 2, 0.7)
    left, right = (spark.createDataFrame([*x, (1, 900 + k, 0, None, 0.1, 0.1, 0.1), (1, 910 + k, None, 0.1, 0.1, 0.1, 0.1)], BOXES) for k, x in enumerate((a, b)))
    named = right.select(*[F.col(c).alias(f"box_{c}") for c in right.columns])
    meets = boxes.overlaps(boxes.Box.of(), boxes.Box.of("box_"), pad, by_center=by_center)
    pairs = left.crossJoin(named).where("doc_id = box_doc_id and page = box_page").where(meets).select("doc_id", "pos", "box_pos")
    want = Counter(map(tuple, pairs.collect()))
    got = intervals.box_join(left, right, by_center=by_center, pad_x=pad).select("doc_id", "pos", "box_pos")
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50
    per = Counter((d, p) for d, p, _ in want.elements())
    rows = intervals.allocate(left, right, by_center=by_center, pad_x=pad).collect()
    assert {(r.doc_id, r.pos): r.n_boxes for r in rows} == {(r[0], r[1]): per[r[0], r[1]] for r in left.collect()}


def test_a_page_of_many_boxes(spark):
    ids = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"), F.lit(0).cast("long").alias("page"),
        (F.col("id") % 400 / 400).alias("l"), (F.floor(F.col("id") / 400) / 250).alias("t"), F.lit(0.002).alias("w"), F.lit(0.003).alias("h"))
    met = intervals.box_join(ids.repartition(4), ids, cell=1 / 64)
    assert met.count() == 100_000


def test_boxes_in_points_and_beyond_the_page(spark):
    rng = random.Random(5)
    rows = [(1, i, 0, rng.random() * 900 - 100, rng.random() * 900 - 100, rng.random() * 100, rng.random() * 100) for i in range(150)]
    box = spark.createDataFrame(rows, BOXES)
    want = sum(abs((a[3] + a[5] / 2) - (b[3] + b[5] / 2)) <= (a[5] + b[5]) / 2 and abs((a[4] + a[6] / 2) - (b[4] + b[6] / 2)) <= (a[6] + b[6]) / 2 for a in rows for b in rows)
    assert intervals.box_join(box, box).count() == intervals.box_join(box, box, cell=intervals.mean_cell(box)).count() == want
