"""Joins by overlap, containment, order and boxes, within a document.

Spark has no interval join, so long documents would compare every pair. Spans are
therefore also dealt into buckets of ``bucket`` characters, and boxes into cells of a page;
only pairs that share one are compared, and a pair that shares several is kept in the one where it first meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import boxes, spans

BUCKET = 512


def _buckets(df: DataFrame, bucket: int, name: str) -> DataFrame:
    first = F.floor(F.col("start") / bucket)
    last = F.floor(F.greatest(F.col("end") - 1, F.col("start")) / bucket)
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "other_", bucket: int | None = BUCKET) -> DataFrame:
    """Pairs of rows with equal keys and overlapping ``[start, end)``; right columns get the prefix ``suffix``."""
    named = {c: c if c in keys else suffix + c for c in right.columns}
    meets = spans.overlaps(F.col("start"), F.col("end"), F.col(suffix + "start"), F.col(suffix + "end"))
    if bucket is None:
        return left.join(right.select(*[F.col(c).alias(n) for c, n in named.items()]), keys).where(meets)
    a = _buckets(left, bucket, "__bucket")
    b = _buckets(right, bucket, "__bucket").select(*[F.col(c).alias(n) for c, n in named.items()], "__bucket")
    first = F.floor(F.greatest("start", suffix + "start") / bucket)
    return a.join(b, [*keys, "__bucket"]).where(meets & (F.col("__bucket") == first)).drop("__bucket")


def navigate(annotations: DataFrame, source: str, target: str) -> DataFrame:
    """Which annotations of ``target`` each one of ``source`` overlaps, by all spans of both, each once.

    Gives doc_id, pos and target_pos, ordered by target_start.
    """
    parts = lambda field: annotations.where(F.col("field") == field).select(
        "doc_id", "pos", F.explode("spans").alias("s")
    ).select("doc_id", "pos", "s.start", "s.end")
    met = interval_join(parts(source), parts(target), ["doc_id"], "target_")
    return met.groupBy("doc_id", "pos", "target_pos").agg(F.min("target_start").alias("target_start"))


def overlapping_pairs(layer: DataFrame) -> DataFrame:
    """Pairs of a layer that overlap, which a layer must not have; gives doc_id, pos, other_pos."""
    met = interval_join(layer.select("doc_id", "pos", "start", "end"), layer.select("doc_id", "pos", "start", "end"), ["doc_id"])
    return met.where(F.col("pos") < F.col("other_pos")).select("doc_id", "pos", "other_pos")


def contained_join(inner: DataFrame, outer: DataFrame, keys: list[str], suffix: str = "outer_") -> DataFrame:
    """Pairs in which the left span lies within the right one."""
    met = interval_join(inner, outer, keys, suffix)
    return met.where(spans.contains(F.col("start"), F.col("end"), F.col(suffix + "start"), F.col(suffix + "end")))


def asof_join(left: DataFrame, right: DataFrame, key: str = "doc_id", suffix: str = "row_") -> DataFrame:
    """Each left row with the last right row that starts no later; null if there is none.

    One sort of both sides together, no pairs.
    """
    own = [c for c in left.columns if c != key]
    a = left.select(key, F.col("start").alias("__at"), F.lit(1).alias("__side"), F.struct(*own).alias("__left"),
                    F.lit(None).cast("bigint").alias("__pos"))
    b = right.select(key, F.col("start").alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__left"),
                     F.col("pos").alias("__pos"))
    order = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b.withColumn("__left", F.col("__left").cast(a.schema["__left"].dataType)))
    found = both.withColumn(suffix + "pos", F.last("__pos", ignorenulls=True).over(order)).where("__side = 1")
    return found.select(key, "__left.*", suffix + "pos")


#: Side of a cell, in parts of the page; sixteen by sixteen cells.
CELL = 1 / 16
#: Boxes reach so much further into cells, as sums of sides are rounded; what meets is asked of the boxes as they are.
SLACK = 1e-9
#: Cells on either side of a page; what lies beyond stands in the outermost.
SIDE = 64


def mean_cell(boxes_: DataFrame, sides: float = 2.0) -> float:
    """A side of cells that fits the boxes, for those that are not in parts of the page: so many mean sides."""
    size = boxes_.agg(F.avg(F.greatest("w", "h"))).first()[0]
    return sides * size if size else CELL


def _cell(at: Column, cell: float) -> Column:
    return F.least(F.greatest(F.floor(at / cell), F.lit(0).cast("bigint")), F.lit(SIDE - 1).cast("bigint"))


def _in_cells(df: DataFrame, box: boxes.Box, cell: float, pad_x: float, pad_y: float) -> DataFrame:
    """A row for every cell of the page that a box touches; boxes that lack a side are in none, and kept."""
    first_x, last_x = _cell(box.l - pad_x, cell), _cell(box.right + pad_x, cell)
    first_y, last_y = _cell(box.t - pad_y, cell), _cell(box.bottom + pad_y, cell)
    # Sides below zero hold nothing.
    across = F.when(last_x >= first_x, F.sequence(first_x, last_x))
    return df.withColumn("__x", F.explode_outer(across)).withColumn("__y", F.explode_outer(F.when(last_y >= first_y, F.sequence(first_y, last_y))))


def _met_boxes(left: DataFrame, right: DataFrame, suffix: str, by_center: bool, pad_x: float, cell: float, how: str) -> DataFrame:
    """Left rows with the right ones whose boxes they meet, each pair in one cell alone."""
    keys = ["doc_id", "page"]
    other = right.select(*[F.col(c).alias(f"{suffix}{c}") for c in right.columns])
    mine, theirs = boxes.Box.of(), boxes.Box.of(suffix)
    # Where the centre counts, a left box is a point, which stands in one cell.
    x, y = boxes.center(mine)
    a = _in_cells(left, boxes.Box(x, y, F.lit(0.0), F.lit(0.0)), cell, 0.0, 0.0) if by_center else _in_cells(left, mine, cell, SLACK, SLACK)
    b = _in_cells(other, theirs, cell, pad_x + SLACK, SLACK).withColumnsRenamed({"__x": "__ox", "__y": "__oy"})
    met = boxes.overlaps(mine, theirs, pad_x, by_center=by_center)
    same = (F.col("__x") == F.col("__ox")) & (F.col("__y") == F.col("__oy"))
    for k in keys:
        same = same & (F.col(k) == F.col(suffix + k))
    if not by_center:
        # Of all cells that two share, the one in which the later left and the later top sides lie.
        same = same & (F.col("__x") == _cell(F.greatest(mine.l, theirs.l - pad_x), cell)) & (F.col("__y") == _cell(F.greatest(mine.t, theirs.t), cell))
    return a.join(b, same & met, how).drop("__x", "__y", "__ox", "__oy", *[suffix + k for k in keys])


def box_join(left: DataFrame, right: DataFrame, suffix: str = "box_", by_center: bool = False, pad_x: float = 0.0, cell: float = CELL) -> DataFrame:
    """Pairs of one document and page whose boxes meet; ``by_center`` asks for the left one's centre.

    Pages are laid out in cells of side ``cell``, ``SIDE`` by ``SIDE`` of them, and only
    boxes that share one are compared; take :func:`mean_cell` where sides are not in parts of the page. Boxes without a page, or with a side missing or below zero, meet none.
    """
    return _met_boxes(left, right, suffix, by_center, pad_x, cell, "inner")


def allocate(left: DataFrame, right: DataFrame, by_center: bool = False, pad_x: float = 0.0, cell: float = CELL) -> DataFrame:
    """doc_id, pos, n_boxes and the first box_pos of every left row, whether it meets any or not, from one join."""
    met = _met_boxes(left.select("doc_id", "pos", "page", *"ltwh"), right.select("doc_id", "pos", "page", *"ltwh"), "box_", by_center, pad_x, cell, "left")
    return met.groupBy("doc_id", "pos").agg(F.count("box_pos").alias("n_boxes"), F.min("box_pos").alias("box_pos"))


def unmatched(left: DataFrame, right: DataFrame, by_center: bool = False) -> DataFrame:
    """(doc_id, pos) of the left rows whose box meets none of the right ones."""
    return allocate(left, right, by_center).where("n_boxes = 0").select("doc_id", "pos")


def first_box(left: DataFrame, right: DataFrame, by_center: bool = False) -> DataFrame:
    """Each left row with the first right box it meets, so no row goes to two boxes."""
    return allocate(left, right, by_center).where("n_boxes > 0").select("doc_id", "pos", "box_pos")


def best_box(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left row with the right box that covers most of it; the first of equals, none if nothing is covered."""
    share = boxes.overlap_share(boxes.Box.of(), boxes.Box.of("box_"))
    met = box_join(left, right).withColumn("share", share).where("share > 0")
    best = F.max_by(F.struct("box_pos", "share"), F.struct(F.col("share"), -F.col("box_pos")))
    return met.groupBy("doc_id", "pos").agg(best.alias("b")).select("doc_id", "pos", "b.box_pos", "b.share")
