"""Half-open character spans ``[start, end)`` as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,box:struct<l:double,t:double,w:double,h:double,page:int>>"


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Spans that merely touch do not overlap."""
    return (start < other_end) & (end > other_start)


def contains(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    return (start >= outer_start) & (end <= outer_end)


def substring(symbols: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text."""
    return F.substring(symbols, start.cast("int") + 1, (end - start).cast("int"))


def symbols_of(symbols: Column, spans: Column) -> Column:
    """One substring for each span of an array."""
    return F.transform(spans, lambda s: substring(symbols, s["start"], s["end"]))


def text_of(symbols: Column, spans: Column, text: Column | None = None) -> Column:
    """A group's text: its own if set, else its substrings with spaces between."""
    joined = F.array_join(symbols_of(symbols, spans), " ")
    return joined if text is None else F.coalesce(text, joined)


def group_start(spans: Column) -> Column:
    """Smallest start of a group; null where it has no spans."""
    return F.array_min(F.transform(spans, lambda s: s["start"]))


def group_end(spans: Column) -> Column:
    return F.array_max(F.transform(spans, lambda s: s["end"]))


def with_boxes(spans: Column, boxes: Column) -> Column:
    """The spans of a group, each with the box in its place. An error if there are not as many boxes as spans; null if either is."""
    count = F.concat(F.lit("spans and boxes of a group differ in number: "), F.size(spans).cast("string"), F.lit(", "), F.size(boxes).cast("string"))
    even = F.when(F.size(spans) == F.size(boxes), spans).otherwise(F.raise_error(count))
    zipped = F.zip_with(even, boxes, lambda s, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), b.alias("box")))
    return F.when(spans.isNotNull() & boxes.isNotNull(), zipped)


def hull(spans: Column, merge_boxes: bool = True) -> Column:
    """One span over all; it has the envelope of their boxes if every span has a box."""
    from lamina.functions.boxes import envelope

    boxes = F.transform(spans, lambda s: s["box"])
    box = F.when(F.forall(boxes, lambda b: b.isNotNull()), envelope(boxes)) if merge_boxes else F.lit(None)
    return F.struct(group_start(spans).alias("start"), group_end(spans).alias("end"), box.alias("box"))


def are_disjoint(spans: Column) -> Column:
    """Whether no two spans of an array overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    n = F.size(ordered)
    following = F.slice(ordered, 2, F.greatest(n - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(ordered, 1, F.greatest(n - 1, F.lit(0))).alias("a"), following.alias("b"))
    return F.forall(pairs, lambda p: p["a"]["end"] <= p["b"]["start"])


def at(group: Column, index: int) -> Column:
    """Element of a group by its place, from 0; null beyond the end."""
    return F.try_element_at(group, F.lit(index + 1))


def close_to_next(end: Column, next_start: Column, slack: int = 5) -> Column:
    return (end <= next_start) & (next_start <= end + slack)
