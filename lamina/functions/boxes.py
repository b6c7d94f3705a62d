"""Boxes as columns: left, top, width and height, with a page, usually in parts of the page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """The four columns of a box."""

    l: Column  # noqa: E741
    t: Column
    w: Column
    h: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*[F.col(prefix + c) for c in "ltwh"])

    @property
    def right(self) -> Column:
        return self.l + self.w

    @property
    def bottom(self) -> Column:
        return self.t + self.h


def struct(box: Box, page: Column | None = None) -> Column:
    fields = [box.l.alias("l"), box.t.alias("t"), box.w.alias("w"), box.h.alias("h")]
    return F.struct(*fields, *([page.alias("page")] if page is not None else []))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    return Box(x1, y1, x2 - x1, y2 - y1)


def from_page_corners(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Box, Column]:
    """A box clipped to its page, and whether that changed it; reversed sides collapse."""
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    a, b, c, d = clip(x1, width), clip(y1, height), clip(x2, width), clip(y2, height)
    c, d = F.greatest(a, c), F.greatest(b, d)
    changed = (a != x1) | (b != y1) | (c != x2) | (d != y2)
    return from_corners(a, b, c, d), changed


def corners(box: Box) -> tuple[Column, Column, Column, Column]:
    return box.l, box.t, box.right, box.bottom


def center(box: Box) -> tuple[Column, Column]:
    return box.l + box.w / 2, box.t + box.h / 2


def relative(box: Box, width: Column, height: Column) -> Box:
    return Box(box.l / width, box.t / height, box.w / width, box.h / height)


def absolute(box: Box, width: Column, height: Column) -> Box:
    return Box(box.l * width, box.t * height, box.w * width, box.h * height)


def flip(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box measured from the bottom left, as one from the top left in parts of the page; null if not a number."""
    bad = F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h)
    box = relative(Box(x, height - y - h, w, h), width, height)
    return F.when(~bad, struct(box))


def overlaps_1d(start: Column, end: Column, other_start: Column, other_end: Column, pad: Column | float = 0.0) -> Column:
    """Closed intervals with padding: touching ones overlap."""
    pad = pad if isinstance(pad, Column) else F.lit(float(pad))
    return (start - pad <= other_end) & (other_start <= end + pad)


def overlaps(box: Box, other: Box, pad_x: Column | float = 0.0, pad_y: Column | float = 0.0, by_center: bool = False) -> Column:
    """Whether two boxes meet, or, by centre, whether ``other`` holds the centre of ``box``. Pages are up to the caller."""
    if by_center:
        x, y = center(box)
        return overlaps_1d(x, x, other.l, other.right, pad_x) & overlaps_1d(y, y, other.t, other.bottom, pad_y)
    return overlaps_1d(box.l, box.right, other.l, other.right, pad_x) & overlaps_1d(
        box.t, box.bottom, other.t, other.bottom, pad_y
    )


def overlap_share(box: Box, container: Box) -> Column:
    """Part of the area of ``box`` inside ``container``; 0 where they only touch."""
    w = F.least(box.right, container.right) - F.greatest(box.l, container.l)
    h = F.least(box.bottom, container.bottom) - F.greatest(box.t, container.t)
    inside = (box.l >= container.l) & (box.t >= container.t) & (box.right <= container.right) & (box.bottom <= container.bottom)
    return F.when(inside, 1.0).when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / (box.w * box.h))


def envelope(boxes: Column) -> Column:
    """The smallest box around an array of boxes; nulls are skipped, none give null, several pages raise."""
    found = F.filter(boxes, lambda b: b.isNotNull())
    l, t = F.array_min(F.transform(found, lambda b: b["l"])), F.array_min(F.transform(found, lambda b: b["t"]))  # noqa: E741
    r = F.array_max(F.transform(found, lambda b: b["l"] + b["w"]))
    d = F.array_max(F.transform(found, lambda b: b["t"] + b["h"]))
    pages = F.array_distinct(F.transform(found, lambda b: b["page"]))
    made = F.struct(l.alias("l"), t.alias("t"), (r - l).alias("w"), (d - t).alias("h"), F.try_element_at(pages, F.lit(1)).alias("page"))
    return (
        F.when(F.size(found) == 0, F.lit(None))
        .when(F.size(pages) > 1, F.raise_error(F.lit("boxes of several pages have no envelope")))
        .otherwise(made)
    )


def envelope_aggs(prefix: str = "") -> list[Column]:
    """Aggregates l, t, w, h of the envelope of a group of rows."""
    b = Box.of(prefix)
    return [
        F.min(b.l).alias("l"), F.min(b.t).alias("t"),
        (F.max(b.right) - F.min(b.l)).alias("w"), (F.max(b.bottom) - F.min(b.t)).alias("h"),
    ]


def normalize_bbox(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, to: int = 1000) -> Column:
    """Coordinates scaled to ``to`` by ``to`` if a side of the page is longer than that."""
    large = (width > to) | (height > to)
    fit = lambda v, side: F.when(large, v / side * to).otherwise(v.cast("double"))
    return F.array(fit(x1, width), fit(y1, height), fit(x2, width), fit(y2, height))


def near_1d(start: Column, end: Column, other_start: Column, other_end: Column, gap: float) -> Column:
    """Overlap, or a gap of at most ``gap``."""
    return F.greatest(start, other_start) - F.least(end, other_end) <= F.lit(gap)


def near(box: Box, other: Box, gap_x: float, gap_y: float) -> Column:
    return near_1d(box.l, box.right, other.l, other.right, gap_x) & near_1d(box.t, box.bottom, other.t, other.bottom, gap_y)


#: Fixed value: what an impossible caption costs.
NO_CAPTION = 900.0


def caption_distance(figure: Box, caption: Box, kind: Column) -> Column:
    """Cost of a caption for a figure or table: how far its bottom is below the other's centre.

    Centres more than a tenth apart sideways, measured by the figure's, cost 900, as does
    a caption that does not end below the centre of a figure.
    """
    fx, fy = center(figure)
    cx, _ = center(caption)
    cost = F.when(F.abs(fx - cx) > 0.1 * fx, NO_CAPTION).otherwise(caption.bottom - fy)
    return F.when((kind == "Figure") & (cost <= 0), NO_CAPTION).otherwise(cost)
