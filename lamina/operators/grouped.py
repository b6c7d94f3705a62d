"""Operators that walk one document, or one page, in order; each group is one document at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


#: Pairs of boxes that are compared at once.
PAIRS = 1 << 20


def _pairs(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place with the ``n`` places from its ``first`` on, so many pairs at a time, one place more or less."""
    upto = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        ends = np.cumsum(n[a:b])
        yield np.repeat(np.arange(a, b), n[a:b]), np.arange(ends[-1]) + np.repeat(first[a:b] - (ends - n[a:b]), n[a:b])
        a = b


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def met_boxes(key: np.ndarray, box: tuple, other_key: np.ndarray, other: tuple, by_center: bool = False, pad_x: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the boxes (l, t, w, h) of equal keys that meet, in order of both; ``by_center`` asks for the centre of the first."""
    order = np.argsort(other_key, kind="stable")
    ordered = other_key[order]
    l, t, w, h = box  # noqa: E741
    x1, x2, y1, y2 = (l + w / 2, l + w / 2, t + h / 2, t + h / 2) if by_center else (l, l + w, t, t + h)
    ol, ot, right, bottom = other[0][order], other[1][order], (other[0] + other[2])[order], (other[1] + other[3])[order]
    first = np.searchsorted(ordered, key, side="left")
    found = []
    for i, j in _pairs(first, np.searchsorted(ordered, key, side="right") - first):
        hit = np.flatnonzero((x1[i] - pad_x <= right[j]) & (ol[j] <= x2[i] + pad_x) & (y1[i] <= bottom[j]) & (ot[j] <= y2[i]))
        found.append((i[hit], order[j[hit]]))
    return _joined(found)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the first one that it is connected with by pairs."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    return label


def components_on(key: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, pad_x: float, pad_y: float) -> np.ndarray:
    """:func:`components_of` for the boxes of many pages at once, which ``key`` tells apart."""
    n = len(left)
    # Sides as ranks, so that page and side are one number.
    rank = np.unique(np.r_[left, right + pad_x], return_inverse=True)[1].reshape(-1)
    key = key.astype(np.int64) * (2 * n + 1)
    order = np.argsort(key + rank[:n], kind="stable")
    upto = np.searchsorted((key + rank[:n])[order], (key + rank[n:])[order], side="right")
    after = np.arange(n) + 1
    t, b = top[order], bottom[order]
    found = []
    for i, j in _pairs(after, np.maximum(upto - after, 0)):
        hit = np.flatnonzero((t[j] - pad_y <= b[i]) & (t[i] <= b[j] + pad_y))
        found.append((order[i[hit]], order[j[hit]]))
    return _roots(n, *_joined(found))


def components_of(left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, pad_x: float, pad_y: float) -> np.ndarray:
    """For each box the place of the first one that it is connected with; padded boxes that meet are, along a sweep by left edge."""
    return components_on(np.zeros(len(left), np.int64), left, top, right, bottom, pad_x, pad_y)


def box_components(spans: DataFrame, pad_x: float, pad_y: float) -> DataFrame:
    """Hulls of spans whose padded boxes meet, directly or through others, on each page.

    ``spans``: doc_id, page, start, end, l, t, w, h. Spans with the same start and end are
    one node, with the box of the first.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.drop_duplicates(["start", "end"]).sort_values(["l", "start"], kind="stable").reset_index(drop=True)
        p["r"], p["b"] = p.l + p.w, p.t + p.h
        p["c"] = components_of(*(p[c].to_numpy() for c in "ltrb"), pad_x, pad_y)
        g = p.groupby("c").agg(start=("start", "min"), end=("end", "max"), l=("l", "min"), t=("t", "min"), r=("r", "max"), b=("b", "max"), n=("c", "size"))
        g["w"], g["h"] = g.r - g.l, g.b - g.t
        g["doc_id"], g["page"] = pdf.doc_id.iloc[0], pdf.page.iloc[0]
        return g.reset_index(drop=True)[["doc_id", "page", "start", "end", "l", "t", "w", "h", "n"]]

    schema = "doc_id long, page long, start long, end long, l double, t double, w double, h double, n long"
    return spans.groupBy("doc_id", "page").applyInPandas(merge, schema)


def walk_lines(new: np.ndarray, left: np.ndarray, width: np.ndarray, middle: np.ndarray, y_tolerance: float, x_tolerance: float) -> list[int]:
    """The line of each token in order, counted from 0 wherever ``new`` says that a page begins."""
    line, lines, total, n, right = -1, [], 0.0, 0, 0.0
    for opens, l, w, m in zip(new.tolist(), left.tolist(), width.tolist(), middle.tolist(), strict=True):  # noqa: E741
        if opens:
            line, n = -1, 0
        if n == 0 or abs(m - total / n) > y_tolerance or l - right > x_tolerance:
            line, total, n = line + 1, 0.0, 0
        total, n, right = total + m, n + 1, l + w
        lines.append(line)
    return lines


def lines_of(tokens: DataFrame, y_tolerance: float, x_tolerance: float) -> DataFrame:
    """Tokens (doc_id, page, pos, l, t, w, h) with the line they are on.

    A line ends where a token's middle is off the mean middle of the line so far, or where
    it starts too far behind the token before.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")
        new = np.arange(len(p)) == 0
        lines = walk_lines(new, p.l.to_numpy(), p.w.to_numpy(), (p.t + p.h / 2).to_numpy(), y_tolerance, x_tolerance)
        return p[["doc_id", "page", "pos"]].assign(line=lines)

    return tokens.groupBy("doc_id", "page").applyInPandas(walk, "doc_id long, page long, pos long, line long")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of rows and columns that cost the least together, as many as the shorter side has."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    row_price, column_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            reduced = c[owner[at] - 1] - row_price[owner[at]] - column_price[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better], way[1:][better] = reduced[better], at
            step_to = int(np.argmin(np.where(done, np.inf, slack)))
            step = slack[step_to]
            row_price[owner[done]] += step
            column_price[done] -= step
            slack[~done] -= step
            at = step_to
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def match_captions(costs: DataFrame) -> DataFrame:
    """The cheapest one-to-one match on each page: doc_id, page, object_pos, caption_pos, cost.

    ``costs`` has one row per object and caption of a page.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="object_pos", columns="caption_pos", values="cost").sort_index(axis=0).sort_index(axis=1)
        pairs = assign(grid.to_numpy())
        return pd.DataFrame({
            "doc_id": pdf.doc_id.iloc[0], "page": pdf.page.iloc[0],
            "object_pos": [grid.index[i] for i, _ in pairs], "caption_pos": [grid.columns[j] for _, j in pairs],
            "cost": [grid.iat[i, j] for i, j in pairs],
        })

    return costs.groupBy("doc_id", "page").applyInPandas(match, "doc_id long, page long, object_pos long, caption_pos long, cost double")


def taken_spans(owner: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, group, place, start and end of the spans of tokens that groups have taken, in order of both; places are counted by start for each owner."""
    order = np.lexsort((start, group, owner))
    owner, group, start, end = owner[order], group[order], start[order], end[order]
    if not len(owner):
        return owner, group, owner, start, end
    new = np.r_[True, (np.diff(owner) != 0) | (np.diff(group) != 0)]
    first = np.flatnonzero(new | np.r_[True, start[1:] - end[:-1] > 1])
    last = np.r_[first[1:], len(owner)] - 1
    heads = np.flatnonzero(new)
    by_start = np.lexsort((start[heads], owner[heads]))
    rank = np.empty(len(heads), np.int64)
    rank[by_start] = np.arange(len(heads)) - np.searchsorted(owner[heads], owner[heads])
    return owner[first], group[first], rank[np.cumsum(new) - 1][first], start[first], end[last]


def allocate_exclusively(tokens: DataFrame, boxes: DataFrame, by_center: bool = False, pad_x: float = 0.0, cut_used: bool = True) -> DataFrame:
    """Groups of boxes take tokens in turn: doc_id, pos (by start), group_pos, start, end per derived span.

    ``tokens``: doc_id, pos, start, end, page and a box; ``boxes``: doc_id, group_pos,
    box_pos, page and a box. A group takes the free tokens in its boxes; neighbours at most
    one character apart merge, and free tokens that the merged spans cover are taken too.
    Tokens that others hold are cut out of the spans if ``cut_used``.
    """

    schema = "doc_id long, pos long, group_pos long, start long, end long"
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])

    def walk(key, t: pa.Table, b: pa.Table) -> pa.Table:
        if not t.num_rows or not b.num_rows:
            return kinds.empty_table()
        t = {c: t[c].to_numpy() for c in ("start", "end", "page", *"ltwh")}
        b = {c: b[c].to_numpy() for c in ("group_pos", "box_pos", "page", *"ltwh")}
        by_start, turn = np.argsort(t["start"], kind="stable"), np.lexsort((b["box_pos"], b["group_pos"]))
        turn = turn[b["page"][turn] == b["page"][turn]]
        group, start, end = _taken({c: v[by_start] for c, v in t.items()}, {c: v[turn] for c, v in b.items()}, by_center, pad_x, cut_used)
        begins = np.full(len(group), np.iinfo(np.int64).max)
        of = np.unique(group, return_inverse=True)[1].reshape(-1)
        np.minimum.at(begins, of, start)
        pos = np.unique(begins[of], return_inverse=True)[1].reshape(-1)
        order = np.lexsort((start, pos))
        columns = [np.full(len(group), key[0].as_py()), pos[order], group[order], start[order], end[order]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=kinds)

    # Both may come from one table of documents; new names tell their columns apart.
    tokens, boxes = tokens.select("doc_id", "start", "end", "page", *"ltwh"), boxes.select("doc_id", "group_pos", "box_pos", "page", *"ltwh")
    tokens, boxes = tokens.toDF(*tokens.columns), boxes.toDF(*boxes.columns)
    return tokens.groupBy("doc_id").cogroup(boxes.groupBy("doc_id")).applyInArrow(walk, schema)


def _taken(t: dict, b: dict, by_center: bool, pad_x: float, cut_used: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, start and end of what groups of boxes take in turn of one document; tokens are in order of start, boxes in turn."""
    start, end = t["start"], t["end"]
    x1, y1, w, h = t["l"], t["t"], t["w"], t["h"]
    if by_center:
        x1, y1 = (x1 + (x1 + w)) / 2, (y1 + (y1 + h)) / 2
        w, h = np.zeros(len(w)), np.zeros(len(h))
    i, j = met_boxes(t["page"], (x1, y1, w, h), b["page"], tuple(b[c] for c in "ltwh"), pad_x=pad_x)
    if (end >= start).all() and (start[1:] >= end[:-1]).all() and (start[2:] - end[:-2] > 1).all():
        # No token stands between two that are at most a character apart, so the first box that meets a token takes it.
        first = np.flatnonzero(np.r_[True, np.diff(i) > 0][: len(i)])
        _, group, _, a, z = taken_spans(np.zeros(len(first), np.int64), b["group_pos"][j[first]], start[i[first]], end[i[first]])
        return group, a, z
    free, found = np.ones(len(start), bool), []
    order = np.lexsort((i, j))
    i, group = i[order], b["group_pos"][j[order]]
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(0, np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.unique(i[lo:hi])
        own = own[free[own]]
        if not len(own):
            continue
        taken = np.zeros(len(start), bool)
        taken[own], free[own] = True, False
        breaks = np.r_[True, start[own][1:] - end[own][:-1] > 1]
        for k, z in zip(own[breaks], own[np.r_[np.flatnonzero(breaks)[1:] - 1, len(own) - 1]], strict=True):
            piece_start = None
            for at in range(k, z + 1):
                usable = taken[at] or free[at] or not cut_used
                if usable and piece_start is None:
                    piece_start = start[at]
                if usable:
                    piece_end = end[at]
                elif piece_start is not None:
                    found.append((group[lo], piece_start, piece_end))
                    piece_start = None
                free[at] = False
            if piece_start is not None:
                found.append((group[lo], piece_start, piece_end))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def nest_sections(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, pos, number) with a parent, or -1.

    Candidates are the open sections, from the last one up; a section whose number names
    its parent goes there, one without a number goes to the last open one's parent, and
    what is placed closes all that were open below its parent.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")
        spine: list[tuple[int, str | None]] = []
        parents = []
        for pos, number in zip(p.pos, p.number, strict=True):
            number = None if pd.isna(number) else number
            wanted = number.rpartition(".")[0] if number and "." in number else None
            if wanted is not None:
                at = max((i for i, (_, n) in enumerate(spine) if n == wanted), default=-1)
            elif number is not None or not spine:
                at = -1
            else:
                at = len(spine) - 2
            parents.append(spine[at][0] if at >= 0 else -1)
            spine = [*spine[: at + 1], (pos, number)]
        return p[["doc_id", "pos", "number"]].assign(parent=parents)

    return sections.groupBy("doc_id").applyInPandas(walk, "doc_id long, pos long, number string, parent long")


def outline_parents(items: DataFrame) -> DataFrame:
    """Outline items (doc_id, pos, level) with the last item before them that is above them, or -1."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")
        above: list[tuple[int, int]] = []
        parents = []
        for pos, level in zip(p.pos, p.level, strict=True):
            while above and above[-1][1] >= level:
                above.pop()
            parents.append(above[-1][0] if above else -1)
            above.append((pos, level))
        return p[["doc_id", "pos", "level"]].assign(parent=parents)

    return items.groupBy("doc_id").applyInPandas(walk, "doc_id long, pos long, level long, parent long")
