"""Nesting of sections: each goes below the open section that a scorer likes best.

Open are the root and the sections on the path to the last one placed; what is placed
closes all that were open below its parent. A place depends on all before it, so the
sections of a document are taken in turn, but those of many documents together: at each
step the scorer gets the features of all open candidates of all documents at hand in one
array. No pairs of a document are made but those that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import text as tx

#: What a scorer gets of a parent and a child, in this order; flags are 0 or 1.
FEATURES = (
    "one_size_larger", "same_font", "parent_no_size", "child_no_size", "parent_bold", "child_bold", "page_distance", "same_page", "relative_y", "relative_x",
    "x_distance", "y_distance", "parent_number", "child_number", "child_number_top_level", "number_names_parent", "parent_is_root",
    "child_period_prefix", "child_keyword", "child_all_caps", "child_letter_prefix", "parent_period_prefix", "parent_keyword", "parent_all_caps", "parent_letter_prefix",
)
# What stands for sizes and fonts that are not known, and for the font of the root.
NO_SIZE, NO_FONT, ROOT_FONT, ROOT = -1.0, "[NONE]", "[ROOT]", -1
#: Sections that are nested together, a document more or less.
SECTIONS = 5_000

Scorer = Callable[[np.ndarray], np.ndarray]


def rule_score(x: np.ndarray) -> np.ndarray:
    """A rule in place of a trained model: numbers that name their parent, then sizes, then the root for what looks like a top level."""
    f = dict(zip(FEATURES, x.T, strict=True))
    top = np.maximum(f["child_number_top_level"], np.maximum(f["child_keyword"], f["child_all_caps"]))
    inner = f["child_number"] * (1 - f["child_number_top_level"])
    value = 6 * f["number_names_parent"] + 4 * top * f["parent_is_root"] + 2 * f["one_size_larger"] * (1 - inner) + 0.5 * f["parent_is_root"] - f["page_distance"]
    return 1 / (1 + np.exp(-value))


def size_score(x: np.ndarray) -> np.ndarray:
    """A rule by sizes alone: a parent one size larger, else the root."""
    return 0.1 + 0.8 * x[:, FEATURES.index("one_size_larger")] + 0.1 * x[:, FEATURES.index("parent_is_root")]


def section_features(sections: DataFrame) -> DataFrame:
    """What a section (doc_id, pos, text, font, size, page, l, t, n_pages) brings to a pair, with the defaults for what is null."""
    made = tx.heading_features(F.coalesce("text", F.lit("")))
    flag = lambda name: F.coalesce(made[name], F.lit(False)).cast("double")
    zero = F.lit(0.0)
    return sections.select(
        F.col("doc_id").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), F.coalesce("font", F.lit(NO_FONT)).alias("font"),
        F.coalesce(F.round("size", 4), F.lit(NO_SIZE)).cast("double").alias("size"), F.coalesce("page", F.lit(-1)).cast("double").alias("page"),
        F.coalesce(F.col("l").cast("double"), zero).alias("l"), F.coalesce(F.col("t").cast("double"), zero).alias("t"),
        F.greatest(F.coalesce("n_pages", F.lit(1)), F.lit(1)).cast("double").alias("n_pages"), made["prefix"].alias("number"), made["implied_parent"].alias("implied"),
        *[flag(c).alias(c) for c in ("top_level_prefix", "period_prefix", "top_level_keyword", "all_caps", "upper_letter_prefix")],
    )


class _Pairs:
    """The sections of some documents as arrays; place -1 stands for the root of any."""

    def __init__(self, p: pd.DataFrame):
        with_root = lambda values, root: np.r_[np.asarray(values), root]
        own = lambda c, root=0.0: with_root(p[c].to_numpy(float), root)
        self.page, self.l, self.t, self.n_pages = own("page", -1.0), own("l"), own("t"), own("n_pages", 1.0)
        self.no_size = own("size", NO_SIZE) == NO_SIZE
        size = p["size"].where(p["size"] > 0)
        self.rank = with_root(size.groupby(p["doc_id"], dropna=False).rank(method="dense").to_numpy(float), np.nan)
        self.font = pd.factorize(np.r_[p["font"].to_numpy(object), [ROOT_FONT]])[0]
        self.bold = with_root(p["font"].str.lower().str.contains("bold", regex=False).to_numpy(float), 0.0)
        # Numbers as codes, nulls as -1 and -2, which equal nothing.
        codes = pd.factorize(np.r_[p["number"].to_numpy(object), p["implied"].to_numpy(object)])[0]
        self.number, implied = with_root(codes[: len(p)], -1), with_root(codes[len(p) :], -1)
        self.implied = np.where(implied < 0, -2, implied)
        self.flags = {c: own(c) for c in ("top_level_prefix", "period_prefix", "top_level_keyword", "all_caps", "upper_letter_prefix")}

    def features(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        root = parent == ROOT
        side = lambda v: np.where(root, -1.0, np.sign(v[parent] - v[child]))
        f = self.flags
        return np.stack([
            (self.rank[parent] - self.rank[child] == 1).astype(float), (self.font[parent] == self.font[child]).astype(float),
            self.no_size[parent].astype(float), self.no_size[child].astype(float), self.bold[parent], self.bold[child],
            (self.page[child] - self.page[parent]) / self.n_pages[child], (self.page[parent] == self.page[child]).astype(float), side(self.t), side(self.l),
            np.abs(self.l[parent] - self.l[child]), np.abs(self.t[parent] - self.t[child]),
            (self.number[parent] >= 0).astype(float), (self.number[child] >= 0).astype(float), f["top_level_prefix"][child],
            (self.number[parent] == self.implied[child]).astype(float), root.astype(float),
            *[f[c][child] for c in ("period_prefix", "top_level_keyword", "all_caps", "upper_letter_prefix")],
            *[f[c][parent] for c in ("period_prefix", "top_level_keyword", "all_caps", "upper_letter_prefix")],
        ], axis=1)


def nest_together(p: pd.DataFrame, score: Scorer) -> pd.DataFrame:
    """doc_id, pos, parent, share and n_open of the sections of whole documents, which are in order."""
    p = p.reset_index(drop=True)
    pairs = _Pairs(p)
    new = np.r_[True, ~((p.doc_id.to_numpy()[1:] == p.doc_id.to_numpy()[:-1]) | (p.doc_id.isna().to_numpy()[1:] & p.doc_id.isna().to_numpy()[:-1]))]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(p)])
    spines = [[ROOT] for _ in starts]
    parent, share, n_open = np.full(len(p), ROOT), np.zeros(len(p)), np.zeros(len(p), np.int64)
    for step in range(int(sizes.max(initial=0))):
        docs = np.flatnonzero(sizes > step)
        child = starts[docs] + step
        n = np.array([len(spines[d]) for d in docs])
        candidates = np.concatenate([spines[d] for d in docs])
        scores = np.asarray(score(pairs.features(candidates, np.repeat(child, n))), float)
        first = np.cumsum(n) - n
        top, total = np.maximum.reduceat(scores, first), np.add.reduceat(scores, first)
        # The first of equals, from the root down.
        hits = np.flatnonzero(scores == np.repeat(top, n))
        picked = hits[np.searchsorted(hits, first)]
        parent[child], n_open[child] = candidates[picked], n
        share[child] = np.divide(top, total, out=np.zeros(len(top)), where=total != 0)
        for d, c, at in zip(docs.tolist(), child.tolist(), (picked - first).tolist(), strict=True):
            spines[d] = [*spines[d][: at + 1], c]
    places = np.where(parent == ROOT, ROOT, p.pos.to_numpy()[parent])
    return pd.DataFrame({"doc_id": p.doc_id, "pos": p.pos, "parent": places, "share": share, "n_open": n_open})


def nest_by_score(sections: DataFrame, score: Scorer = rule_score) -> DataFrame:
    """doc_id, pos, parent (or -1), share and n_open of every section, see :func:`section_features`.

    ``score`` takes an array with a row per candidate and the columns ``FEATURES``, and
    gives a number for each, none below zero; the largest wins, the first of equals from
    the root down. share is its part of the sum, n_open how many were open. Sections of
    equal pos come in any order; those without doc_id count as one document. Other columns are ignored.
    """
    kind = sections.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) < SECTIONS:
                continue
            p = pd.concat(held, ignore_index=True)
            last = p.doc_id.iloc[-1]
            # The last document may go on.
            open_ = p.doc_id.isna() if pd.isna(last) else (p.doc_id == last).fillna(False).astype(bool)
            if not open_.all():
                yield nest_together(p[~open_], score)
            held = [p[open_]]
        if sum(map(len, held)):
            yield nest_together(pd.concat(held, ignore_index=True), score)

    dealt = section_features(sections).repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    return dealt.mapInPandas(run, f"doc_id {kind}, pos bigint, parent bigint, share double, n_open bigint")
