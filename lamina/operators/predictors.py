"""Predictors: models as functions of DataFrames, with the steps before and after them.

No weights are part of this library. A scorer is any function from feature columns to a
column; those given here are plain rules and say so in their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import boxes
from lamina.functions import text as tx
from lamina.operators import grouped, intervals, segments


class Predictor(Protocol):
    """Makes a layer of layers; ``required`` names those it reads."""

    required: tuple[str, ...]

    def predict(self, layers: dict[str, DataFrame]) -> DataFrame: ...


def run(predictor: Predictor, layers: dict[str, DataFrame]) -> DataFrame:
    missing = [f for f in predictor.required if f not in layers]
    if missing:
        raise AssertionError(f"missing layers: {missing}")
    return predictor.predict(layers)


@dataclass(frozen=True)
class Settings:
    """Thresholds and sizes of the services."""

    bib_score: float = 0.88
    service_bib_score: float = 0.6
    link_score: float = 0.8
    hyphen_score: float = -1.5


def rule_link_score(mention: Column, entry: Column) -> Column:
    """A rule in place of a trained model: shared words, the first one early, and shared numbers."""
    parts = [tx.match_source_tokens(mention, entry), tx.match_first_token(mention, entry), tx.match_numeric(mention, entry)]
    return (parts[0] * 0.5 + parts[1] * 0.3 + parts[2] * 0.2).cast("double")


def citation_links(mentions: DataFrame, entries: DataFrame, score: Callable[[Column, Column], Column] = rule_link_score,
                   threshold: float = Settings.link_score) -> DataFrame:
    """Each mention (doc_id, pos, text) with its best entry, if that scores the threshold at least; the first of equals."""
    pairs = mentions.join(entries.select("doc_id", F.col("pos").alias("entry_pos"), F.col("text").alias("entry_text")), "doc_id")
    scored = pairs.withColumn("score", score(F.col("text"), F.col("entry_text"))).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("entry_pos", "score"), F.struct(F.col("score"), -F.col("entry_pos")))
    return scored.groupBy("doc_id", "pos").agg(best.alias("b")).select("doc_id", "pos", "b.entry_pos", "b.score")


def citation_pairs(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """Mentions and entries (both: doc_id, pos, text) of a document in pairs: doc_id, pos, entry_pos, source, target, see :func:`text.citation_features_of`.

    Sides are dealt out as texts, and what features take from a text is made once for each before the pairs are. Texts are small
    beside the work on them, so the number of parts is given, for Spark would put them together by size.
    """
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = lambda df: df.where("doc_id is not null").repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "text")).alias("side"))
    both = sides(mentions).withColumnRenamed("side", "m").join(sides(entries).withColumnRenamed("side", "e"), "doc_id")
    made = lambda c, of: F.transform(c, lambda x: F.struct(x["pos"].alias("pos"), of(x["text"]).alias("of")))
    ready = both.select("doc_id", made(F.col("m"), tx.citation_source).alias("m"), made(F.col("e"), tx.citation_target).alias("e"))
    met = ready.select("doc_id", F.explode("m").alias("m"), "e").select("doc_id", "m", F.explode("e").alias("e"))
    return met.select("doc_id", F.col("m.pos").alias("pos"), F.col("e.pos").alias("entry_pos"), F.col("m.of").alias("source"), F.col("e.of").alias("target"))


def caption_costs(objects: DataFrame, captions: DataFrame, kind: str) -> DataFrame:
    """Costs of all captions of a page for its objects (both: doc_id, page, pos and a box)."""
    pairs = objects.select("doc_id", "page", F.col("pos").alias("object_pos"), *[F.col(c).alias(f"o_{c}") for c in "ltwh"]).join(
        captions.select("doc_id", "page", F.col("pos").alias("caption_pos"), *[F.col(c).alias(f"c_{c}") for c in "ltwh"]), ["doc_id", "page"]
    )
    cost = boxes.caption_distance(boxes.Box.of("o_"), boxes.Box.of("c_"), F.lit(kind))
    return pairs.select("doc_id", "page", "object_pos", "caption_pos", cost.alias("cost"))


def captions_of(objects: DataFrame, captions: DataFrame, kind: str) -> DataFrame:
    """One-to-one matches whose caption starts with the kind: doc_id, id, page, object_pos, caption_pos, cost."""
    matched = grouped.match_captions(caption_costs(objects, captions, kind))
    starts = captions.where(F.lower("text").startswith(kind.lower()[:3])).select("doc_id", F.col("pos").alias("caption_pos"))
    kept = matched.join(starts, ["doc_id", "caption_pos"])
    return segments.renumber(kept, ["doc_id"], ["page", "object_pos"], "id")


def caption_share(regions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Regions with the share of their tokens that are caption tokens, and whether that makes them captions."""
    met = intervals.box_join(tokens, regions, "box_")
    share = F.avg(F.when(F.col("is_caption"), 1.0).otherwise(0.0))
    return met.groupBy("doc_id", F.col("box_pos").alias("pos")).agg(share.alias("share")).withColumn(
        "is_caption", (F.col("share") > 0.3) & (F.col("share") < 1.0)
    )


def filter_groups(groups: DataFrame, content: str = "", types: list[str] | None = None, negate: bool = False) -> DataFrame:
    """Groups whose text without spaces starts with ``content``, of the types given, or of any other if ``negate``."""
    starts = F.lower(F.replace("text", F.lit(" "), F.lit(""))).startswith(content)
    if types is None:
        return groups.where(starts)
    inside = F.col("type").isin(types)
    return groups.where(starts & (~inside if negate else inside))


def tighten(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Boxes reduced to the tokens whose centres they hold; those that hold none are dropped."""
    met = intervals.box_join(tokens.select("doc_id", "page", "pos", "l", "t", "w", "h"), found, by_center=True)
    return met.groupBy("doc_id", "page", F.col("box_pos").alias("pos")).agg(*boxes.envelope_aggs())


def classify_groups(contexts: DataFrame, groups: DataFrame, predictions: DataFrame) -> DataFrame:
    """Groups within contexts with the label and score predicted for them, or null."""
    met = intervals.interval_join(contexts.select("doc_id", "pos", "start", "end"), groups.select("doc_id", "pos", "start", "end"), ["doc_id"], "group_")
    return met.select("doc_id", F.col("pos").alias("context_pos"), "group_pos").join(
        predictions.select("doc_id", "context_pos", "group_pos", "label", "score"), ["doc_id", "context_pos", "group_pos"], "left"
    )


def label_tokens(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs of equal labels over tokens as spans with a type: doc_id, pos, start, end, type."""
    labelled = tokens.join(labels.select("doc_id", "pos", "label"), ["doc_id", "pos"])
    runs = segments.label_runs(labelled, "label", "doc_id", "pos")
    ends = tokens.select("doc_id", F.col("pos").alias("last"), "end")
    starts = tokens.select("doc_id", F.col("pos").alias("first"), "start")
    return runs.join(starts, ["doc_id", "first"]).join(ends, ["doc_id", "last"]).select(
        "doc_id", F.col("run").alias("pos"), "start", "end", F.col("label").alias("type")
    )


def page_dictionary(tokens: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """What a token classifier reads of a page: words, boxes, line and block ids (-1 where a token is in no block)."""
    in_row = intervals.interval_join(tokens, rows.select("doc_id", "pos", "start", "end", "page"), ["doc_id"], "row_")
    block = intervals.interval_join(tokens.select("doc_id", "pos", "start", "end"), groups.select("doc_id", "pos", "start", "end"), ["doc_id"], "block_")
    block = block.groupBy("doc_id", "pos").agg(F.min("block_pos").alias("block"))
    joined = in_row.join(block, ["doc_id", "pos"], "left")
    item = F.struct("pos", "text", F.col("row_pos").alias("line"), F.coalesce("block", F.lit(-1)).alias("block"))
    listed = joined.groupBy("doc_id", F.col("row_page").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("i"))
    return listed.select(
        "doc_id", "page", F.col("i.text").alias("words"), F.col("i.line").alias("line_ids"), F.col("i.block").alias("block_ids")
    )


def map_ranges(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Character ranges in the joined text of an entry as spans of the document.

    ``entries``: doc_id, entry, span_pos, start, end; the text joins its spans with one
    space. ``ranges``: doc_id, entry, field, from, to. A range over several spans gives one
    part in each.
    """
    w = Window.partitionBy("doc_id", "entry").orderBy("span_pos")
    size = F.col("end") - F.col("start")
    at = F.sum(size + 1).over(w) - size - 1
    placed = entries.withColumn("at", at)
    met = placed.join(ranges, ["doc_id", "entry"]).where((F.col("from") < F.col("at") + size) & (F.col("to") > F.col("at")))
    return met.select(
        "doc_id", "entry", "field", "span_pos", (F.col("start") + F.greatest(F.col("from") - F.col("at"), F.lit(0))).alias("start"),
        (F.col("start") + F.least(F.col("to") - F.col("at"), size)).alias("end"),
    )


def heading_pairs(sections: DataFrame, n_pages: Column) -> DataFrame:
    """Features of every two sections of a document (doc_id, pos, text, page, font, size, box), parent first."""
    parent = sections.select("doc_id", *[F.col(c).alias(f"p_{c}") for c in sections.columns if c != "doc_id"])
    pairs = parent.join(sections, "doc_id").where("p_pos < pos")
    sign = lambda a, b: F.when(F.col(a) < F.col(b), -1).when(F.col(b) < F.col(a), 1).otherwise(0)
    features = {f"child_{k}": v for k, v in tx.heading_features(F.col("text")).items()}
    features |= {f"parent_{k}": v for k, v in tx.heading_features(F.col("p_text")).items()}
    return pairs.select(
        "doc_id", "p_pos", "pos", (F.col("p_font") == F.col("font")).alias("same_font"),
        F.contains(F.lower("p_font"), F.lit("bold")).alias("parent_bold"), F.contains(F.lower("font"), F.lit("bold")).alias("child_bold"),
        ((F.col("page") - F.col("p_page")) / n_pages).alias("page_distance"), (F.col("page") == F.col("p_page")).alias("same_page"),
        sign("p_l", "l").alias("relative_x"), sign("p_t", "t").alias("relative_y"), F.abs(F.col("p_l") - F.col("l")).alias("x_distance"),
        F.abs(F.col("p_t") - F.col("t")).alias("y_distance"), *[v.alias(k) for k, v in features.items()],
    ).withColumn("prefix_names_parent", F.col("parent_prefix").eqNullSafe(F.col("child_implied_parent")) & F.col("parent_prefix").isNotNull())


# The names of types in order, as models number them from 0.
DOCBANK = ("paragraph", "title", "equation", "reference", "section", "list", "table", "caption", "author", "abstract", "footer", "date", "figure")
GROTOAP2 = (
    "BIB_INFO", "REFERENCES", "UNKNOWN", "BODY_CONTENT", "PAGE_NUMBER", "TABLE", "ACKNOWLEDGMENT", "FIGURE", "CONFLICT_STATEMENT", "AFFILIATION",
    "DATES", "TYPE", "title", "AUTHOR", "abstract", "CORRESPONDENCE", "EDITOR", "COPYRIGHT", "AUTHOR_TITLE", "KEYWORDS", "GLOSSARY", "EQUATION",
)


def entities(groups: DataFrame, names: tuple[str, ...], wanted: list[str]) -> DataFrame:
    """The groups whose ``type``, a place in ``names``, is one of those wanted, with its ``name``."""
    unknown = [x for x in wanted if x not in names]
    if unknown:
        raise KeyError(f"no such types: {unknown}")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("type") + 1).cast("int"))
    return groups.where(F.col("type").isin([names.index(x) for x in wanted])).withColumn("name", name)
