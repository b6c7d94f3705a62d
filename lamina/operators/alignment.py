"""Alignment of tokens, sub-words, sentences and boxes; checks of tokenisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import boxes, spans
from lamina.operators import intervals, segments


def _offsets(tokens: DataFrame) -> DataFrame:
    """Tokens (doc_id, pos, text) with their place in the text that joins them without anything between."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.sum(F.length("text")).over(w) - F.length("text")
    return tokens.select("doc_id", "pos", before.alias("start"), (before + F.length("text")).alias("end"), "text")


def align(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Each fine token with the coarse one that holds it: doc_id, pos, coarse_pos.

    Both must have the same characters; a document in which they differ raises an error.
    """
    joined = lambda t: t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    whole = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    both = joined(fine).join(joined(coarse).withColumnRenamed("t", "c"), "doc_id")
    checked = both.select("doc_id", F.when(whole("t") != whole("c"), F.raise_error(F.lit("fine and coarse tokens differ"))).alias("__bad"))
    met = intervals.contained_join(_offsets(fine), _offsets(coarse), ["doc_id"], "coarse_")
    return met.join(checked, "doc_id").where("__bad is null").select("doc_id", "pos", "coarse_pos")


def find_in_text(docs: DataFrame, tokens: DataFrame, offset: int = 0) -> DataFrame:
    """Places of given tokens (doc_id, pos, text) in a text, each behind the one before; tokens must be its white-space runs."""
    from lamina.operators import layers

    placed = layers.tokens(docs).select("doc_id", "pos", "text", (F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"))
    return tokens.join(placed, ["doc_id", "pos", "text"])


def dense_ids(tokens: DataFrame, local: str, name: str) -> DataFrame:
    """Ids that count on through the pages of a document, from ids that start again on each."""
    return tokens.withColumn(name, (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", local)) - 1).cast("bigint"))


def word_labels(labels: DataFrame, misc: int = 0) -> DataFrame:
    """Labels of words from those of sub-words (entry, pos, word_id, label): the first one counts.

    Words that have no sub-word between others that have get ``misc``.
    """
    w = Window.partitionBy("entry").orderBy("pos")
    seen = labels.where("word_id is not null").withColumn("was", F.lag("word_id").over(w))
    first = seen.where("was is null or was <> word_id").withColumn("gap", F.lag("word_id").over(w))
    skipped = first.where("gap is not null and word_id - gap > 1").select(
        "entry", F.explode(F.sequence(F.col("gap") + 1, F.col("word_id") - 1)).alias("word_id"), F.lit(misc).alias("label")
    )
    return first.select("entry", "word_id", "label").unionByName(skipped)


def first_subword_mask(labels: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("entry", "word_id").orderBy("pos"))
    return labels.withColumn("is_first", (order == 1) & F.col("word_id").isNotNull())


def repeat_labels(lines: DataFrame) -> DataFrame:
    """A label for each word from labels of lines (doc_id, pos, label, n_words)."""
    spread = lines.where("n_words > 0").select("doc_id", "pos", F.posexplode(F.array_repeat("label", F.col("n_words").cast("int"))).alias("k", "label"))
    return segments.renumber(spread, ["doc_id"], ["pos", "k"], "word_pos").select("doc_id", "word_pos", "label")


def sentence_tokens(sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    """First and last token, and their number, of each sentence."""
    met = intervals.interval_join(sentences.select("doc_id", "pos", "start", "end"), tokens.select("doc_id", "pos", "start", "end"), ["doc_id"], "token_")
    return met.groupBy("doc_id", "pos").agg(
        F.min("token_pos").alias("first"), F.max("token_pos").alias("last"), F.count("*").alias("n_tokens"),
        F.min("token_start").alias("start"), F.max("token_end").alias("end"),
    )


def merge_mention_boxes(parts: DataFrame, rows: DataFrame, slack: int = 5) -> DataFrame:
    """Boxes of a mention's spans (doc_id, mention, start, end, page, box), one for neighbours on one row."""
    on_row = intervals.asof_join(parts, rows)
    w = Window.partitionBy("doc_id", "mention").orderBy("start")
    close = spans.close_to_next(F.lag("end").over(w), F.col("start"), slack) & (F.lag("row_pos").over(w) == F.col("row_pos"))
    found = segments.islands(on_row.withColumn("__c", ~close), F.col("__c"), ["doc_id", "mention"], ["start"])
    return found.groupBy("doc_id", "mention", "island").agg(
        F.min_by("page", "start").alias("page"), F.min("start").alias("start"), F.max("end").alias("end"), *boxes.envelope_aggs()
    ).drop("island")


def outline_boxes(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """Where outline items (doc_id, pos, page, title, level, l, t) point: a thin box on the first token below.

    Items without a token below and to the right are left out.
    """
    wide = F.when(F.col("l") > 0, 0.25).otherwise(1.0)
    target = items.select("doc_id", F.col("pos").alias("item_pos"), "page", "title", "level", F.col("l").alias("item_l"), F.col("t").alias("item_t"), wide.alias("item_w"))
    met = target.join(tokens.select("doc_id", "page", "l", "t"), ["doc_id", "page"]).where(
        (F.col("t") + 0.01 > F.col("item_t")) & (F.col("l") + 0.01 > F.col("item_l")) & (F.col("l") < F.col("item_l") + F.col("item_w"))
    )
    return met.groupBy("doc_id", "item_pos", "page", "title", "level", "item_l", "item_w").agg(F.min("t").alias("top")).select(
        "doc_id", F.col("item_pos").alias("pos"), "page", "title", "level", F.col("item_l").alias("l"),
        (F.col("top") - 0.005).alias("t"), F.col("item_w").alias("w"), F.lit(0.01).alias("h"),
    )


def section_headers(items: DataFrame, tokens: DataFrame, gap_x: float = 0.03, gap_y: float = 0.01) -> DataFrame:
    """Tokens connected with the box of each outline item, the better of two choices by the item's title.

    One choice has all connected tokens not above the box; the other, for boxes off the
    left edge, only those that do not start left of it. Gives doc_id, pos, level, title,
    text, start, end and distance. The closure is computed for one item at a time.
    """
    import pandas as pd

    from lamina.functions import text as tx

    target = outline_boxes(items, tokens)
    near = target.select("doc_id", "page", F.col("pos").alias("item"), "title", "level", *[F.col(c).alias(f"b_{c}") for c in "ltwh"]).join(
        tokens.select("doc_id", "page", "start", "end", "text", "l", "t", "w", "h"), ["doc_id", "page"]
    ).where("t + 0.005 > b_t and t + h < b_t + 0.25")

    def connected(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        reached = [(first.b_l, first.b_t, first.b_w, first.b_h)]
        left = list(pdf.itertuples())
        found = []
        while reached:
            x, y, w, h = reached.pop()
            hit = [r for r in left if max(x, r.l) - min(x + w, r.l + r.w) <= gap_x and max(y, r.t) - min(y + h, r.t + r.h) <= gap_y]
            taken = {id(r) for r in hit}
            left = [r for r in left if id(r) not in taken]
            found += hit
            reached += [(r.l, r.t, r.w, r.h) for r in hit]
        below = sorted((r for r in found if r.t >= first.b_t), key=lambda r: r.start)
        choices = [below] + ([[r for r in below if r.l + 0.01 > first.b_l]] if first.b_l > 0 else [])
        rows = [(first.doc_id, first["item"], first.level, first.title, k, " ".join(r.text for r in c), c[0].start, c[-1].end) for k, c in enumerate(choices) if c]
        return pd.DataFrame(rows, columns=["doc_id", "pos", "level", "title", "choice", "text", "start", "end"])

    schema = "doc_id long, pos long, level long, title string, choice long, text string, start long, end long"
    choices = near.groupBy("doc_id", "item").applyInPandas(connected, schema)
    distance = tx.levenshtein(F.col("text"), F.col("title"), case_sensitive=False, strip_spaces=True, normalize=True)
    best = F.min_by(F.struct("level", "title", "text", "start", "end", "distance"), F.struct("distance", "choice"))
    return choices.withColumn("distance", distance).groupBy("doc_id", "pos").agg(best.alias("b")).select("doc_id", "pos", "b.*")


def check_hyphen_tokens(tokens: DataFrame) -> DataFrame:
    """``tokens``, which fail to compute if one holds a hyphen beside other letters, is blank or has no place."""
    text, where = F.col("text"), F.lit("a hyphen must be a token of its own")
    bad = (
        F.when(F.contains(text, F.lit("-")) & (text != "-"), F.raise_error(where))
        .when(F.trim(text) == "", F.raise_error(F.lit("blank token")))
        .when(F.col("pos").isNull(), F.raise_error(F.lit("token without a place")))
    )
    return tokens.withColumn("__bad", bad.cast("string")).where("__bad is null").drop("__bad")


def check_contiguous(words: DataFrame) -> DataFrame:
    """Words of tokens (doc_id, word, pos) whose tokens are not neighbours."""
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")).where("n <> last - first + 1")


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """Without blank tokens, numbered again."""
    return segments.renumber(tokens.where(F.trim("text") != ""), ["doc_id"], ["pos"])


def with_both(groups: DataFrame) -> DataFrame:
    return groups.where((F.size("spans") > 0) & (F.size("boxes") > 0))


def concat_fields(*columns: Column, separator: str = "\n") -> Column:
    """Title, abstract and the like in one string; nulls leave no separator."""
    return F.concat_ws(separator, *columns)
