"""Runs and islands in ordered layers, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, breaks: Column, by: list[str], order: list[str], name: str = "island") -> DataFrame:
    """``df`` with a number for each stretch between rows where ``breaks`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("__b").over(w)).drop("__b")


def merge_by_distance(spans: DataFrame, distance: int, by: list[str] | None = None) -> DataFrame:
    """Hulls of disjoint spans with at most ``distance`` characters between neighbours."""
    by = by or ["doc_id"]
    w = Window.partitionBy(*by).orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(w)
    found = islands(spans.withColumn("__gap", gap), F.col("__gap") > distance, by, ["start", "end"])
    merged = found.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("start")) - 1
    return merged.select(*by, rank.cast("bigint").alias("pos"), "start", "end", "n")


def label_runs(df: DataFrame, label: str, by: str, order: str) -> DataFrame:
    """Runs of equal labels: ``by``, run, label, first and last place, length."""
    w = Window.partitionBy(by).orderBy(order)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)
    found = islands(df.withColumn("__c", changed), F.col("__c"), [by], [order], "run")
    return found.groupBy(by, (F.col("run") - 1).alias("run")).agg(
        F.first(label).alias(label), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")
    )


def assemble_words(tokens: DataFrame) -> DataFrame:
    """Neighbouring tokens of one cluster as a word: doc_id, pos, start, end, text, n_tokens."""
    words = tokens.groupBy("doc_id", "cluster").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "").alias("text"),
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return words.select("doc_id", rank.cast("bigint").alias("pos"), "start", "end", "text", "n_tokens")


def punctuation_groups(tokens: DataFrame, is_punct: Column) -> DataFrame:
    """Tokens of a cluster in groups, with every punctuation token by itself."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = tokens.withColumn("__p", is_punct)
    cut = F.col("__p") | F.lag("__p").over(w) | (F.col("cluster") != F.lag("cluster").over(w))
    return islands(marked.withColumn("__c", cut), F.col("__c"), ["doc_id"], ["pos"], "group").drop("__p", "__c")


def strip_runs(tokens: DataFrame, is_punct: Column) -> DataFrame:
    """Marks the punctuation at the left and right end of clusters of several tokens; not on the left if all is."""
    whole = Window.partitionBy("doc_id", "cluster")
    left = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    right = whole.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    several = F.count("*").over(whole) > 1
    return tokens.withColumn("__p", is_punct).select(
        *tokens.columns,
        (several & F.bool_and("__p").over(left) & ~F.bool_and("__p").over(whole)).alias("left_strip"),
        (several & F.bool_and("__p").over(right)).alias("right_strip"),
    )


def row_break_hyphens(tokens: DataFrame) -> DataFrame:
    """Clusters that end in a hyphen at the end of a row, with the cluster that follows."""
    clusters = tokens.groupBy("doc_id", "cluster").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "").alias("text"),
    )
    w = Window.partitionBy("doc_id").orderBy("start")
    paired = clusters.withColumns({"next_row": F.lead("first_row").over(w), "next_text": F.lead("text").over(w)})
    return paired.where((F.col("next_row") != F.col("last_row")) & F.col("text").endswith("-") & (F.col("text") != "-"))


def renumber(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Dense places from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def to_zero_start(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.withColumn(column, F.col(column) - F.min(column).over(Window.partitionBy(*by)))


def first_run(df: DataFrame, label: str, wanted: str, by: str, order: str) -> DataFrame:
    """The first run of one label in each group."""
    runs = label_runs(df, label, by, order).where(F.col(label) == wanted)
    return runs.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("run"))).where("__r = 1").drop("__r")


def bilou_spans(labels: DataFrame, by: str | list[str], order: str, keep_first: bool = False, aggs: tuple[Column, ...] = ()) -> DataFrame:
    """Spans of words labelled B, I, L, U or O: ``by``, span, first, last, n of its words, ``aggs`` over them.

    A span opens at B or U, and at I or L behind the end of one or where there was none; it ends at L or U.
    Words labelled O neither belong to a span nor end it. ``keep_first`` says whether the first word of a
    group counts; without it that word is outside.
    """
    by = [by] if isinstance(by, str) else by
    w = Window.partitionBy(*by).orderBy(order)
    if not keep_first:
        labels = labels.withColumn("label", F.when(F.row_number().over(w) == 1, "O").otherwise(F.col("label")))
    opens = F.col("label").isin("B", "U") | F.coalesce(F.col("__before").isin("L", "U"), F.lit(True))
    seen = labels.where("label <> 'O'").withColumn("__before", F.lag("label").over(w))
    found = islands(seen.withColumn("__o", opens), F.col("__o"), by, [order], "span")
    return found.groupBy(*by, (F.col("span") - 1).alias("span")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), *aggs)


def word_label(labels: Column) -> Column:
    """The label of a word from those of its parts, an array of B, I, L, U and O in order.

    If two or more of B, L and U are among them, the first of these counts; otherwise I, if
    it is there, and else that of the first part. Null for no parts.
    """
    kinds = sum((F.array_contains(labels, x).cast("int") for x in "BLU"), F.lit(0))
    edge = F.try_element_at(F.filter(labels, lambda x: ~x.isin("I", "O")), F.lit(1))
    return F.when(kinds > 1, edge).when(F.array_contains(labels, "I"), "I").otherwise(F.try_element_at(labels, F.lit(1)))


def labels_of_words(parts: DataFrame, by: str, word: str, order: str) -> DataFrame:
    """(by, word, label) of the labelled parts of words; no more than the parts of one word are gathered."""
    listed = F.array_sort(F.collect_list(F.struct(order, "label")))
    return parts.groupBy(by, word).agg(word_label(F.transform(listed, lambda x: x["label"])).alias("label"))


def author_spans(labels: DataFrame, by: str, order: str, keep_open: bool = False) -> DataFrame:
    """Runs of START, MIDDLE and END labels from their first START on; one that is open at the end is dropped unless ``keep_open``."""
    w = Window.partitionBy(by).orderBy(order)
    inside = F.col("label").isin("START", "MIDDLE", "END")
    marked = labels.withColumns({"__in": inside, "__was": F.lag(inside).over(w), "__last": F.max(order).over(Window.partitionBy(by))})
    runs = islands(marked, ~F.col("__in").eqNullSafe(F.col("__was")), [by], [order], "span").where("__in")
    found = runs.groupBy(by, "span").agg(
        F.min(F.when(F.col("label") == "START", F.col(order))).alias("first"), F.max(order).alias("last"), F.max("__last").alias("__end")
    ).where("first is not null")
    return (found if keep_open else found.where(F.col("last") < F.col("__end"))).select(by, "first", "last")
