"""Line-by-line XML of a glyph scraper: pages, rows, words and characters with boxes from the bottom left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import boxes


def page_metrics(lines: DataFrame) -> DataFrame:
    """doc_id, page, width, height, n_rows, n_tokens from lines (doc_id, n, line) of the metrics part."""
    w = Window.partitionBy("doc_id").orderBy("n")
    numbered = lines.withColumn("k", F.sum(F.when(F.col("line") == "<page>", 1).otherwise(0)).over(w)).where("k > 0")
    value = lambda tag: F.max(F.when(F.col("line").startswith(f"<{tag}>"), F.regexp_extract("line", f"<{tag}>(.*)</{tag}>", 1)))
    return numbered.groupBy("doc_id", "k").agg(
        value("no").cast("int").alias("page"), value("pagewidth").cast("double").alias("width"),
        value("pageheight").cast("double").alias("height"), value("lines").cast("int").alias("n_rows"),
        value("words").cast("int").alias("n_tokens"),
    ).drop("k")


def tag_ranges(lines: DataFrame, start: str, end: str) -> DataFrame:
    """First and last line of every part between two tags that do not nest: doc_id, part, first, last."""
    w = Window.partitionBy("doc_id").orderBy("n")
    opens = F.when(F.col("line").startswith(start), 1).otherwise(0)
    closed = lines.withColumn("part", F.sum(opens).over(w)).where("part > 0")
    last = F.min(F.when(F.col("line").startswith(end), F.col("n")))
    return closed.groupBy("doc_id", "part").agg(F.min("n").alias("first"), last.alias("last")).where("last is not null")


def tokens(lines: DataFrame, metrics: DataFrame) -> DataFrame:
    """doc_id, page, row_id, word_id, text and box of each word; characters without a box are left out."""
    w = Window.partitionBy("doc_id").orderBy("n")
    carried = lambda tag: F.last(F.when(F.col("line").startswith(f"<{tag} "), F.regexp_extract("line", 'id="(\\d+)"', 1)), ignorenulls=True).over(w)
    at = lines.select(
        "doc_id", "n", "line", carried("Page").cast("int").alias("page"), carried("Line").cast("int").alias("row_id"),
        carried("Word").cast("int").alias("word_id"),
    ).where(F.col("line").startswith("<Char ") & F.col("line").endswith("</Char>"))
    numbers = F.split(F.regexp_extract("line", 'BBOX="\\(([^)]*)\\)"', 1), ",\\s*")
    x, y, wd, h = (F.try_element_at(numbers, F.lit(i)).try_cast("double") for i in (1, 2, 3, 4))
    placed = at.select("*", x.alias("x"), y.alias("y"), wd.alias("bw"), h.alias("bh"), F.regexp_extract("line", ">([^<]*)</Char>$", 1).alias("char"))
    boxed = placed.join(metrics, ["doc_id", "page"]).withColumn(
        "b", boxes.flip(F.col("x"), F.col("y"), F.col("bw"), F.col("bh"), F.col("width"), F.col("height"))
    ).where("b is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "char"))), lambda c: c["char"]), "")
    made = boxed.select("doc_id", "page", "row_id", "word_id", "n", "char", "b.*").groupBy("doc_id", "page", "row_id", "word_id").agg(
        text.alias("text"), *boxes.envelope_aggs()
    )
    return made.where("text <> ''")
