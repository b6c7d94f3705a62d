"""Layers derived from document texts.

A layer is a table with a row per annotation: doc_id, pos (its place in the layer, from
0), start, end and whatever else it knows. All layers of a document are made in the
partition that holds the document: :func:`spread` deals the texts out by doc_id once, and
windows and joins on doc_id need no other shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROWS_PER_PAGE = 40


def _by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("n")


def spread(docs: DataFrame) -> DataFrame:
    """(doc_id, symbols), dealt out by doc_id."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("symbols")).repartition("doc_id")


def _parts(docs: DataFrame, parts: Column, gap: int) -> DataFrame:
    """The elements of an array with their places in the text; ``gap`` characters stand between two."""
    exploded = docs.select("doc_id", F.posexplode(parts).alias("n", "text"))
    before = F.sum(F.length("text") + gap).over(_by_doc()) - F.length("text") - gap
    return exploded.withColumn("start", before).withColumn("end", before + F.length("text"))


def tokens(docs: DataFrame) -> DataFrame:
    """Maximal runs of non-space characters: doc_id, pos, start, end, text."""
    parts = _parts(docs, F.regexp_extract_all("symbols", F.lit(r"(\S+|\s+)"), F.lit(1)), 0)
    words = parts.where(~F.col("text").rlike(r"^\s"))
    return words.select("doc_id", (F.row_number().over(_by_doc()) - 1).cast("bigint").alias("pos"), "start", "end", "text")


def split_tokens(docs: DataFrame) -> DataFrame:
    """Runs of letters and digits, and every other non-space character by itself, with the cluster they stand in."""
    parts = _parts(docs, F.regexp_extract_all("symbols", F.lit(r"(\w+|[^\w\s]|\s+)"), F.lit(1)), 0)
    space = F.col("text").rlike(r"^\s")
    marked = parts.withColumn("cluster", F.sum(F.when(space, 1).otherwise(0)).over(_by_doc())).where(~space)
    return marked.select(
        "doc_id", (F.row_number().over(_by_doc()) - 1).cast("bigint").alias("pos"), "start", "end", "text", "cluster"
    )


def rows(docs: DataFrame) -> DataFrame:
    """Lines: doc_id, pos, start, end, text, page, where a page has forty lines."""
    lines = _parts(docs, F.split("symbols", "\n"), 1)
    return lines.select(
        "doc_id", F.col("n").cast("bigint").alias("pos"), "start", "end", "text",
        F.floor(F.col("n") / ROWS_PER_PAGE).alias("page"),
    )


def pages(lines: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, n_rows of each page."""
    return lines.groupBy("doc_id", F.col("page").alias("pos")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_rows")
    )


def sentences(docs: DataFrame) -> DataFrame:
    """Stretches that end at ``.``, ``!`` or ``?`` before white space, or with the text."""
    parts = _parts(docs, F.regexp_extract_all("symbols", F.lit(r"(?s)(.+?(?:[.!?](?=\s)|$(?!\n)))"), F.lit(1)), 0)
    return _trimmed(parts)


def _trimmed(parts: DataFrame) -> DataFrame:
    """Without white space at both ends, and without parts that are nothing else."""
    bare = parts.withColumn("lead", F.length("text") - F.length(F.regexp_replace("text", r"^\s+", "")))
    bare = bare.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    start = F.col("start") + F.col("lead")
    return bare.select(
        "doc_id", (F.row_number().over(_by_doc()) - 1).cast("bigint").alias("pos"), start.alias("start"),
        (start + F.length("text")).alias("end"), "text",
    )


def token_boxes(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Tokens with row, page and a box: a hundred characters to a row, forty rows to a page."""
    from lamina.operators.intervals import interval_join

    met = interval_join(words, lines.select("doc_id", "pos", "start", "end", "page"), ["doc_id"], suffix="row_")
    return met.select(
        "doc_id", "pos", "start", "end", "text", F.col("row_pos"), F.col("row_page").alias("page"),
        ((F.col("start") - F.col("row_start")) / 100).alias("l"), (F.col("row_pos") % ROWS_PER_PAGE / ROWS_PER_PAGE).alias("t"),
        ((F.col("end") - F.col("start")) / 100).alias("w"), F.lit(1 / ROWS_PER_PAGE).alias("h"),
    )


def blocks(lines: DataFrame, height: int = 5) -> DataFrame:
    """Rectangles over ``height`` rows of a page: doc_id, pos, page, l, t, w, h."""
    group = F.floor(F.col("pos") / height)
    return lines.groupBy("doc_id", group.alias("pos"), "page").agg(
        (F.min(F.col("pos") % ROWS_PER_PAGE) / ROWS_PER_PAGE).alias("t"),
        (F.count("*") / ROWS_PER_PAGE).alias("h"), (F.max(F.length("text")) / 100).alias("w"),
    ).select("doc_id", "pos", "page", F.lit(0.0).alias("l"), "t", "w", "h")


# Layer definition: one table of annotations with a ``field`` column.

RESERVED = ("symbols", "images", "metadata")
SPANS = "array<struct<start:bigint,end:bigint>>"


def as_annotations(layer: DataFrame, field: str) -> DataFrame:
    """A layer of single spans in the form that all layers share: doc_id, field, pos, id, text, spans."""
    if field in RESERVED or not field.isidentifier():
        raise ValueError(f"not a name for a layer: {field}")
    text = F.col("text") if "text" in layer.columns else F.lit(None).cast("string")
    return layer.select(
        "doc_id", F.lit(field).alias("field"), "pos", F.col("pos").alias("id"), text.alias("text"),
        F.array(F.struct("start", "end")).cast(SPANS).alias("spans"),
    )


def fields(annotations: DataFrame) -> list[str]:
    """Names of the layers, each once."""
    return sorted(r[0] for r in annotations.select("field").distinct().collect())


def annotate(annotations: DataFrame, layer: DataFrame, field: str, overwrite: bool = False) -> DataFrame:
    """``annotations`` with one more layer; an existing one is replaced only if ``overwrite`` says so."""
    if field in fields(annotations):
        if not overwrite:
            raise AssertionError(f"the layer {field} is there already")
        annotations = remove(annotations, field)
    return annotations.unionByName(as_annotations(layer, field))


def remove(annotations: DataFrame, field: str) -> DataFrame:
    return annotations.where(F.col("field") != field)


def layer(annotations: DataFrame, field: str) -> DataFrame:
    """The annotations of one layer with their extent, in the form that joins take."""
    return annotations.where(F.col("field") == field).select(
        "doc_id", "pos", F.array_min("spans.start").alias("start"), F.array_max("spans.end").alias("end"), "text", "spans"
    )


def require_fields(annotations: DataFrame, wanted: list[str]) -> DataFrame:
    """``annotations``, which fail to compute where a document lacks one of the layers."""
    have = annotations.groupBy("doc_id").agg(F.collect_set("field").alias("have"))
    missing = F.array_except(F.array(*[F.lit(w) for w in wanted]), "have")
    checked = have.select(
        "doc_id",
        F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing layers: "), F.array_join(missing, ", ")))).alias("__ok"),
    )
    return annotations.join(checked, "doc_id").where("__ok is null").drop("__ok")


def order(annotations: DataFrame) -> Column:
    """Order within a layer: by id where every id is at least 1, else by start; ties by place."""
    whole = Window.partitionBy("doc_id", "field")
    by_id = F.min(F.coalesce("id", F.lit(0))).over(whole) >= 1
    return F.struct(F.when(by_id, F.col("id")).otherwise(F.array_min("spans.start")), F.col("pos"))
