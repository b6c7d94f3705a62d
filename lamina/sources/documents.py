"""Layered documents as JSON, CSV, JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys of a document that are no layers.
RESERVED = ("symbols", "metadata", "images")
BOX = "struct<left:double,top:double,width:double,height:double,page:int>"
SPAN_GROUP = (
    f"array<struct<spans:array<struct<start:int,end:int,box:{BOX}>>,id:int,metadata:map<string,string>,"
    f"box_group:struct<boxes:array<{BOX}>,id:int,metadata:map<string,string>,type:string>,type:string,text:string>>"
)


def parse(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Documents of one JSON string each: doc_id, symbols, metadata, layers (name to JSON)."""
    fields = F.from_json(F.col(json_col), "map<string,string>")
    return raw.select(
        "doc_id", F.try_element_at(fields, F.lit("symbols")).alias("symbols"),
        F.from_json(F.try_element_at(fields, F.lit("metadata")), "map<string,string>").alias("metadata"),
        F.map_filter(fields, lambda k, v: ~k.isin(*RESERVED)).alias("layers"),
    )


def annotations(documents: DataFrame) -> DataFrame:
    """doc_id, field, pos, id, type, text, spans, boxes of all layers.

    Where a group has no metadata, ``type`` and ``text`` come from where older documents
    keep them, the group itself.
    """
    layers = documents.select("doc_id", F.explode("layers").alias("field", "json"))
    groups = layers.select("doc_id", "field", F.posexplode(F.from_json("json", SPAN_GROUP)).alias("pos", "g"))
    meta = lambda key, old: F.when(F.col("g.metadata").isNull(), old).otherwise(F.try_element_at("g.metadata", F.lit(key)))
    return groups.select(
        "doc_id", "field", F.col("pos").cast("bigint").alias("pos"), F.col("g.id").alias("id"),
        meta("type", F.col("g.type")).alias("type"), meta("text", F.col("g.text")).alias("text"),
        F.coalesce("g.spans", F.array().cast("array<struct<start:int,end:int,box:struct<left:double,top:double,width:double,height:double,page:int>>>")).alias("spans"),
        F.col("g.box_group.boxes").alias("boxes"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder with one JSON file each; doc_id is a hash of the path."""
    files = spark.read.text(path, wholetext=True)
    return parse(files.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("json")))


def span_group_json(annotations_: DataFrame) -> Column:
    """One annotation as JSON; null members are left out, and an id of 0 in a box group too."""
    boxes = F.when(F.size("boxes") > 0, F.struct("boxes", F.nullif("id", F.lit(0)).alias("id")))
    metadata = F.when(F.coalesce("type", "text").isNotNull(), F.struct("type", "text"))
    return F.to_json(F.struct("spans", "id", metadata.alias("metadata"), boxes.alias("box_group")))


def to_json(documents: DataFrame, annotations_: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """doc_id, json of documents with the layers asked for, or all."""
    chosen = annotations_ if fields is None else annotations_.where(F.col("field").isin(fields))
    items = chosen.select("doc_id", "field", "pos", span_group_json(chosen).alias("item"))
    listed = items.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("g"))
    member = F.concat(F.to_json(F.array("field")).substr(F.lit(2), F.length("field") + 2), F.lit(":["), F.array_join(F.transform("g", lambda x: x["item"]), ","), F.lit("]"))
    layers = listed.select("doc_id", "field", member.alias("member")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("field", "member"))).alias("m")
    )
    head = F.to_json(F.struct("symbols"))
    rest = F.array_join(F.transform("m", lambda x: x["member"]), ",")
    whole = F.when(F.col("m").isNull(), head).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), rest, F.lit("}")))
    return documents.join(layers, "doc_id", "left").select("doc_id", whole.alias("json"))


def write_layers(annotations_: DataFrame, path: str) -> None:
    """Parquet with a folder per layer, so that a reader of one layer reads no other."""
    annotations_.write.partitionBy("field").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.option("header", True).csv(path)


def write_page_lines(items: DataFrame, path: str) -> None:
    """One JSON line for each page and prediction, with sorted keys."""
    items.select(*sorted(items.columns)).write.json(path)


def images(files: DataFrame) -> DataFrame:
    """Page images (doc_id, page, content) as base64 in one line, where Spark breaks lines after 76 letters."""
    return files.select("doc_id", "page", F.replace(F.base64("content"), F.lit("\r\n"), F.lit("")).alias("content"))


def from_base64(images_: DataFrame) -> DataFrame:
    return images_.select("doc_id", "page", F.unbase64("content").alias("content"))


def normalise_outline(items: DataFrame) -> DataFrame:
    """Outline items (doc_id, pos, title, level): a single item at the top is dropped and the rest rise by one."""
    whole = Window.partitionBy("doc_id")
    single = F.count_if(F.col("level") == 0).over(whole) == 1
    marked = items.withColumn("__single", single)
    return marked.where(~(F.col("__single") & (F.col("level") == 0))).select(
        "doc_id", "pos", "title", F.when(F.col("__single"), F.col("level") - 1).otherwise(F.col("level")).alias("level")
    )


def outline_target(kind: Column, page_height: Column, values: Column) -> Column:
    """Top of an outline destination in parts of the page: FitR keeps it at place 5, XYZ at place 3."""
    top = F.when(kind == "FitR", F.try_element_at(values, F.lit(6))).otherwise(F.try_element_at(values, F.lit(4)))
    return (page_height - top) / page_height


def resolve_outline(items: DataFrame, pages: DataFrame, raise_errors: bool = False) -> tuple[DataFrame, DataFrame]:
    """Places of outline items, and (doc_id, error) of documents whose outline can't be used.

    ``items`` has doc_id, pos, title, level, page_id, kind, left, top; ``pages`` doc_id,
    page_id, page, width, height. Items without a page_id lead nowhere and are left out. The
    first item of a document that can't be resolved voids its outline, and so does having none
    that leads anywhere. ``raise_errors`` makes reading either result fail at such a document.
    """
    joined = items.join(pages, ["doc_id", "page_id"], "left")
    problem = (
        F.when(F.col("page_id").isNull(), None).when(F.col("page").isNull(), "page missing")
        .when((F.col("kind") == "XYZ") & (F.col("left").isNull() | F.col("top").isNull()), "destination location missing")
        .when(~F.coalesce(F.col("kind").isin("XYZ", "FitR"), F.lit(False)), "unsupported destination")
    )
    first = F.min(F.when(problem.isNotNull(), F.struct("pos", problem.alias("problem"))))["problem"]
    none = F.when(F.count("page_id") == 0, "no usable destinations")
    state = joined.groupBy("doc_id").agg(F.coalesce(first, none).alias("error"))
    if raise_errors:
        told = F.raise_error(F.concat(F.lit("outline of document "), F.col("doc_id"), F.lit(": "), F.col("error")))
        state = state.withColumn("error", F.when(F.col("error").isNotNull(), told.cast("string")))
    usable = joined.where("page_id is not null").join(state.where("error is null").select("doc_id"), "doc_id")
    placed = usable.select(
        "doc_id", "pos", "title", "level", "page", (F.col("left") / F.col("width")).alias("l"),
        ((F.col("height") - F.col("top")) / F.col("height")).alias("t"),
    )
    return placed, state.where("error is not null")


def ocr_blocks(ocr: DataFrame) -> DataFrame:
    """Blocks of OCR rows (doc_id, page, block_num, left, top, width, height, text, page_width, page_height).

    Blank texts and boxes that cover the page are left out; boxes are in parts of the page.
    """
    kept = ocr.where((F.trim("text") != "") & ((F.col("width") < F.col("page_width")) | (F.col("height") < F.col("page_height"))))
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return kept.groupBy("doc_id", "page", "block_num", "page_width", "page_height").agg(
        F.min("left").alias("x"), F.min("top").alias("y"), right.alias("x2"), bottom.alias("y2")
    ).select(
        "doc_id", "page", F.col("block_num").alias("id"), (F.col("x") / F.col("page_width")).alias("l"),
        (F.col("y") / F.col("page_height")).alias("t"), ((F.col("x2") - F.col("x")) / F.col("page_width")).alias("w"),
        ((F.col("y2") - F.col("y")) / F.col("page_height")).alias("h"),
    )


def nested_to_layers(tokens: DataFrame) -> DataFrame:
    """Text and offsets of extracted tokens (doc_id, pos, text, word_id, row_id, page_id).

    Nothing stands between tokens of one word, a space between words of a row, a newline
    between rows. Gives doc_id, pos, text, word_id, row_id, page_id, start, end, joiner.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    same_row = F.lead("row_id").over(w) == F.col("row_id")
    joiner = (
        F.when(F.lead("pos").over(w).isNull(), "")
        .when(same_row & (F.lead("word_id").over(w) == F.col("word_id")), "")
        .when(same_row, " ").otherwise("\n")
    )
    joined = tokens.withColumn("joiner", joiner)
    before = F.sum(F.length("text") + F.length("joiner")).over(w) - F.length("text") - F.length("joiner")
    return joined.withColumn("start", before).withColumn("end", before + F.length("text"))


def symbols_of(tokens: DataFrame) -> DataFrame:
    """doc_id, symbols of the tokens of :func:`nested_to_layers`."""
    listed = F.array_sort(F.collect_list(F.struct("pos", F.concat("text", "joiner").alias("s"))))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda t: t["s"]), "").alias("symbols"))


def font_of_words(chars: DataFrame) -> DataFrame:
    """Each word (doc_id, word_id) with the font of its first character."""
    first = lambda c: F.min_by(c, "pos").alias(c)
    return chars.groupBy("doc_id", "word_id").agg(first("fontname"), first("size"))
