"""TEI documents of a header or full-text extractor, one XML string per row, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import grouped


def header(tei: DataFrame, column: str = "tei") -> DataFrame:
    """doc_id, title, abstract, symbols: the first title of the header, and the paragraphs of the abstract by line."""
    title = F.nullif(F.trim(F.try_element_at(F.xpath(F.col(column), F.lit("//titleStmt/title/text()")), F.lit(1))), F.lit(""))
    paragraphs = F.filter(F.transform(F.xpath(F.col(column), F.lit("//profileDesc/abstract//text()")), lambda p: F.trim(p)), lambda p: p != "")
    abstract = F.nullif(F.array_join(paragraphs, "\n"), F.lit(""))
    return tei.select("doc_id", title.alias("title"), abstract.alias("abstract")).withColumn(
        "symbols", F.concat_ws("\n", "title", "abstract")
    )


def citation_title(tei: DataFrame, column: str = "tei") -> DataFrame:
    """doc_id, title: of the first title anywhere, the text before its first element, trimmed; null if there is none."""
    first = F.xpath_string(F.col(column), F.lit("(//title)[1]/node()[1][self::text()]"))
    return tei.select("doc_id", F.btrim(F.nullif(first, F.lit("")), F.lit(" \t\n\r")).alias("title"))


def page_sizes(tei: DataFrame, column: str = "tei") -> DataFrame:
    """doc_id, page (from 0), width, height."""
    number = F.xpath(F.col(column), F.lit("//facsimile/surface/@n"))
    width, height = (F.xpath(F.col(column), F.lit(f"//facsimile/surface/@{a}")) for a in ("lrx", "lry"))
    rows = tei.select("doc_id", F.explode(F.arrays_zip(number.alias("n"), width.alias("w"), height.alias("h"))).alias("s"))
    return rows.select(
        "doc_id", (F.col("s.n").cast("int") - 1).alias("page"), F.col("s.w").cast("double").alias("width"), F.col("s.h").cast("double").alias("height")
    )


def coordinates(coords: Column) -> Column:
    """``page,x,y,w,h;...`` as boxes on pages from 0; parts that are not five numbers are left out."""
    parts = F.transform(F.split(coords, ";"), lambda p: F.transform(F.split(p, ","), lambda v: v.try_cast("double")))
    good = F.filter(parts, lambda p: (F.size(p) == 5) & F.forall(p, lambda v: v.isNotNull()))
    return F.transform(
        good, lambda p: F.struct((p[0].cast("int") - 1).alias("page"), p[1].alias("l"), p[2].alias("t"), p[3].alias("w"), p[4].alias("h"))
    )


def box_groups(tei: DataFrame, path: str, layer: str, column: str = "tei") -> DataFrame:
    """Boxes of the elements at ``path`` in parts of their page: doc_id, layer, pos, box_pos, page, l, t, w, h.

    Elements without coordinates are left out.
    """
    found = tei.select("doc_id", F.posexplode(F.xpath(F.col(column), F.lit(f"{path}/@coords"))).alias("pos", "coords"))
    boxes = found.select("doc_id", "pos", F.posexplode(coordinates(F.col("coords"))).alias("box_pos", "b"))
    size = page_sizes(tei, column)
    return boxes.select("doc_id", "pos", "box_pos", "b.*").join(size, ["doc_id", "page"]).select(
        "doc_id", F.lit(layer).alias("layer"), "pos", "box_pos", "page", (F.col("l") / F.col("width")).alias("l"),
        (F.col("t") / F.col("height")).alias("t"), (F.col("w") / F.col("width")).alias("w"), (F.col("h") / F.col("height")).alias("h"),
    )


#: Where the layers of a full text are.
LAYERS = {
    "authors": "//sourceDesc//persName",
    "bibs": "//text//listBibl//biblStruct",
    "mentions": "//text/body//ref[@type='bibr']",
    "headings": "//text/body/div/head",
    "sentences": "//text/body/div/p/s",
}


def full_text(tei: DataFrame, column: str = "tei") -> DataFrame:
    out = None
    for layer, path in LAYERS.items():
        rows = box_groups(tei, path, layer, column)
        out = rows if out is None else out.unionByName(rows)
    return out


def mention_targets(tei: DataFrame, column: str = "tei") -> DataFrame:
    """doc_id, pos, target of each mention that points at an entry."""
    path = "//text/body//ref[@type='bibr'][@target]/@target"
    rows = tei.select("doc_id", F.posexplode(F.xpath(F.col(column), F.lit(path))).alias("pos", "target"))
    return rows.withColumn("target", F.substring("target", 2, 1 << 20))


#: The parts of a full text that its tree is made of.
FULL_TEXT = (
    "facsimile struct<surface:array<struct<_n:string,_lrx:string,_lry:string>>>, text struct<body:struct<div:array<struct<"
    "head:array<struct<_n:string,_coords:string,_VALUE:string>>, p:array<struct<s:array<struct<_coords:string>>>>>>>>"
)
_NODE = "array<struct<level:string,section:int,paragraph:int,sentence:int,n_below:int,number:string,title:string,coords:string>>"


def tree(tei: DataFrame, column: str = "tei") -> DataFrame:
    """Sections with their heading, paragraphs and sentences as nested intervals, from one pass over the XML.

    doc_id, pos, last, level (section, heading, paragraph or sentence), section, paragraph, sentence, number, title, coords
    and ``sizes``, the size of each page. Nodes are numbered in the order of the document, and ``last`` is the
    last node below one, so that what is below is between ``pos`` and ``last``. Sentences without coordinates are
    left out, and so are headings without; the title is the last text of the heading that is in no element of it. Documents
    without a body, and what is no XML, have no nodes.
    """
    none = F.array().cast(_NODE)
    or_none = lambda c: F.coalesce(c, none)
    text = lambda c: c.cast("string")

    def node(level, section, paragraph, sentence, below, number, title, coords):
        place = [F.coalesce(x, F.lit(None)).cast("int").alias(n) for x, n in ((section, "section"), (paragraph, "paragraph"), (sentence, "sentence"), (below, "n_below"))]
        return F.struct(F.lit(level).alias("level"), *place, text(number).alias("number"), text(title).alias("title"), text(coords).alias("coords"))

    nil = F.lit(None)

    def section_nodes(div: Column, i: Column) -> Column:
        def paragraph_nodes(p: Column, j: Column) -> Column:
            placed = F.coalesce(F.filter(p["s"], lambda s: s["_coords"].isNotNull()), F.array().cast("array<struct<_coords:string>>"))
            return F.concat(
                F.array(node("paragraph", i, j, nil, F.size(placed), nil, nil, nil)),
                F.transform(placed, lambda s, k: node("sentence", i, j, k, F.lit(0), nil, nil, s["_coords"])),
            )

        below = or_none(F.flatten(F.transform(div["p"], paragraph_nodes)))
        head = F.try_element_at(div["head"], F.lit(1))
        heading = F.when(head["_coords"].isNotNull(), F.array(node("heading", i, nil, nil, F.lit(0), head["_n"], head["_VALUE"], head["_coords"])))
        inner = F.concat(or_none(heading), below)
        return F.concat(F.array(node("section", i, nil, nil, F.size(inner), head["_n"], head["_VALUE"], nil)), inner)

    parsed = tei.select("doc_id", F.from_xml(F.col(column), F.lit(FULL_TEXT), {"ignoreNamespace": "true"}).alias("x"))
    nodes = parsed.select("doc_id", F.col("x.facsimile.surface").alias("sizes"), F.posexplode(F.flatten(F.transform("x.text.body.div", section_nodes))).alias("pos", "n"))
    return nodes.select(
        "doc_id", "pos", (F.col("pos") + F.col("n.n_below")).alias("last"), *[F.col(f"n.{c}") for c in ("level", "section", "paragraph", "sentence", "number", "title", "coords")],
        "sizes",
    )


def tree_layers(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Headings, sentences, paragraphs and sections as layers over tokens: doc_id, level, id, pos, last, number, title, n_spans, start, end.

    ``tokens`` has doc_id, pos, start, end, page and a box. Each token is given out once over all
    levels, in the order of the document, to the heading or sentence whose box holds its centre; boxes of sentences are
    wider by half a mean token of their page on either side. A paragraph that has a sentence without
    tokens is dropped with all its sentences; sections and headings stay, if need be without spans. Ids count each level from 0.
    """
    spans = grouped.allocate_exclusively(tokens.select("doc_id", "pos", "start", "end", "page", *"ltwh"), _node_boxes(nodes, tokens), by_center=True)
    held = spans.groupBy("doc_id", F.col("group_pos").cast("int").alias("pos")).agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("b"))
    placed = nodes.drop("sizes", "coords").join(held, ["doc_id", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    paragraph, section = Window.partitionBy("doc_id", "section", "paragraph"), Window.partitionBy("doc_id", "section")
    whole = F.coalesce(F.bool_and(F.when(F.col("level") == "sentence", F.col("n") > 0)).over(paragraph), F.lit(True))
    kept = placed.withColumn("__k", whole | F.col("paragraph").isNull()).where("__k").drop("__k")
    up = lambda f, c: F.when(F.col("level") == "section", f(c).over(section)).when(F.col("level") == "paragraph", f(c).over(paragraph)).otherwise(F.col(c))
    rank = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy("pos")) - 1
    return kept.select(
        "doc_id", "level", "pos", "last", "number", "title", up(F.sum, "n").alias("n_spans"), up(F.min, "a").alias("start"), up(F.max, "b").alias("end")
    ).withColumn("id", rank)


def _node_boxes(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Boxes of headings and sentences in parts of their page; those on pages of no known size are left out."""
    placed = nodes.where("coords is not null").select("doc_id", "pos", "level", "sizes", F.posexplode(coordinates(F.col("coords"))).alias("box_pos", "b"))
    size = F.try_element_at(F.filter("sizes", lambda s: s["_n"].try_cast("int") - 1 == F.col("b.page")), F.lit(1))
    known = placed.select("doc_id", F.col("pos").alias("group_pos"), "box_pos", "level", "b.*", size["_lrx"].try_cast("double").alias("x"), size["_lry"].try_cast("double").alias("y"))
    boxes = known.where("x > 0 and y > 0").select(
        "doc_id", F.col("group_pos").cast("long").alias("group_pos"), "box_pos", "level", F.col("page").cast("long").alias("page"), (F.col("l") / F.col("x")).alias("l"),
        (F.col("t") / F.col("y")).alias("t"), (F.col("w") / F.col("x")).alias("w"), (F.col("h") / F.col("y")).alias("h"),
    )
    mean = tokens.groupBy("doc_id", "page").agg((F.avg("w") / 2).alias("__pad"))
    pad = F.when(F.col("level") == "sentence", F.coalesce("__pad", F.lit(0.0))).otherwise(0.0)
    padded = boxes.join(mean, ["doc_id", "page"], "left").withColumn("__p", pad)
    return padded.select("doc_id", "group_pos", "box_pos", "page", (F.col("l") - F.col("__p")).alias("l"), "t", (F.col("w") + 2 * F.col("__p")).alias("w"), "h")


def html_header(pages: DataFrame) -> DataFrame:
    """page_id, title, n_paragraphs, first_paragraph of web pages, by pattern."""
    paragraph = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return pages.select(
        "page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.size(paragraph).cast("bigint").alias("n_paragraphs"),
        F.coalesce(F.try_element_at(paragraph, F.lit(1)), F.lit("")).alias("first_paragraph"),
    )
