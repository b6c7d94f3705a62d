"""Bibliography entries as records of fields, from the labels of their words.

Everything stays in the row of an entry: labels are an array, and fields are found in it by
expressions, so there is no exchange between the text and its record.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import text as tx
from lamina.operators import windows

#: Labels of words of an entry, numbered from 0.
LABELS = (
    "MISC", "CITATION_NUMBER", "AUTHOR_START", "AUTHOR_MIDDLE", "AUTHOR_END", "ISSUED_DAY", "ISSUED_MONTH", "ISSUED_YEAR", "TITLE",
    "JOURNAL", "PUBLISHER", "VOLUME", "ISSUE", "PAGE", "URL", "DOI", "EVENT", "ISBN",
)
_LETTERS = [chr(ord("A") + i) for i in range(len(LABELS))]
AUTHOR = [_LETTERS[LABELS.index(x)] for x in ("AUTHOR_START", "AUTHOR_MIDDLE", "AUTHOR_END")]
SPAN = "struct<start:int,end:int>"
FIELDS = ("number", "title", "venue", "year", "doi", "url")


def first_parts(labels: Column) -> Column:
    """A letter for each word, A for label 0 and on, by the first of its sub-words; A for a word without any."""
    return F.array_join(F.transform(labels, lambda x: F.element_at(F.array(*map(F.lit, _LETTERS)), F.coalesce(F.try_element_at(x, F.lit(1)).cast("int"), F.lit(0)) + 1)), "")


def first_field(labels: Column, starts: Column, ends: Column, wanted: str) -> Column:
    """The span of the first run of one label, in ``labels`` as :func:`first_parts` has them; null if there is none."""
    run = F.regexp_extract(labels, _LETTERS[LABELS.index(wanted)] + "+", 0)
    at = F.locate(_LETTERS[LABELS.index(wanted)], labels)
    last = F.try_element_at(ends, F.greatest(at, F.lit(1)) + F.length(run) - 1)
    return F.when(at > 0, F.struct(F.try_element_at(starts, at).alias("start"), last.alias("end")))


def author_fields(labels: Column, starts: Column, ends: Column) -> Column:
    """Spans of authors: one opens at a start, goes on over all labels of authors, and counts once another label closes it."""
    none = F.array().cast(f"array<{SPAN}>")
    opens, author = AUTHOR[0], "".join(AUTHOR)
    # What stands before an author, and the author, in turn, in linear time; one that is open at the end is cut off first.
    closed, pattern = F.rtrim(labels, F.lit(author)), F.lit(rf"\G([^{opens}]*+)({opens}[{author}]*+)")
    before, found = (F.regexp_extract_all(closed, pattern, F.lit(i)) for i in (1, 2))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["b"]) + F.length(x["f"])).alias("at"),
        F.array_append(acc["done"], F.struct(
            F.element_at(starts, acc["at"] + F.length(x["b"]) + 1).alias("start"), F.element_at(ends, acc["at"] + F.length(x["b"]) + F.length(x["f"])).alias("end"),
        )).alias("done"),
    )
    walked = F.aggregate(F.arrays_zip(before.alias("b"), found.alias("f")), F.struct(F.lit(0).alias("at"), none.alias("done")), step, lambda acc: acc["done"])
    return F.when(F.contains(labels, F.lit(opens)), walked).otherwise(none)


def with_text(span: Column, text: Column) -> Column:
    """The span with its text; null for no span."""
    return F.when(span.isNotNull(), F.struct(span["start"].alias("start"), span["end"].alias("end"), F.substring(text, span["start"] + 1, span["end"] - span["start"]).alias("text")))


def fields(entries: DataFrame) -> DataFrame:
    """Entries with number, authors, title, venue, year, doi and url, each a span of the entry's text, with that text.

    ``entries`` is what :func:`windows.label_words` gives for labels numbered as in ``LABELS``; a word has
    the label of its first sub-word. A field is the first run of its label, the venue that of a
    journal or else of an event. What is not found is null, and of authors an empty array.
    """
    labels, starts, ends, text = (F.col(c) for c in ("__l", "starts", "ends", "text"))
    found = {n: first_field(labels, starts, ends, w) for n, w in (
        ("number", "CITATION_NUMBER"), ("title", "TITLE"), ("year", "ISSUED_YEAR"), ("doi", "DOI"), ("url", "URL"),
    )}
    found["venue"] = F.coalesce(first_field(labels, starts, ends, "JOURNAL"), first_field(labels, starts, ends, "EVENT"))
    authors = F.transform(author_fields(labels, starts, ends), lambda s: with_text(s, text))
    made = entries.withColumn("__l", first_parts(F.col("labels")))
    return made.select(
        "doc_id", F.col("part").alias("entry"), "start", "text", *[with_text(found[n], text).alias(n) for n in FIELDS], authors.alias("authors")
    )


def records(found: DataFrame) -> DataFrame:
    """One record for each entry: number, title and doi cleaned, venue and year as they stand, authors as texts."""
    return found.select(
        "doc_id", "entry", F.col("number.text").alias("number"), F.transform("authors", lambda a: a["text"]).alias("authors"),
        tx.clean_field(F.col("title.text")).alias("title"), F.col("venue.text").alias("venue"), F.col("year.text").alias("year"),
        tx.clean_doi(F.col("doi.text")).alias("doi"), F.col("url.text").alias("url"),
    )


def layers(found: DataFrame) -> DataFrame:
    """The fields as layers in one table: doc_id, entry, field, pos (among the authors), start and end in the document."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    named = [F.struct(F.lit(n).alias("field"), F.when(F.col(n).isNull(), none).otherwise(F.array(n)).alias("spans")) for n in FIELDS]
    every = F.explode(F.array(*named, F.struct(F.lit("authors").alias("field"), F.col("authors").alias("spans"))))
    rows = found.select("doc_id", "entry", "start", every.alias("f")).select("doc_id", "entry", F.col("start").alias("base"), "f.field", F.posexplode("f.spans").alias("pos", "s"))
    return rows.select("doc_id", "entry", "field", "pos", (F.col("base") + F.col("s.start")).alias("start"), (F.col("base") + F.col("s.end")).alias("end"))


def rule_labels(batch: windows.Batch) -> np.ndarray:
    """A rule in place of a trained model, by the first characters and the length of words.

    A number in front is the entry's; other words of digits are a year up to four characters, a
    page up to eight and a DOI beyond. Capitals begin authors, small letters titles, and all else is the journal.
    """
    names = {n: i for i, n in enumerate(LABELS)}

    def label(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        kind = batch.kind[row, column]
        heads = (batch.first & batch.mask).ravel()
        word = np.cumsum(heads) - 1
        size = np.bincount(word[batch.mask.ravel()], batch.length.ravel()[batch.mask.ravel()], minlength=len(row)) if len(row) else np.zeros(0)
        capital = kind == windows.UPPER
        goes_on = np.r_[False, capital[:-1] & (row[1:] == row[:-1])]
        digit = kind == windows.DIGIT
        return np.select(
            [digit & (batch.word[row, column] == 0), digit & (size <= 4), digit & (size <= 8), digit, capital & goes_on, capital, kind == windows.LOWER],
            [names[x] for x in ("CITATION_NUMBER", "ISSUED_YEAR", "PAGE", "DOI", "AUTHOR_MIDDLE", "AUTHOR_START", "TITLE")], names["JOURNAL"],
        )

    return windows.by_word(batch, label)
