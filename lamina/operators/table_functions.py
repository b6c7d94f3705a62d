"""Layers of documents as table functions of SQL.

    SELECT * FROM layer_of(TABLE(SELECT doc_id, text FROM documents) PARTITION BY (doc_id), 'sentences')

The function is told which layer is wanted and has the columns of that layer; the texts are dealt
out by Spark, and each is worked on by the arrays that the DataFrame form works with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lamina.operators import inrow

#: Columns behind doc_id, pos, start and end of each layer.
COLUMNS = {"tokens": ("text",), "rows": ("text", "page"), "pages": ("n_rows",), "sentences": ("text",)}


class LayerOf:
    """Rows of one layer of each text; null texts count as empty, and null ids and repeated rows are texts of their own."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, layer: AnalyzeArgument) -> AnalyzeResult:
        if not docs.isTable:
            raise ValueError("the first argument is a table with doc_id and text")
        kinds = {f.name: f.dataType for f in docs.dataType.fields}
        if not {"doc_id", "text"} <= kinds.keys():
            raise ValueError(f"doc_id and text are wanted, there is {', '.join(kinds)}")
        if layer.value not in COLUMNS:
            raise ValueError(f"no such layer: {layer.value}; there is {', '.join(COLUMNS)}")
        out = StructType().add("doc_id", kinds["doc_id"])
        for c in ("pos", "start", "end", *COLUMNS[layer.value]):
            out = out.add(c, StringType() if c == "text" else LongType())
        return AnalyzeResult(out)

    def eval(self, docs: Row, layer: str) -> Iterator[tuple]:
        t = inrow.Texts(pa.array([docs["text"]], pa.string()))
        if layer == "pages":
            found, n_rows = inrow.pages(t.rows())
            more = [n_rows.tolist()]
        else:
            found = getattr(t, layer)()
            more = [t.texts(found).to_pylist()]
            if layer == "rows":
                more.append((found.pos // inrow.ROWS_PER_PAGE).tolist())
        for row in zip(found.pos.tolist(), found.start.tolist(), found.end.tolist(), *more, strict=True):
            yield docs["doc_id"], *row


def register(spark: SparkSession) -> None:
    """Makes ``layer_of`` known to the SQL of this session."""
    spark.udtf.register("layer_of", F.udtf(LayerOf))
