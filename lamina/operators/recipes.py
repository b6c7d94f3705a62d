"""Recipes: predictors run one after another, each over the layers made so far."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import layers
from lamina.operators.predictors import Predictor, run


class Recipe(Protocol):
    """Makes layers of documents (doc_id, text), or of a table of such that stands at a path."""

    def from_docs(self, docs: DataFrame) -> dict[str, DataFrame]: ...

    def from_path(self, docs_at: Callable[[str], DataFrame], path: str) -> dict[str, DataFrame]: ...


@dataclass(frozen=True)
class Step:
    """A predictor made of a function of layers."""

    required: tuple[str, ...]
    make: Callable[[dict[str, DataFrame]], DataFrame]

    def predict(self, found: dict[str, DataFrame]) -> DataFrame:
        return self.make(found)


def blocks_of(layout: DataFrame, equations: DataFrame) -> DataFrame:
    """Both layers as one: those of the layout first, numbered anew."""
    both = layout.withColumn("__layer", F.lit(0)).unionByName(equations.withColumn("__layer", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("__layer", "pos")) - 1
    return both.withColumn("pos", place.cast("bigint")).drop("__layer")


@dataclass(frozen=True)
class CoreRecipe:
    """Words, layout, equations, blocks (both of these) and labels, in this order, over tokens, rows and pages."""

    words: Predictor
    layout: Predictor
    equations: Predictor
    labels: Predictor

    def from_docs(self, docs: DataFrame) -> dict[str, DataFrame]:
        dealt = layers.spread(docs)
        out = {"tokens": layers.tokens(dealt), "rows": layers.rows(dealt)}
        out["pages"] = layers.pages(out["rows"])
        for name in ("words", "layout", "equations"):
            out[name] = run(getattr(self, name), out)
        out["blocks"] = blocks_of(out["layout"], out["equations"])
        out["labels"] = run(self.labels, out)
        return out

    def from_path(self, docs_at: Callable[[str], DataFrame], path: str) -> dict[str, DataFrame]:
        return self.from_docs(docs_at(path))
