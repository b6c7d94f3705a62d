"""Best-fit packing of tokenised documents into sequences with several capacities.

Every piece is a vector: its tokens, one document, and its attention cost (the square
of its tokens). A sequence has a capacity for each. Pieces of one length are alike, so
the corpus is described in full by how many pieces there are of each length, at most
``capacity.tokens`` numbers however large it is. Only these go to the driver, which
places whole batches of alike pieces, longest first, into the class of sequences that
fits best under every constraint. Pieces then find their place by their rank among
those of the same length: the ranks come from counts per task and a running sum, so
nothing is sorted or gathered.

The plan that the driver broadcasts has a bound of its own. A length splits at most one
stretch of alike sequences and opens two, so with T tokens there are at most 3 T
stretches; by ``norm`` each gets a length at most once, and at most sqrt(2 T) different
lengths fit into a sequence. That makes 3 T sqrt(2 T) rows of 48 bytes, 19 MB for 2048
tokens; by ``dot`` at most 3 T min(T, documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.bpe import SLICE, load
from lamina.llm.common import cut, slices, texts


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds at most, and how much each residual counts in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: Tokens first: of sequences with about as many tokens left, the one with least room for documents and attention.
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    #: ``norm``: the least weighted residual norm; ``dot``: the largest weighted dot product.
    choose_by: str = "norm"


def tokenise(
    docs: DataFrame, vocabulary: str, tokens: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of at most ``tokens`` ids: id, piece, start, length, ids, task, nth.

    A document's ids are those of ``vocabulary`` (the content of a tokenizers file) and
    then ``separator``. Longer ones are cut into pieces of ``tokens`` ids, the last of
    which may be shorter. A null text counts as empty: one piece with the separator
    alone. ``ids`` is binary, little-endian unsigned 32-bit. ``task`` and ``nth`` say
    which task made a piece and how many of its length that task had made before.
    Null and repeated ids are packed as any others.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids binary, task int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        task = TaskContext.get().partitionId()
        end = np.array([separator], "<u4").tobytes()
        made = np.zeros(tokens + 1, np.int64)
        for part in slices(batches, "text", SLICE):
            owner, piece, ids = [], [], []
            for row, whole in enumerate(bpe.encode(texts(part, "text"))):
                whole += end
                for k in range(0, len(whole), 4 * tokens):
                    owner.append(row)
                    piece.append(k // (4 * tokens))
                    ids.append(whole[k : k + 4 * tokens])
            length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            nth = np.empty_like(length)
            nth[order] = np.arange(len(ordered)) - np.searchsorted(ordered, ordered) + made[ordered]
            made += np.bincount(length, minlength=tokens + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(np.array(piece, np.int64) * tokens),
                    pa.array(length),
                    pa.array(ids, pa.binary()),
                    pa.array(np.full(len(ids), task, np.int32)),
                    pa.array(nth),
                ],
                names=[id_col, "piece", "start", "length", "ids", "task", "nth"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: Capacity) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset, pieces in each): vector best-fit decreasing.

    Sequences with the same residuals form a class, kept as stretches of numbers. Of the
    classes that can take a piece under every capacity, the one with the best score does,
    of equals that with the least residuals. By ``norm`` a sequence that was best is
    better still after it took a piece, so it takes as many as fit; by ``dot`` it is
    worse then, so each sequence of the class takes one.
    """
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights = np.array(capacity.weights)
    fill = capacity.choose_by == "norm"
    stretches: dict[tuple, list[tuple[int, int]]] = {}
    room = np.empty((0, 3))
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.float64)
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        left, rank = counts[length], 0
        while left:
            fits = room[(room >= need).all(axis=1)]
            if len(fits):
                goodness = -(fits / limits @ (weights * need / limits)) if not fill else ((fits - need) / limits) ** 2 @ weights
                spot = fits[np.lexsort((fits[:, 2], fits[:, 1], fits[:, 0], goodness))[0]]
                source = stretches[tuple(spot)]
            else:
                spot, source = limits, [(opened, 1 if not fill else max(1, left // int((limits // need).min())))]
                opened += source[0][1]
            most = int((spot // need).min()) if fill else 1
            offset = int(capacity.tokens - spot[0])
            first, n = source.pop()
            each = min(most, left)
            use = min(n, left // each)
            if use < n:
                source.append((first + use, n - use))
            plan.append((length, rank, use * each, first, offset, each))
            rank, left = rank + use * each, left - use * each
            if not source and len(fits):
                del stretches[tuple(spot)]
                room = room[(room != spot).any(axis=1)]
            elif source and not len(fits):
                stretches[tuple(limits)] = source
                room = np.vstack([room, limits])
            after = tuple(spot - each * need)
            if after[0] > 0 and after[1] > 0:
                if after not in stretches:
                    stretches[after] = []
                    room = np.vstack([room, after])
                stretches[after].append((first, use))
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def plan_bound(capacity: Capacity) -> int:
    """The most rows that the plan of :func:`best_fit` has, whatever the corpus."""
    t = capacity.tokens
    each = int((2 * t) ** 0.5) + 1 if capacity.choose_by == "norm" else min(t, capacity.documents)
    return 3 * t * each


def pack(pieces: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """``pieces`` of :func:`tokenise`, or their columns but ``ids``, with ``sequence_id`` and ``offset``.

    ``pieces`` must give the same rows each time it is read, so cut its lineage first.
    Sequences are gapless from offset 0. Ties of pieces of one length go by the task that
    made them and their order in it. An empty table gives an empty result.
    """
    capacity = capacity or Capacity()
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("__n"))
    running = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(per_task.withColumn("__base", F.coalesce(F.sum("__n").over(running), F.lit(0))))
    # At most ``capacity.tokens`` rows.
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("__n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(best_fit(counts, capacity))
    ranked = pieces.join(base.drop("__n"), ["task", "length"]).withColumn("rank", F.col("__base") + F.col("nth"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        rows = plan.value
        # (length, first rank) ascends, so one search over both finds the step.
        scale = int(rows[:, 1].max()) + 1 if len(rows) else 1
        at = np.searchsorted(rows[:, 0] * scale + rows[:, 1], length.to_numpy() * scale + rank.to_numpy().clip(max=scale - 1), side="right") - 1
        row, nth = rows[at], rank.to_numpy() - rows[at, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + nth // row[:, 5], "offset": row[:, 4] + nth % row[:, 5] * row[:, 0]})

    keep = [c for c in pieces.columns if c not in ("task", "nth")]
    return ranked.withColumn("__place", place("length", "rank")).select(*keep, "__place.sequence_id", "__place.offset")
