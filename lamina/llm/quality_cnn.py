"""Quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned filters
run over each chunk, and each filter's largest response in the chunk is kept. Of these,
the mean and the maximum over the chunks describe the text; a logistic unit makes one
probability of them. The network is trained here, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import raw_texts, slices

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, DEPTH, FILTERS = 8, 4, 8, 24
PAD = 256  # a byte value of its own
SPOTS = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Network:
    embed: np.ndarray  # (257, DEPTH)
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    bias: float


def chunks_of(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text, the last one padded; at least one."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    row = np.full(n * step + OVERLAP, PAD, np.int16)
    row[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(row, CHUNK)[::step]


def windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    """(chunk, spot, WIDTH * DEPTH) views of the embedded bytes."""
    flat = net.embed[chunks].reshape(len(chunks), CHUNK * DEPTH)
    return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DEPTH, axis=1)[:, :: STRIDE * DEPTH]


def pooled(net: Network, chunks: np.ndarray) -> np.ndarray:
    """Each filter's largest response in each chunk, not below 0."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for a in range(0, len(chunks), 256):
        view = windows(net, chunks[a : a + 256])
        response = np.ascontiguousarray(view).reshape(-1, WIDTH * DEPTH) @ net.filters
        out[a : a + 256] = response.reshape(len(view), SPOTS, FILTERS).max(1)
    return np.maximum(out + net.shift, 0)


def scores(net: Network, batch: list[bytes]) -> np.ndarray:
    parts = [chunks_of(t) for t in batch]
    sizes = np.array([len(p) for p in parts])
    top = pooled(net, np.concatenate(parts))
    starts = np.cumsum(sizes) - sizes
    described = np.c_[np.add.reduceat(top, starts) / sizes[:, None], np.maximum.reduceat(top, starts)]
    return 1 / (1 + np.exp(-np.clip(described @ net.out + net.bias, -40, 40)))


def gradients(net: Network, part: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of texts with ``sizes`` chunks each of ``part``."""
    starts = np.cumsum(sizes) - sizes
    view = np.ascontiguousarray(windows(net, part))
    response = (view.reshape(-1, WIDTH * DEPTH) @ net.filters).reshape(len(part), SPOTS, FILTERS)
    spot = response.argmax(1)
    raw = np.take_along_axis(response, spot[:, None], 1)[:, 0] + net.shift
    top = np.maximum(raw, 0)
    mean, most = np.add.reduceat(top, starts) / sizes[:, None], np.maximum.reduceat(top, starts)
    described = np.c_[mean, most]
    p = 1 / (1 + np.exp(-np.clip(described @ net.out + net.bias, -40, 40)))
    error = ((p - labels) / len(labels)).astype(net.out.dtype)
    grads = {"out": described.T @ error, "bias": np.array([error.sum()])}
    back = error[:, None] * net.out
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    to_top = back[text_of, :FILTERS] / sizes[text_of, None]
    leads = top == most[text_of]
    ties = np.add.reduceat(leads.astype(np.float32), starts)
    to_top = to_top + leads * (back[:, FILTERS:] / ties)[text_of]
    to_raw = to_top * (raw > 0)
    seen = view[np.arange(len(part))[:, None], spot]  # (chunk, filter, WIDTH * DEPTH)
    grads["filters"] = np.einsum("cfw,cf->wf", seen, to_raw)
    grads["shift"] = to_raw.sum(0)
    to_seen = to_raw[:, :, None] * net.filters.T[None]
    where = (spot * STRIDE)[:, :, None] + np.arange(WIDTH)
    bytes_seen = part[np.arange(len(part))[:, None, None], where]
    to_embed = np.zeros_like(net.embed)
    np.add.at(to_embed, bytes_seen.reshape(-1), to_seen.reshape(-1, DEPTH))
    to_embed[PAD] = 0
    return grads | {"embed": to_embed}


def fit(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, seed: int = 7) -> Network:
    """Adam on the logistic loss. ``owner`` ascends and says to which label each chunk belongs."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, DEPTH)).astype(np.float32),
        rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))),
    )
    net.embed[PAD] = 0
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    first = np.searchsorted(owner, np.arange(len(labels) + 1))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            texts = order[a : a + batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in texts])
            grads = gradients(net, chunks[rows], first[texts + 1] - first[texts], labels[texts])
            grads["out"] = grads["out"] + 1e-4 * net.out
            step += 1
            for name, g in grads.items():
                m, v = moments.get(name, (np.zeros_like(g), np.zeros_like(g)))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[name] = (m, v)
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if name == "bias":
                    net.bias -= float(change[0])
                else:
                    setattr(net, name, (getattr(net, name) - change).astype(np.float32))
    return net


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          most_rows: int = 4000, most_bytes: int = 8 << 20) -> Network | None:
    """A network from labelled documents.

    At most ``most_rows`` labelled rows are used, in the order of their hashed ids, as
    long as their texts have at most ``most_bytes`` bytes in all; a text of more than a
    sixteenth of that does not teach. All chunks of a text that does are used. Labels that
    are null or without a document are left out. Without any, there is no network and
    every score is 0.5.
    """
    used = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
        .dropDuplicates(["__id"])
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most_rows)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    # A row for each label, ``most_rows`` at most, in one window.
    sizes = texts.select("__id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(used), "__id")
    sizes = sizes.groupBy("__id", "label").agg(F.sum("size").alias("size")).where(F.col("size") * 16 <= most_bytes)
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("__id"), "__id"))
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("__id", "label")
    rows = texts.join(F.broadcast(chosen), "__id")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = [chunks_of(text).astype("<i2").tobytes() for text in raw_texts(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("__id"), part.column("label"), pa.array(out, pa.binary())], names=["__id", "label", "chunks"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(spread, f"__id {kind}, label int, chunks binary").collect()
    got.sort(key=lambda r: (r["__id"], r["label"], bytes(r["chunks"])))
    if not got:
        return None
    parts = [np.frombuffer(bytes(r["chunks"]), "<i2").reshape(-1, CHUNK) for r in got]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(np.concatenate(parts), owner, np.array([r["label"] for r in got], np.float32))


def score_quality(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and score, from 0 to 1, higher for better texts.

    Every byte of a text is read. Null counts as empty; an empty text is one chunk of
    padding and has a score. Null and repeated ids are scored as any others; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            got = np.full(part.num_rows, 0.5) if net is None else scores(net, raw_texts(part, "text")).astype(float)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got)], names=[id_col, "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double")
