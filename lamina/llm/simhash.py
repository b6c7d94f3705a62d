"""Near-duplicates by SimHash fingerprints and a grid over their segment popcounts.

A fingerprint has 64 bits. It is cut into segments of two bits, and the popcounts of its
segments are a point; the Manhattan distance of two points is never more than the
number of bits in which the fingerprints differ. In unary, a count of 0, 1 or 2 is two
bits with as many ones at the low end, so a whole point is one number and the distance
of two is the number of bits in which these differ.

Points that are at most three apart are at most one apart in one half of their
segments. Each half has a grid: a fingerprint lives in the cell of its own counts and
visits the cells above it, one count higher in one segment. Two that are at most one
apart in that half live in one cell, or one of them visits the other's. What meets in a
cell is held against the bound on the whole point, and what passes it is compared bit by bit.

Fingerprints are made distinct first, so copies cost nothing. Cells where more than
``BLOCK`` meet are dealt out in blocks, each of which meets each other once, and of a
block only a spanning forest of its links comes back: rows never grow with the pairs of
a cell. A cell of m fingerprints that all differ still costs m * m comparisons of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, join_groups, meet_groups, raw_texts, slices
from lamina.llm.near_dedup import components, words_of

SHINGLE, SEED, BITS, MOST = 3, 42, 64, 3
#: Fingerprints of a block.
BLOCK = 2048
#: Shingles whose bits are summed at once, and pairs that are compared at once.
SUMMED, COMPARED = 1 << 14, 1 << 20

_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(words: list[bytes]) -> int:
    """Bit b is one if it is in over half the hashes of all runs of three words (or of all words, if fewer); zero without words."""
    if not words:
        return 0
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, SUMMED):
        b = min(n, a + SUMMED)
        runs = map(b" ".join, zip(*(words[a + k : b + k] for k in range(width)), strict=True))
        hashed = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.dtype("<u8"), b - a)
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def embed(prints: np.ndarray) -> np.ndarray:
    """The segment popcounts of fingerprints (uint64), each in unary."""
    low, high = prints & _LOW, (prints >> _ONE) & _LOW
    return (low | high) | ((low & high) << _ONE)


def cells(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, cell, lives) of all cells in which points live or which they visit.

    A cell is named by the half (bit 32) and the counts of that half.
    """
    owner, cell, lives = [], [], []
    every = np.arange(len(points))
    for half in range(2):
        part = (points >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        name = np.uint64(half << 32)
        owner.append(every)
        cell.append(part | name)
        lives.append(np.ones(len(points), bool))
        for segment in range(16):
            at = np.uint64(2 * segment)
            count = (part >> at) & np.uint64(3)
            up = np.flatnonzero(count < 3)
            # Unary counts 0, 1, 2 are 00, 01, 11.
            bit = np.where(count[up] == 0, _ONE, _ONE << _ONE) << at
            owner.append(up)
            cell.append(part[up] | bit | name)
            lives.append(np.zeros(len(up), bool))
    return np.concatenate(owner), np.concatenate(cell).view(np.int64), np.concatenate(lives)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of fingerprints differ in at most ``MOST`` bits."""
    out = np.bitwise_count(embed(a) ^ embed(b)) <= MOST
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= MOST
    return out


class _Forest:
    """Keeps of the links it is given those that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def links(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        kept = []
        for x, y in zip(a, b, strict=True):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                kept.append((x, y))
        return kept


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            prints = np.array([fingerprint(words_of(t)) for t in raw_texts(part, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints)], names=["id", "print"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, print long")


def _placed(prints: DataFrame) -> DataFrame:
    """(cell, print, lives) of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(a, 4096).to_numpy()
                owner, cell, lives = cells(embed(own.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own[owner]), pa.array(lives)], names=["cell", "print", "lives"])

    return prints.select("print").mapInArrow(run, "cell long, print long, lives boolean")


def _dealt(placed: DataFrame) -> DataFrame:
    """(cell, part, print, lives, side): what meets in a part of a cell.

    Small cells have one part. In others, those that live there are dealt into blocks by
    their hash; block i meets block j >= i in part (i, j), and a block of visitors meets block i in
    part (i, n + k). Side 0 meets side 1, and in parts without side 1 it meets itself.
    """
    met = placed.groupBy("cell").agg(F.sum(F.col("lives").cast("long")).alias("n"), F.count("*").alias("all"))
    met = cut(met.where("n > 0 AND all > 1"))
    total = met.agg(F.sum("all")).first()[0] or 1
    blocks, guests = F.ceil(F.col("n") / BLOCK), F.ceil((F.col("all") - F.col("n")) / BLOCK)
    rows = meet_groups(placed, met, "cell", "all", total).select("cell", "print", "lives", "n", "all", blocks.alias("blocks"), guests.alias("guests"))
    small = rows.where(F.col("all") <= BLOCK).select("cell", F.lit(0).cast("long").alias("part"), "print", "lives", F.lit(0).alias("side"))
    large = rows.where(F.col("all") > BLOCK)
    width = F.col("blocks") + F.col("guests")
    at = F.pmod(F.xxhash64("print"), F.when(F.col("lives"), F.col("blocks")).otherwise(F.col("guests")))
    large = large.select("cell", "print", "lives", "blocks", width.alias("width"), at.alias("at"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # A resident of block i is side 0 in the parts (i, *), and side 1 in the parts (j, i) of the blocks before.
    as_first = large.where("lives").select("cell", F.explode(F.transform(F.sequence(F.col("at"), F.col("width") - 1), lambda j: F.col("at") * F.col("width") + j)).alias("part"), "print", "lives", F.lit(0).alias("side"))
    as_later = large.where("lives AND at > 0").select("cell", F.explode(F.transform(each(F.col("at")), lambda j: j * F.col("width") + F.col("at"))).alias("part"), "print", "lives", F.lit(1).alias("side"))
    as_guest = large.where("NOT lives").select(
        "cell", F.explode(F.transform(each(F.col("blocks")), lambda j: j * F.col("width") + F.col("blocks") + F.col("at"))).alias("part"), "print", "lives", F.lit(1).alias("side")
    )
    return small.unionByName(as_first).unionByName(as_later).unionByName(as_guest)


def _links(dealt: DataFrame) -> DataFrame:
    """Distinct links (a, b), a > b, enough of them to connect all that is linked in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            cell, part = rows.column("cell").to_numpy(), rows.column("part").to_numpy()
            # The last part may go on in the next batch.
            last = int(np.flatnonzero((cell != cell[-1]) | (part != part[-1]))[-1]) + 1 if len(cell) and ((cell != cell[-1]) | (part != part[-1])).any() else 0
            yield from found(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield from found(held)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        cell, part = rows.column("cell").to_numpy(), rows.column("part").to_numpy()
        own = rows.column("print").to_numpy().view(np.uint64)
        side, lives = rows.column("side").to_numpy(), rows.column("lives").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[starts, len(cell)])
        forest, out = _Forest(), []

        def hold(i: np.ndarray, j: np.ndarray) -> None:
            # One of two must live in the cell, and where there are two sides they are of different ones.
            ok = (lives[i] | lives[j]) & ((side[i] != side[j]) | ~sided[i])
            i, j = i[ok], j[ok]
            hit = near(own[i], own[j])
            a, b = own[i[hit]].view(np.int64), own[j[hit]].view(np.int64)
            out.extend(forest.links(a.tolist(), b.tolist()))

        has = np.maximum.reduceat(side, starts) > 0
        sided = np.repeat(has, sizes)
        small = sizes <= 64
        # Pairs of all small parts at once: the k-th row of each with those before it.
        rank = np.arange(len(cell)) - np.repeat(starts, sizes)
        i = np.flatnonzero(np.repeat(small, sizes) & (rank > 0))
        ends = np.cumsum(rank[i])
        a = 0
        while a < len(i):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + COMPARED)))
            n = rank[i[a:b]]
            left = np.repeat(i[a:b], n)
            step = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            hold(left, left - 1 - step)
            a = b
        for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            every = np.arange(start, start + size)
            width = max(1, COMPARED // size)
            for x in range(1, size, width):
                left = every[x : x + width]
                i, j = np.repeat(left, size), np.tile(every, len(left))
                keep = j < i
                hold(i[keep], j[keep])
        x = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x.max(axis=1, initial=np.iinfo(np.int64).min)), pa.array(x.min(axis=1, initial=np.iinfo(np.int64).max))], names=["a", "b"])

    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(run, "a long, b long").distinct()


def mark_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint and component_id.

    A text is lower-cased in A-Z and split at ASCII white space; each run of three words
    (fewer words: all of them), repeats included, votes with its XXH64, and a bit needs
    over half of the votes. The fingerprint is 16 hexadecimal digits; without words, or
    text, it is zero. Documents are linked if their fingerprints differ in three bits or
    fewer, and component_id is the smallest id that links reach. Null ids are linked as any
    others, and are named only by ids of others: without any, the component is null. Rows
    that repeat an id are marked each by its text. An empty table gives an empty result; other columns are ignored.
    """
    printed = cut(_fingerprints(docs, id_col, text_col))
    groups = cut(printed.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    links = cut(_links(_dealt(cut(_placed(groups)))))
    labels = components(links)
    # Those without links are labels of their own; a null would send them all to one task.
    labelled = cut(groups.join(labels, groups["print"] == labels["node"], "left").select("print", "least", "copies", F.coalesce("label", "print").alias("label")))
    joined = labelled.groupBy("label").agg(F.min("least").alias("reached"), F.count("*").alias("prints")).where("prints > 1")
    total = printed.count()
    named = join_groups(labelled, joined, ["label"], "prints", total)
    named = named.select("print", "copies", F.when(F.col("prints").isNull(), F.col("least")).otherwise(F.col("reached")).alias("reached"))
    marked = join_groups(printed, named, ["print"], "copies", total)
    return marked.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("reached").alias("component_id"))
