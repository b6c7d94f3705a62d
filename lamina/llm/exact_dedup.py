"""Exact deduplication with two passes over a Bloom filter.

Pass one hashes every normalised text to two slots of a bit map and keeps the slots
that at least two rows reach. Pass two tests every row against that filter: a row with
a slot that only it reaches cannot have a copy and passes straight through. Only the
others are shuffled, by their full digest, so a false positive of the filter costs a
little traffic and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ascii_lower, cut, join_groups

#: Bits of one page of the filter, as ``bitmap_construct_agg`` makes them.
PAGE_BITS = 32768
#: The filter is broadcast, so it never exceeds this: 2**28 bits are 32 MB.
MOST_BITS = 1 << 28
HASHES = 2


def filter_bits(rows: int) -> int:
    """Bits for a share of false positives near 2 %, within the bound of the broadcast."""
    bits = PAGE_BITS
    while bits < 16 * rows and bits < MOST_BITS:
        bits *= 2
    return bits


def _slot(digest: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits))


def repeat_filter(digests: DataFrame, column: str, bits: int, least: int = 2) -> DataFrame:
    """(page, map) of the slots that ``least`` rows or more reach; at most ``bits`` bits in all."""
    slots = digests.select(
        F.explode(F.array(*[_slot(F.col(column), k, bits) for k in range(HASHES)])).alias("slot")
    )
    # A row that reaches one slot by both of its hashes counts twice there, which only
    # lets that row through to the exact comparison.
    twice = slots.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return twice.groupBy(F.shiftright("slot", 15).alias("page")).agg(
        F.bitmap_construct_agg((F.col("slot") % PAGE_BITS)).alias("map")
    )


def _has_bit(bitmap: Column, slot: Column) -> Column:
    position = slot % PAGE_BITS
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def tested(hashed: DataFrame, seen: DataFrame, bits: int, column: str = "__sha") -> DataFrame:
    """``hashed`` with ``__maybe``: whether all slots of the column are in the filter."""
    out, maybe = hashed, F.lit(True)
    for k in range(HASHES):
        pages = F.broadcast(seen.select(F.col("page").alias(f"__page{k}"), F.col("map").alias(f"__map{k}")))
        slot = _slot(F.col(column), k, bits)
        out = out.join(pages, F.shiftright(slot, 15) == F.col(f"__page{k}"), "left")
        maybe = maybe & _has_bit(F.col(f"__map{k}"), slot)
    return out.select(*hashed.columns, maybe.alias("__maybe"))


def _digest(text_col: str) -> Column:
    return F.sha2(ascii_lower(F.col(text_col)), 256)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(__id, __sha, __keep, __n) of each row; the filter; its bits. Reads the texts once."""
    digests = cut(docs.select(F.col(id_col).alias("__id"), F.unhex(_digest(text_col)).alias("__sha")))
    total = digests.count()
    bits = filter_bits(total)
    seen = cut(repeat_filter(digests, "__sha", bits))
    found = tested(digests, seen, bits)
    repeated = found.where("__maybe").drop("__maybe")
    groups = cut(repeated.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count("*").alias("__n")))
    together = join_groups(repeated, groups, ["__sha"], "__n", total)
    alone = found.where(~F.col("__maybe")).select(
        *digests.columns, F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__n")
    )
    return alone.unionByName(together), seen, bits


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after lower-casing A-Z; a null text counts as
    empty, and empty texts are equal to each other. In a group of equal texts the largest
    id stays. Rows that repeat an id are marked alike, so if an id occurs twice in a
    group and is the largest, both rows are kept. A null id never wins against another;
    if all ids of a group are null, keep_id is null and its rows are kept. An empty
    table gives an empty result. Columns of ``docs`` other than the two named are ignored.
    """
    marked, _, _ = _marked(docs, id_col, text_col)
    return marked.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`mark_exact_duplicates` does not keep.

    Whole rows move only if the filter finds that they may have a copy.
    """
    marked, seen, bits = _marked(docs, id_col, text_col)
    losers = marked.where(~F.col("__id").eqNullSafe(F.col("__keep"))).select(
        F.col("__id").alias("__lost"), F.col("__sha").alias("__lost_sha")
    ).distinct()
    named = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in named.items()], F.unhex(_digest(text_col)).alias("__sha")
    )
    found = tested(rows, seen, bits)
    kept = found.where("__maybe").join(
        losers,
        F.col(named[id_col]).eqNullSafe(F.col("__lost")) & (F.col("__sha") == F.col("__lost_sha")),
        "left_anti",
    )
    return found.where(~F.col("__maybe")).unionByName(kept).select(*[F.col(n).alias(c) for c, n in named.items()])
