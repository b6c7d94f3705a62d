"""Removal of repeated passages by content-defined chunking.

A gear rolling hash runs over the bytes of each text; a chunk ends behind a white space
where the hash of the bytes before it has its low bits zero. Where the last ``BARE`` bytes
have no white space, as in scripts that use none, a chunk may end at any letter, one in
sixteen. Ends depend on the last ``BARE`` bytes alone, so an insertion moves only the ends
near it. Chunks are deduplicated by digest: the first occurrence in the order of (id,
place) stays. What is deduplicated is a window: the least run of neighbouring chunks, from
each chunk on, that has enough words to be a passage. So whatever is cut has occurred
before as a whole, and no text goes because its phrases occur here and there, however many
texts there are. Windows that overlap or touch make one passage; the parts of a passage
before its first and behind its last whole chunk stay.

Digests have 128 bits. Windows that no other has a slot with in a bit map of all digests
are left out before anything is shuffled; the slots of a task go to the map as packed
pages, four bytes each. The map has at most ``MOST_BITS`` bits, so that it can be broadcast;
beyond 2**27 windows more of them pass it, which costs traffic and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, join_groups, raw_texts, slices

#: Bytes that the hash looks back on.
REACH = 32
#: One white space in four ends a chunk, so chunks have about four words.
MASK = np.uint32(0x3 << 29)
#: Without white space in so many bytes, one letter in sixteen ends a chunk.
BARE = 64
BARE_MASK = np.uint32(0xF << 27)
#: A chunk without an end of its own ends here; such text repeats itself, since the hash of others meets the mask sooner.
LONGEST = 1024
#: Words a window must have. Passages of 50 words lose about four on either side.
LEAST_WORDS = 25
#: A run of more bytes without white space counts as a word for every six, which are two letters of such scripts.
LONG_WORD = 48
#: Least slots of a page of the bit map, its pages at most, and bits of the whole at most: 32 MB.
PAGE_SLOTS, PAGES, MOST_BITS = 1 << 16, 256, 1 << 28

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _gear() -> np.ndarray:
    """A fixed random number for each byte; zero for the padding between texts."""
    x = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    gear = (x ^ (x >> np.uint64(31))).astype(np.uint32)
    gear[0] = 0
    return gear


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + gear[byte] (mod 2**32) behind every byte, by doubling."""
    h = GEAR[data]
    reach = 1
    while reach < REACH:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h


def cut_points(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text."""
    gap = bytes(BARE)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    hashed = rolling(data)
    space = _SPACE[data]
    ends = np.flatnonzero(((hashed & MASK) == 0) & space) + 1
    # The bytes since the last white space, or since the padding before the text.
    at = np.arange(len(data), dtype=np.int32)
    last = np.maximum.accumulate(np.where(space | (data == 0), at, np.int32(-1)))
    bare = np.flatnonzero(((hashed & BARE_MASK) == 0) & (at - last >= BARE)) + 1
    bare = bare[bare < len(data)]
    bare = bare[(data[bare] & 0xC0) != 0x80]
    if len(bare):
        ends = np.union1d(ends, bare)
    out, start = [], 0
    for text in texts:
        stop = start + len(text)
        a, b = np.searchsorted(ends, [start, stop], side="right")
        own, last_end = [], 0
        for end in [*(ends[a:b] - start).tolist(), len(text)]:
            while end - last_end > LONGEST:
                last_end = _letter(text, last_end + LONGEST)
                own.append(last_end)
            if end > last_end:
                own.append(end)
                last_end = end
        out.append(own)
        start = stop + BARE
    return out


def _letter(text: bytes, at: int) -> int:
    """``at``, or the start of the letter that it would cut."""
    for back in range(4):
        if text[at - back] & 0xC0 != 0x80:
            return at - back
    return at


def count_words(piece: bytes) -> int:
    """Words of a chunk; long runs without white space count as several."""
    words = piece.split()
    if len(piece) <= LONG_WORD:
        return len(words)
    return sum(1 if len(w) <= LONG_WORD else len(w) // 6 for w in words)


def _pieces(text: bytes, ends: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Windows(NamedTuple):
    """Windows of several texts: the text of each, its bytes from start to stop, the words before it and up to its end, and its digest as two integers."""

    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    before: np.ndarray
    upto: np.ndarray
    digest: np.ndarray


def windows(texts: list[bytes], least_words: int) -> Windows:
    """From each chunk on the fewest chunks that have ``least_words`` together, as far as the text has them."""
    ends = cut_points(texts)
    each = np.fromiter(map(len, ends), np.int64, len(ends))
    words = np.array([count_words(p) for t, e in zip(texts, ends, strict=True) for p in _pieces(t, e)], np.int64)
    owner = np.repeat(np.arange(len(ends)), each)
    stop = np.array([x for e in ends for x in e], np.int64)
    last = np.cumsum(each)
    first = (last - each)[owner]
    upto = np.cumsum(words)
    before = upto - words
    end = np.searchsorted(upto, before + least_words)
    start = np.r_[0, stop[:-1]] * (np.arange(len(stop)) > first) if len(stop) else stop
    own = np.flatnonzero(end < last[owner])
    base = before[first[own]]
    found = Windows(owner[own], start[own], stop[end[own]], before[own] - base, upto[end[own]] - base, np.zeros((0, 2), np.int64))
    raw = b"".join(xxhash.xxh3_128_digest(texts[k][a:b]) for k, a, b in zip(found.owner.tolist(), found.start.tolist(), found.stop.tolist(), strict=True))
    return found._replace(digest=np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 2))


def _slot_bits(docs: DataFrame) -> int:
    """Bits of the map: eight for a chunk of thirty bytes, within the bound."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = PAGE_SLOTS
    while bits < 8 * size / 30 and bits < MOST_BITS:
        bits *= 2
    return bits


def repeated_slots(docs: DataFrame, bits: int, least_words: int = LEAST_WORDS) -> np.ndarray:
    """A bit map of the slots that two windows or more of ``docs`` (text) have.

    The number of pages is bounded, so a slice of text gives as many rows at every size.
    """
    pages = min(bits // PAGE_SLOTS, PAGES)
    width = bits // pages

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            found = windows(raw_texts(part, "text"), least_words).digest
            if not len(found):
                continue
            slots, n = np.unique(found[:, 0] & (bits - 1), return_counts=True)
            slots = np.repeat(slots, np.minimum(n, 2))
            page = slots // width
            first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
            raw = (slots % width).astype("<u4").tobytes()
            ends = [*(4 * first[1:]).tolist(), len(raw)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(page[first]), pa.array([raw[a:b] for a, b in zip((4 * first).tolist(), ends, strict=True)], pa.binary())],
                names=["page", "slots"],
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of this partition; a count for each slot of those, one byte, up to two."""
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, raw in zip(batch.column("page").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                slots = np.frombuffer(raw, "<u4").astype(np.int64)
                own = counts.get(page)
                if own is None:
                    own = counts[page] = np.zeros(width // 4, np.uint8)
                # Two bits a slot: met once, met again.
                twice = np.flatnonzero(slots[1:] == slots[:-1])
                byte, shift = slots >> 2, ((slots & 3) * 2).astype(np.uint8)
                again = (own[byte] >> shift) & 1
                again[twice] = 1
                np.bitwise_or.at(own, byte, (1 << shift) | (again << (shift + 1)))
        for page, own in counts.items():
            bits_ = np.stack([(own >> (2 * k + 1)) & 1 for k in range(4)], axis=1).ravel()
            if bits_.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page]), pa.array([np.packbits(bits_, bitorder="little").tobytes()], pa.binary())], names=["page", "map"]
                )

    # A partition merges its pages in 256 KB each at most.
    made = docs.mapInArrow(packed, "page long, slots binary").repartition("page").mapInArrow(merged, "page long, map binary")
    out = np.zeros((pages, width // 8), np.uint8)
    for r in made.toLocalIterator():  # at most MOST_BITS bits in all
        out[r["page"]] = np.frombuffer(r["map"], np.uint8)
    return out.ravel()


def _maybe_repeated(docs: DataFrame, slots, least_words: int) -> DataFrame:
    """(id, key, start, stop, before, upto, d1, d2) of the windows of ``docs`` (id, key, text) whose slot is set in a broadcast bit map; bytes of UTF-8."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = slots.value
        for part in slices(batches, "text", 1 << 19):
            w = windows(raw_texts(part, "text"), least_words)
            slot = w.digest[:, 0] & (8 * len(bitmap) - 1)
            keep = np.flatnonzero((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays(
                [part.column(c).take(pa.array(w.owner[keep])) for c in ("id", "key")]
                + [pa.array(c[keep].astype(np.int32)) for c in w[1:5]] + [pa.array(np.ascontiguousarray(w.digest[keep, k])) for k in (0, 1)],
                names=["id", "key", "start", "stop", "before", "upto", "d1", "d2"],
            )

    return docs.select("id", "key", "text").mapInArrow(run, f"id {kind}, key long, start int, stop int, before int, upto int, d1 long, d2 long")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """(id, start, size, words, first_ids) of every passage that occurred before.

    ``start`` and ``size`` count bytes of UTF-8; ``first_ids`` has the ids, but null ones,
    that hold the first occurrences of its windows. Null and empty texts have no passages.
    Rows without an id come last in the order of occurrence. Rows that repeat an id, or
    have none, are told apart by their texts; two rows with one id and one text count as
    one. An empty table gives an empty result; other columns are ignored.
    """
    return _passages(docs, id_col, text_col, least_words).drop("__key")


def _passages(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """The passages, and in ``__key`` the hash of their text, or 0 where every row has an id of its own."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The hash goes with every chunk, so only where it is needed.
    unique = docs.groupBy("id").count().where("count > 1 or id is null").isEmpty()
    docs = docs.withColumn("key", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    slots = spark.sparkContext.broadcast(repeated_slots(docs.select("text"), _slot_bits(docs), least_words))
    maybe = cut(_maybe_repeated(docs, slots, least_words))
    groups = cut(
        maybe.groupBy("d1", "d2").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("d1", "d2", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start"), "n")
    )
    total = groups.agg(F.sum("n")).first()[0] or 1
    copies = join_groups(maybe, groups, ["d1", "d2"], "n", total).where(
        "first_start is not null and not (id <=> first_id and key = first_key and start = first_start)"
    )
    # Dealt out by row once, for what follows: repeated rows, runs and passages.
    dealt = copies.select("id", "key", "start", "stop", "before", "upto", "first_id").repartition("id", "key")
    order = Window.partitionBy("id", "key").orderBy("start")
    # A later window never ends before an earlier one.
    apart = F.coalesce(F.col("start") > F.lag("stop").over(order), F.lit(True)).cast("int")
    runs = dealt.dropDuplicates(["id", "key", "start"]).withColumn("apart", apart)
    runs = runs.withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = runs.groupBy("id", "key", "run").agg(
        F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("size"), (F.max("upto") - F.min("before")).alias("words"),
        F.array_sort(F.collect_set("first_id")).alias("first_ids"),
    )
    return found.select(F.col("id").alias(id_col), "start", "size", "words", "first_ids", F.col("key").alias("__key"))


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of their texts; other columns stay as they are, whatever their names.

    ``__key`` of the passages, if it is there and not 0, is the hash of the text that they
    belong to. Rows without passages, with null texts among them, pass through unchanged,
    and so do repeated rows; a text that is a passage as a whole becomes empty. An empty
    table gives an empty result.
    """
    names = docs.columns
    # Names of their own, as those of ``docs`` may be any.
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id, own_text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    key = F.col("__key") if "__key" in passages.columns else F.lit(0).cast("long")
    spans = passages.groupBy(F.col(id_col).alias("id"), key.alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"))
    joined = rows.join(spans, own_id.eqNullSafe(F.col("id")) & ((F.col("of") == 0) | (F.col("of") == F.xxhash64(own_text))), "left")

    @F.pandas_udf("string")
    def without(text, starts, sizes):
        import pandas as pd

        out = []
        for t, begins, lengths in zip(text, starts, sizes, strict=True):
            if begins is None or t is None:
                out.append(t)
                continue
            raw, last, kept = t.encode(), 0, []
            for a, n in zip(begins, lengths, strict=True):
                kept.append(raw[last:a])
                last = a + n
            out.append(b"".join([*kept, raw[last:]]).decode())
        return pd.Series(out, dtype=object)

    # One pass over the join: its two sides apart would shuffle the texts twice.
    cleaned = without(own_text, F.col("spans.start"), F.col("spans.size"))
    return joined.select(*[(cleaned if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages of :func:`repeated_passages`; what that says of odd rows holds here."""
    return remove_passages(docs, cut(_passages(docs, id_col, text_col, LEAST_WORDS)), id_col, text_col)
