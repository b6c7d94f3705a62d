"""Labels of words by a scorer that takes sequences of sub-words of a bounded length.

A text has parts (pages, sentences), a part has words, and a word has sub-words. A part
with more sub-words than the scorer takes is cut into windows of whole words that overlap,
and each word takes its labels from the window in which it stands most inside. So what a scorer
says that looks no further than half an overlap is what it would say of the part unsplit.

All this is done in the row of the document, for all parts of a slice at once: no shuffle, and a
task holds a slice and one batch of windows, however long a text is.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import inrow, segments
from lamina.operators.inrow import Layer, Texts

#: Characters of a sub-word. A word of more than ``LONGEST`` of them is one sub-word, ``UNKNOWN``.
PIECE, LONGEST, UNKNOWN = 4, 25, 1
#: Classes of the first character of a sub-word.
LOWER, UPPER, DIGIT, OTHER = range(4)
#: Sub-words, padding too, that a scorer is given at once.
CELLS = 1 << 18


class Pieces(NamedTuple):
    """Sub-words of the words of a slice: how many each word has, and of each sub-word its id, characters and class."""

    count: np.ndarray
    ids: np.ndarray
    length: np.ndarray
    kind: np.ndarray


class Batch(NamedTuple):
    """What a scorer sees, a row for each window: sub-words, whether they begin a word, the word's place in its part, and what is no padding."""

    ids: np.ndarray
    length: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    word: np.ndarray
    mask: np.ndarray


Scorer = Callable[[Batch], np.ndarray]


def hashed_pieces(t: Texts, words: Layer) -> Pieces:
    """Stretches of ``PIECE`` characters, with a hash of their bytes for an id of at least 2."""
    n = words.end - words.start
    count = -(-n // PIECE)
    unknown = count > LONGEST
    count = np.where(unknown, 1, count)
    word = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    length = np.where(unknown[word], n[word], np.minimum(PIECE, n[word] - PIECE * k))
    at = np.r_[np.flatnonzero(t.lead), len(t.data)]
    begin = t.chars[words.a[word]] + PIECE * k
    a, b = at[begin], at[begin + length]
    ids = np.zeros(len(word), np.int64)
    going, place = np.arange(len(word)), a.copy()
    while len(going):
        ids[going] = (ids[going] * 257 + t.data[place] + 1) % ((1 << 31) - 3)
        place += 1
        more = place < b[going]
        going, place = going[more], place[more]
    return Pieces(count, np.where(unknown[word], UNKNOWN, ids + 2), length, _KIND[t.data[a]])


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.int8)
    for (a, b), k in ((b"az", LOWER), (b"AZ", UPPER), (b"09", DIGIT)):
        kind[a : b + 1] = k
    return kind


_KIND = _kinds()


def cut(count: np.ndarray, part: np.ndarray, room: int, overlap: int) -> tuple[np.ndarray, ...]:
    """Windows over words in order, each of ``count`` sub-words: first word, word behind the last, and the same of the words it labels.

    A window has at most ``room`` sub-words, or one word; the next one begins at most ``overlap``
    before its end. Words that are in two are labelled by the one whose edge is farther away, the earlier if both are as far.
    """
    total = np.r_[0, np.cumsum(count)]
    middle = total[:-1] + total[1:]
    ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1 if len(part) else np.zeros(0, np.int64)
    begin, limit = np.r_[0, ends[:-1]] if len(ends) else ends, ends
    own = begin.copy()
    rows = []
    while len(begin):
        end = np.clip(np.searchsorted(total, total[begin] + room, side="right") - 1, begin + 1, limit)
        more = end < limit
        following = np.clip(np.searchsorted(total, total[end] - overlap), begin + 1, end)
        split = np.clip(np.searchsorted(middle, total[end] + total[following], side="right"), following, end)
        upto = np.where(more, np.maximum(split, own), limit)
        rows.append((begin, end, own, upto))
        begin, own, limit = following[more], upto[more], limit[more]
    return tuple(np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(4))


def score_pieces(pieces: Pieces, word: np.ndarray, part: np.ndarray, scorer: Scorer, size: int, overlap: int) -> np.ndarray:
    """A label for each sub-word. ``word`` is the place of each word in its part; a window leaves room for two marks at its ends."""
    begin, end, own, upto = cut(pieces.count, part, size - 2, overlap)
    total = np.r_[0, np.cumsum(pieces.count)]
    first = np.zeros(total[-1], bool)
    first[total[:-1]] = True
    of = np.repeat(word, pieces.count)
    a, n = total[begin], total[end] - total[begin]
    out = np.zeros(total[-1], np.int8)
    order = np.argsort(-n, kind="stable")
    at = 0
    while at < len(order):
        width = int(n[order[at]])
        w = order[at : at + max(1, CELLS // width)]
        at += len(w)
        mask = np.arange(width) < n[w, None]
        place = np.where(mask, a[w, None] + np.arange(width), 0)
        given = [np.where(mask, x[place], 0) for x in (pieces.ids, pieces.length, pieces.kind, first)]
        labels = scorer(Batch(*given, np.where(mask, of[place], -1), mask))
        keep = mask & (place >= total[own[w], None]) & (place < total[upto[w], None])
        out[place[keep]] = labels[keep]
    return out


def whole(t: Texts) -> Layer:
    """Each text as one part."""
    return t.layer(t.bounds[:-1], t.bounds[1:], np.arange(len(t.bounds) - 1))


def pages(t: Texts) -> Layer:
    return inrow.pages(t.rows())[0]


def label_words(docs: DataFrame, scorer: Scorer, parts: Callable[[Texts], Layer] = whole, words: Callable[[Texts], Layer] = Texts.tokens,
                split: Callable[[Texts, Layer], Pieces] = hashed_pieces, size: int = 512, overlap: int = 128) -> DataFrame:
    """Parts with a word at least: doc_id, part, start, text, starts, ends, labels.

    ``starts`` and ``ends`` are those of the words, from the start of the part; ``labels`` has for
    each word those of its sub-words, numbers as the scorer gives them. Words that are in no part are left out. Null
    texts have no words; null ids and repeated rows pass through; other columns are ignored.
    """
    if not 0 <= overlap <= (size - 2) // 2:
        raise ValueError(f"windows of {size} can't overlap by {overlap}")

    def make(t: Texts) -> tuple[np.ndarray, list]:
        parted, found = parts(t), words(t)
        at, n = inrow.meet(found, parted)
        held = np.flatnonzero(n)
        found, at = Layer(*[x[held] for x in found]), at[held]
        pieces = split(t, found)
        opens = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        ends = np.r_[opens[1:], len(at)] if len(at) else at
        word = np.arange(len(at)) - np.repeat(opens, ends - opens)
        labels = score_pieces(pieces, word, at, scorer, size, overlap)
        p = at[opens]
        base = parted.start[at]
        by_word = _lists(np.cumsum(pieces.count), pa.array(labels))
        return parted.owner[p], [
            parted.pos[p], parted.start[p], t.gathered(parted.a[p], parted.b[p]), _lists(ends, pa.array((found.start - base).astype(np.int32))),
            _lists(ends, pa.array((found.end - base).astype(np.int32))), _lists(ends, by_word),
        ]

    schema = "part bigint, start bigint, text string, starts array<int>, ends array<int>, labels array<array<tinyint>>"
    return inrow.over_texts(docs, schema, make)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)


def by_word(batch: Batch, label: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Labels of sub-words from those of their words; ``label`` takes the rows and columns of the first sub-words, in order."""
    row, column = np.nonzero(batch.first & batch.mask)
    labels = np.zeros(batch.ids.shape, np.int64)
    row_of, column_of = np.nonzero(batch.mask)
    labels[row_of, column_of] = label(row, column)[np.cumsum((batch.first & batch.mask)[row_of, column_of]) - 1]
    return labels


#: Labels of mentions, numbered from 0.
MENTION = ("O", "B", "I", "L", "U")


def rule_mentions(batch: Batch) -> np.ndarray:
    """A rule in place of a trained model: stretches of words that begin with a capital, all sub-words with the label of their word."""

    def label(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        capital = batch.kind[row, column] == UPPER
        same = row[1:] == row[:-1]
        before = np.r_[False, capital[:-1] & same]
        behind = np.r_[capital[1:] & same, False]
        return np.select([~capital, before & behind, before, behind], [0, 2, 3, 1], 4)

    return by_word(batch, label)


def mentions(labelled: DataFrame, keep_first: bool = False) -> DataFrame:
    """Mentions in labelled words: doc_id, pos, part, first, last (words), n, start, end.

    The labels of a word's sub-words become one as :func:`segments.word_label` has it, and those of
    words spans as :func:`segments.bilou_spans` has it. Words outside never leave the row of their text.
    """
    words = F.posexplode(F.arrays_zip("starts", "ends", "labels")).alias("word", "w")
    named = lambda x: F.element_at(F.array(*map(F.lit, MENTION)), x + 1)
    rows = labelled.select("doc_id", "part", "start", words).select(
        "doc_id", "part", "word", (F.col("start") + F.col("w.starts")).alias("start"), (F.col("start") + F.col("w.ends")).alias("end"),
        segments.word_label(F.transform("w.labels", lambda x: named(x.cast("int")))).alias("label"),
    )
    inside = rows.where("label <> 'O'" if keep_first else "label <> 'O' and word > 0")
    spans = segments.bilou_spans(inside, ["doc_id", "part"], "word", True, (F.min("start").alias("start"), F.max("end").alias("end")))
    return segments.renumber(spans, ["doc_id"], ["part", "first"]).drop("span")
