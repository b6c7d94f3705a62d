"""Periodic runs of words, by the vocabulary of tandem repeats in a suffix tree.

A run is a stretch of words with a smallest period that no neighbouring word extends.
The way to all of them: blocks of a Lempel-Ziv decomposition give tandem repeats that
cover the leftmost occurrence of every kind of tandem repeat; these are located in a
suffix tree, and walks along suffix links find the rest of the vocabulary, each kind
once. The leaves below a kind are its occurrences, and occurrences of one period that
follow each other make a run. Tandem repeats of a shorter tandem repeat are left out
from the start, so the period of a run is its smallest.

Only runs of at least ``LEAST_EXPONENT`` periods and ``LEAST_LENGTH`` words are asked
for. In such a run every three neighbouring words occur three times, so words of a text
where no three do are passed over; this drops nothing but saves the tree of most texts.
What is left of the texts of a slice goes into one tree, with a separator of its own
behind each stretch, which no run can cross.

Common extensions of two places are found from the names that prefix doubling gives to
all stretches of 2**k words, so the whole takes n log n steps and 8 n log n bytes for n words in stretches.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import raw_texts, slices

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
_STEP = np.int64(-7046029254386353131)


class Names:
    """Names of all stretches of 2**k symbols: equal exactly if the stretches are. What runs past the end equals nothing else."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        first = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
        self.levels, width = [first.astype(np.int32)], 1
        while first.max(initial=0) < n:
            second = np.zeros(n, np.int64)
            if width < n:
                second[:-width] = first[width:]
            first = np.unique(first * (n + 1) + second, return_inverse=True)[1].astype(np.int64) + 1
            self.levels.append(first.astype(np.int32))
            width *= 2

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest stretch that begins at both of two different places."""
        i, j, n = i.copy(), j.copy(), self.n
        start = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            names = self.levels[level]
            inside = np.maximum(i, j) < n
            same = np.zeros(len(i), bool)
            same[inside] = names[i[inside]] == names[j[inside]]
            i[same] += 1 << level
            j[same] += 1 << level
        return i - start

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A pair of names, as one number, for each stretch; with its length it names it."""
        level = np.frexp(length.astype(float))[1] - 1
        out = np.zeros(len(start), np.int64)
        for k in np.unique(level):
            at, names = np.flatnonzero(level == k), self.levels[k].astype(np.int64)
            out[at] = names[start[at]] * (self.n + 1) + names[start[at] + length[at] - (1 << int(k))]
        return out


class SuffixTree:
    """Leaves are the places 0 to n - 1, the root is n. The last symbol must occur once."""

    def __init__(self, symbols: np.ndarray, names: Names):
        n = len(symbols)
        places = np.argsort(names.levels[-1], kind="stable")
        common = np.zeros(n, np.int64)
        common[1:] = names.extension(places[:-1], places[1:])
        depth, parent, least, left, right = [n - i for i in range(n)], [n] * n, list(range(n)), [0] * n, [0] * n
        depth.append(0)
        parent.append(n)
        least.append(n)
        left.append(0)
        right.append(n)
        stack = [n]
        for k, (place, shared) in enumerate([*zip(places.tolist(), common.tolist(), strict=True), (None, 0)]):
            while depth[stack[-1]] > shared:
                v = stack.pop()
                right[v] = k
                if depth[stack[-1]] < shared:
                    w = len(depth)
                    depth.append(shared)
                    parent.append(n)
                    least.append(least[v])
                    left.append(left[v])
                    right.append(k)
                    stack.append(w)
                u = stack[-1]
                parent[v] = u
                if least[v] < least[u]:
                    least[u] = least[v]
            if place is not None:
                left[place] = k
                stack.append(place)
        self.n, self.places = n, places
        self.depth, self.parent, self.least = np.array(depth), np.array(parent), np.array(least)
        self.left, self.right = np.array(left), np.array(right)
        self.symbols, self.size = symbols, int(symbols.max()) + 1
        self._link(names)
        below = np.flatnonzero(np.arange(len(depth)) != n)
        key = self.parent[below] * self.size + symbols[self.least[below] + self.depth[self.parent[below]]]
        order = np.argsort(key)
        self.keys, self.children = array("q", key[order].tobytes()), array("q", below[order].tobytes())

    def _link(self, names: Names) -> None:
        """The suffix link of each inner node: the node without the first symbol."""
        inner = np.arange(self.n + 1, len(self.depth))
        deep = inner[self.depth[inner] > 1]
        mine = names.of(self.least[inner], self.depth[inner])
        _, number = np.unique(np.r_[mine, names.of(self.least[deep] + 1, self.depth[deep] - 1)], return_inverse=True)
        have = number[: len(inner)] * (self.n + 1) + self.depth[inner]
        want = number[len(inner) :] * (self.n + 1) + self.depth[deep] - 1
        # Those of one symbol link to the root.
        self.links = np.full(len(self.depth), self.n)
        order = np.argsort(have)
        if len(deep):
            self.links[deep] = inner[order[np.searchsorted(have[order], want)]]

    def previous(self) -> np.ndarray:
        """For each place, how long a stretch begins there that also begins before it."""
        out = np.zeros(self.n, np.int64)
        new = np.flatnonzero(self.least[self.parent] != self.least)
        out[self.least[new]] = self.depth[self.parent[new]]
        return out


def _primitive(starts: np.ndarray, periods: np.ndarray, names: Names) -> np.ndarray:
    """Which tandem repeats (start, period) repeat nothing shorter than their period."""
    most = int(periods.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    good, rest = np.ones(len(starts), bool), periods.copy()
    while (open_ := np.flatnonzero((rest > 1) & good)).size:
        p = factor[rest[open_]]
        shorter = periods[open_] // p
        good[open_] = names.extension(starts[open_], starts[open_] + shorter) < 2 * periods[open_] - shorter
        rest[open_] //= p
    return good


def covering(symbols: np.ndarray, names: Names, tree: SuffixTree, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of primitive tandem repeats, periods up to ``most``, that cover the leftmost one of each kind.

    A kind is covered if its leftmost occurrence is among those that follow a given one
    of its length, each one symbol later. Such an occurrence ends in a later block than it
    begins: it has its middle in the block and either crosses its end or its beginning.
    """
    n, longest = len(symbols), tree.previous().tolist()
    begin, at = [], 0
    while at < n:
        begin.append(at)
        at += max(1, longest[at])
    begin = np.array([*begin, n, n])
    h, h1, h2 = begin[:-2], begin[1:-1], begin[2:]
    back = Names(symbols[::-1])

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest stretch that ends just before both places."""
        out = np.zeros(len(i), np.int64)
        ok = (i > 0) & (j > 0)
        out[ok] = back.extension(n - i[ok], n - j[ok])
        return out

    starts, periods = [], []
    for anchor, widest, sign in ((h1, h1 - h, -1), (h, h2 - h, 1)):
        widest = np.minimum(widest, most)
        anchor = np.repeat(anchor, widest)
        k = np.arange(len(anchor)) - np.repeat(np.cumsum(widest) - widest, widest) + 1
        other = anchor + sign * k
        ok = (other >= 0) & (np.maximum(anchor, other) < n)
        anchor, other, k = anchor[ok], other[ok], k[ok]
        onward, behind = names.extension(anchor, other), before(anchor, other)
        hit = (onward + behind >= k) & (onward > 0)
        one = np.minimum(anchor, other)[hit]
        starts.append(np.maximum(one - behind[hit], one - k[hit] + 1))
        periods.append(k[hit])
    both = np.unique(np.c_[np.concatenate(starts), np.concatenate(periods)], axis=0)
    good = _primitive(both[:, 0], both[:, 1], names)
    return both[good, 0], both[good, 1]


def vocabulary(tree: SuffixTree, starts: np.ndarray, periods: np.ndarray) -> set[tuple[int, int]]:
    """(node, period): each kind of tandem repeat once, by the node at or next below its end in the tree."""
    depth, parent, least = (array("q", x.astype(np.int64).tobytes()) for x in (tree.depth, tree.parent, tree.least))
    links, symbols = array("q", tree.links.astype(np.int64).tobytes()), array("q", tree.symbols.astype(np.int64).tobytes())
    keys, children, size, root = tree.keys, tree.children, tree.size, tree.n

    def child(node: int, symbol: int) -> int:
        key = node * size + symbol
        at = bisect_left(keys, key)
        return children[at] if at < len(keys) and keys[at] == key else -1

    found: set[tuple[int, int]] = set()
    order = np.lexsort((-periods, starts))
    starts, periods = starts[order].tolist(), periods[order].tolist()
    a = 0
    while a < len(starts):
        place, b = starts[a], a
        while b < len(starts) and starts[b] == place:
            b += 1
        # Up from the leaf as long as this is the leftmost occurrence; longer ones end lower.
        v = place
        while a < b and least[v] == place:
            while a < b and 2 * periods[a] > depth[parent[v]]:
                _walk(v, periods[a], found, depth, parent, least, links, symbols, child, root)
                a += 1
            v = parent[v]
        a = b
    return found


def _walk(v, period, found, depth, parent, least, links, symbols, child, root) -> None:
    """Adds a kind and all that follow it by moving its first symbol behind its last, as far as the tree has them."""
    length = 2 * period
    while v >= 0 and (v, period) not in found:
        found.add((v, period))
        place, u = least[v], parent[v]
        # What is left without the first symbol: by the link of the node above, then down by whole edges.
        at = links[u] if u != root else root
        node = at
        while depth[node] < length - 1:
            at, node = node, child(node, symbols[place + 1 + depth[node]])
        if depth[node] == length - 1:
            v = child(node, symbols[place])
        else:
            v = node if symbols[least[node] + length - 1] == symbols[place] else -1


def runs_of(symbols: np.ndarray, most: int) -> np.ndarray:
    """(start, length, period) of the runs of at least ``LEAST_EXPONENT`` periods of at most ``most``, by start, then period; the last symbol occurs once."""
    names = Names(symbols)
    tree = SuffixTree(symbols, names)
    starts, periods = covering(symbols, names, tree, most)
    kinds = np.array(sorted(vocabulary(tree, starts, periods)), np.int64).reshape(-1, 2)
    size = tree.right[kinds[:, 0]] - tree.left[kinds[:, 0]]
    rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(tree.left[kinds[:, 0]], size)
    place, period = tree.places[rank], np.repeat(kinds[:, 1], size)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    if not len(place):
        return np.zeros((0, 3), np.int64)
    new = np.r_[True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    runs = np.c_[place[first], place[last] - place[first] + 2 * period[first], period[first]]
    runs = runs[runs[:, 1] >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(hashed: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of words, given as hashes, in which any three neighbours occur three times in the text."""
    three, text, at = [], [], []
    for k, h in enumerate(hashed):
        if len(h) >= LEAST_LENGTH:
            three.append(((h[:-2] * _STEP + h[1:-1]) * _STEP + h[2:]) * _STEP + k)
            text.append(np.full(len(h) - 2, k))
            at.append(np.arange(len(h) - 2))
    if not three:
        return []
    _, inverse, counts = np.unique(np.concatenate(three), return_inverse=True, return_counts=True)
    good = np.flatnonzero(counts[inverse] >= 3)
    text, at = np.concatenate(text)[good], np.concatenate(at)[good]
    if not len(good):
        return []
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[first[1:], len(good)] - 1
    rows = zip(text[first].tolist(), at[first].tolist(), (at[last] + 3).tolist(), strict=True)
    return [r for r in rows if r[2] - r[1] >= LEAST_LENGTH]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = stretches([np.fromiter(map(hash, words), np.int64, len(words)) for words in texts])
    if not parts:
        return out
    known: dict[bytes, int] = {}
    symbols, begin = [], []
    for k, a, b in parts:
        begin.append(len(symbols))
        symbols.extend(known.setdefault(w, len(known)) for w in texts[k][a:b])
        symbols.append(-len(begin))
    flat = np.array(symbols, np.int64)
    flat[flat < 0] = len(known) - 1 - flat[flat < 0]
    runs = runs_of(flat, max(b - a for _, a, b in parts) // LEAST_EXPONENT)
    owner = np.searchsorted(np.array(begin), runs[:, 0], side="right") - 1
    for (start, length, period), o in zip(runs.tolist(), owner.tolist(), strict=True):
        k, a, _ = parts[o]
        out[k].append((start - begin[o] + a, length, period))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


KINDS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def mark_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, runs (start, length, period), strongest and collapsed.

    A text is split at ASCII white space, words are numbered from 0, and ``rewrite`` may
    change the words of a row by its id. A run has a smallest period q and
    at least max(6, 4 q) words. Runs are in order of start, then period; strongest is the
    one with the most periods (of equals the first), null without runs. collapsed has the
    words that no run contains after its first q, with a space between. Null and empty
    texts have no runs and collapse to an empty text; rows alike are marked alike, ids
    may be null or repeat, other columns are ignored, and an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = [t.split() for t in raw_texts(part, "text")]
            if rewrite is not None:
                words = [rewrite(i, w) for i, w in zip(part.column("id").to_pylist(), words, strict=True)]
            runs = runs_of_texts(words)
            best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else None for r in runs]
            named = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs]
            top = [None if x is None else dict(zip(("start", "length", "period"), x, strict=True)) for x in best]
            collapsed = pa.array([b" ".join(without_repeats(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(named, KINDS), pa.array(top, KINDS.value_type), collapsed], names=["id", "runs", "strongest", "collapsed"]
            )

    one = "struct<start: long, length: long, period: long>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, runs array<{one}>, strongest {one}, collapsed string").withColumnRenamed("id", id_col)
