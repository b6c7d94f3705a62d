"""Byte-level BPE by speculation and verification.

Each distinct word of a batch is first cut greedily into longest vocabulary entries. A
sequence of tokens is what BPE would make if, and only if, every two neighbours are what
BPE would make of their joined bytes; that is tested for all distinct neighbours of the
batch at once in numpy, by undoing merges from the border outwards. Words with a failing
pair, and only those, are merged exactly, all of them together, lowest rank first; very
long ones one by one, with a heap.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import slices, texts

#: White space as the vocabularies have it. Python's own class has U+001C to U+001F too.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The split that byte-level vocabularies of this kind were made with.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for a lower-case vocabulary that drops white space.
LOWER_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: A border between a non-space and a space is always one between words.
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SOLID = re.compile(f"[^{SPACE}]+")
#: Runs whose ids a worker keeps before it drops those that it has not met again since it last dropped some.
CACHE = 300_000
#: What often stands behind a word; a border between letters and such a mark is always one between words.
MARKS = frozenset(".,;:!?")
#: Bytes of text that are encoded together.
SLICE = 2 << 20
#: Longer words are cut and merged one by one: side by side costs a pass over all words for each byte of the longest.
LONG = 256
NONE = -1
FAR = np.int64(1) << 40
#: Not a byte of UTF-8.
END = b"\xff\xff\xff"


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _cut(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Consecutive stretches of ``tokens`` as little-endian unsigned 32-bit integers."""
    raw = tokens.astype("<u4").tobytes()
    ends = (4 * np.cumsum(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Index:
    """Distinct integers by hash bucket; several are found at once with few reads each."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        bucket = self._bucket(keys)
        self.order = np.argsort(bucket, kind="stable")
        self.keys = keys[self.order]
        self.starts = np.searchsorted(bucket[self.order], np.arange((1 << self.BITS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max())

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each among ``keys``, and whether it is there."""
        bucket = self._bucket(wanted)
        at = self.starts[bucket].astype(np.int64)
        there = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted
        size = self.starts[bucket + 1] - at
        for depth in range(1, self.deepest):
            rest = np.flatnonzero(~there & (size > depth))
            if not len(rest):
                break
            hit = rest[self.keys[at[rest] + depth] == wanted[rest]]
            at[hit] += depth
            there[hit] = True
        return np.minimum(at, len(self.keys) - 1), there


class Bpe:
    """A vocabulary file, ready to encode and decode."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        letters = _byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        ended = lambda token: bool(suffix) and token.endswith(suffix)

        def as_bytes(token: str) -> bytes:
            """Its bytes; one more marks an end of word."""
            return bytes(letters[c] for c in token.removesuffix(suffix)) + END * ended(token)

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.longest = max(map(len, self.ids))
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.last_id = np.array([self.ids[bytes([b]) + END * bool(suffix)] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.ids[as_bytes(a)] for a, _ in pairs], np.int64)
        right = np.array([self.ids[as_bytes(b)] for _, b in pairs], np.int64)
        made = np.array([self.ids[as_bytes(a) + as_bytes(b)] for a, b in pairs], np.int64)
        self.pairs = Index(left * self.size + right)
        self.rank_at, self.made_at = self.pairs.order, made[self.pairs.order]
        # The merge that makes each token, and its rank; bytes have neither.
        self.rank = np.full(self.size, NONE, np.int64)
        self.left = np.full(self.size, NONE, np.int64)
        self.right = np.full(self.size, NONE, np.int64)
        self.rank[made[::-1]] = np.arange(len(pairs))[::-1]
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        self.splitter = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        # A token that its own merges don't lead to can't be proposed.
        tokens = list(self.ids)
        alone = (len(got) == 4 for got in self.merge(tokens))
        self.usable = {t: self.ids[t] for t, a in zip(tokens, alone, strict=True) if a}
        self._plant()
        self.content, self.letters = content, letters
        self.new: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}
        self.proposed = self.failed = 0

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the merge of each pair, and whether there is one."""
        return self.pairs.find(a * self.size + b)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of tokens as it is when their bytes stand together.

        A merge across the border is made if it ranks before the merge that BPE makes
        next on either side of it; sides are undone latest merge first.
        """
        good = np.ones(len(a), bool)
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), FAR)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at, there = self._find(x, y)
            wrong = there & (self.rank_at[at] < limit[live])
            good[live[wrong]] = False
            rx, ry = self.rank[x], self.rank[y]
            over = wrong | ((rx < 0) & (ry < 0))
            undo_left = rx > ry
            # At equal ranks both sides are the same token; the left one merges first, so
            # the right one is the later.
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~over]
        return good

    def _letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of single bytes, the last one of a word with ``END`` another, and whose they are."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        plain = raw != END[0]
        letter, own = raw[plain], word[plain]
        tokens = self.byte_id[letter]
        ended = np.unique(word[~plain])
        last = np.searchsorted(own, ended, side="right") - 1
        tokens[last] = self.last_id[letter[last]]
        return tokens, own

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Exact merging: in every word, the leftmost of its lowest-ranked pairs, again and again."""
        if not words:
            return []
        tokens, word = self._letters(words)
        done_tokens, done_words = [], []
        at, rank = self._ranks(tokens[:-1], tokens[1:], word[:-1] == word[1:])
        while len(tokens):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(tokens)])
            # The place of a word's last token has a rank of none.
            rank = np.r_[rank, FAR][: len(tokens)]
            lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
            idle = lowest == FAR
            done_tokens.append(tokens[idle])
            done_words.append(word[idle])
            spots = np.flatnonzero(~idle & (rank == lowest))
            # Pairs of one rank can overlap only as in "aaa": then every second one, from the left, merges.
            if len(spots):
                begins = np.r_[True, np.diff(spots) > 1]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(spots)), 0))
                spots = spots[(np.arange(len(spots)) - run) % 2 == 0]
            tokens = tokens.copy()
            tokens[spots] = self.made_at[at[spots]]
            keep = ~idle
            keep[spots + 1] = False
            merged = np.zeros(len(tokens), bool)
            merged[spots] = True
            tokens, word, at, rank, merged = tokens[keep], word[keep], np.r_[at, 0][: len(keep)][keep], rank[keep], merged[keep]
            # Only pairs next to a merge are new.
            new = np.flatnonzero(merged | np.r_[merged[1:], False])
            new = new[new < len(tokens) - 1]
            at[new], rank[new] = self._ranks(tokens[new], tokens[new + 1], word[new] == word[new + 1])
            if len(rank):
                rank[-1] = FAR
        tokens, word = np.concatenate(done_tokens or [tokens]), np.concatenate(done_words or [word])
        order = np.argsort(word, kind="stable")
        return _cut(tokens[order], np.bincount(word, minlength=len(words)))

    def _ranks(self, a: np.ndarray, b: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = self._find(a, b)
        return at, np.where(there & together, self.rank_at[at], FAR)

    def _plant(self) -> None:
        """A trie of the usable tokens: sorted (node, byte) keys, the node each leads to, its token."""
        nodes: dict[bytes, int] = {b"": 0}
        for token in self.usable:
            for stop in range(1, len(token) + 1):
                nodes.setdefault(token[:stop], len(nodes))
        node_of = np.fromiter((nodes[n[:-1]] * 256 + n[-1] for n in nodes if n), np.int64, len(nodes) - 1)
        self.steps = Index(node_of)
        self.step_to = self.steps.order + 1
        self.token_at = np.array([self.usable.get(n, NONE) for n in nodes], np.int64)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side: tokens, how many each word has, and words that no tokens cover."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        end = np.cumsum(lengths)
        word = np.flatnonzero(lengths)
        at, end = (end - lengths)[word], end[word]
        node, best, best_end = np.zeros_like(at), np.full_like(at, NONE), at.copy()
        tokens, owners, stray = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(word):
            spot, there = self.steps.find(node * 256 + text[at])
            went = (at < end) & there
            node = np.where(went, self.step_to[spot], 0)
            at = at + went
            token = np.where(went, self.token_at[node], NONE)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            stuck = ~went
            lost = stuck & (best == NONE)
            stray.append(word[lost])
            tokens.append(best[stuck & ~lost])
            owners.append(word[stuck & ~lost])
            at, best = np.where(stuck, best_end, at), np.where(stuck, NONE, best)
            live = (went | (at < end)) & ~lost
            word, at, end, node, best, best_end = (x[live] for x in (word, at, end, node, best, best_end))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(tokens)[order], np.bincount(owner, minlength=len(words)), np.concatenate(stray)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        short = words if not long else [w if len(w) <= LONG else b"" for w in words]
        flat, sizes, stray = self.propose(short)
        bad = np.union1d(self._doubtful(flat, np.repeat(np.arange(len(words)), sizes)), stray).astype(np.int64)
        out = _cut(flat, sizes)
        self.proposed += len(words)
        self.failed += len(bad)
        for i, tokens in zip(bad.tolist(), self.merge([words[i] for i in bad.tolist()]), strict=True):
            out[i] = tokens
        for i in long:
            out[i] = self._encode_long(words[i])
        return out

    def _doubtful(self, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Words with two neighbours that BPE would not leave as they are."""
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        keys, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[back]
        return np.unique(owner[inside[~good]])

    def _encode_long(self, word: bytes) -> bytes:
        """The same for one word: propose, verify, and else merge with a heap of pairs, lowest rank and place first."""
        if not self.walk:
            self.walk = dict(zip(self.steps.keys.tolist(), self.step_to.tolist(), strict=True))
            self.merges = dict(zip(self.pairs.keys.tolist(), zip(self.rank_at.tolist(), self.made_at.tolist(), strict=True), strict=True))
        token_at, at, proposed = self.token_at, 0, []
        while at < len(word):
            node, end, best, stop = 0, at, NONE, at
            while end < len(word) and (node := self.walk.get(node * 256 + word[end], 0)):
                end += 1
                if (token := token_at[node]) >= 0:
                    best, stop = token, end
            if best == NONE:
                break
            proposed.append(best)
            at = stop
        flat = np.array(proposed, np.int64)
        if at == len(word) and not len(self._doubtful(flat, np.zeros(len(flat), np.int64))):
            return flat.astype("<u4").tobytes()
        tokens = self._letters([word])[0].tolist()
        before, after = list(range(-1, len(tokens) - 1)), list(range(1, len(tokens) + 1))
        size, merges = self.size, self.merges
        heap = [(m[0], i, a, b, m[1]) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if (m := merges.get(a * size + b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= len(tokens) or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = made, NONE, after[j]
            if after[j] < len(tokens):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(tokens) and (m := merges.get(tokens[x] * size + tokens[y])):
                    heapq.heappush(heap, (m[0], x, tokens[x], tokens[y], m[1]))
        return np.array([t for t in tokens if t != NONE], "<u4").tobytes()

    end = b""

    def is_word(self, run: str) -> bool:
        return run.isalpha() or (run[0] == " " and run[1:].isalpha())

    def words(self, run: str) -> list[bytes]:
        return [w.encode() for w in WORDS.findall(run)]

    def runs(self, text: str) -> list[str | bytes]:
        """Parts of a text that are encoded by themselves; bytes are words already."""
        return self._by_library(text) if _has_unassigned(text) else RUNS.findall(text)

    def _by_library(self, text: str) -> list[bytes]:
        """Words of a text with characters that Python's tables don't know, by the tables of the tokenizers library."""
        from tokenizers import Tokenizer

        if self.splits is None:
            self.splits = Tokenizer.from_str(self.content)
        if self.splits.normalizer is not None:
            text = self.splits.normalizer.normalize_str(text)
        return [bytes(map(self.letters.__getitem__, w)) for w, _ in self.splits.pre_tokenizer.pre_tokenize_str(text)]

    splits = None
    walk: dict[int, int] = {}

    def _learn(self, runs: set[str | bytes]) -> None:
        """Puts the ids of runs that are not known yet into the cache."""
        is_word, new, old = self.is_word, self.new, self.old
        alone, marked, rest = {}, [], []
        for r in runs:
            if isinstance(r, bytes):
                rest.append((r, [r]))
            elif is_word(r):
                alone[r] = None
            elif len(r) > 1 and r[-1] in MARKS and is_word(r[:-1]):
                marked.append(r)
            else:
                rest.append((r, self.words(r)))
        for r in marked:
            word = r[:-1]
            if word not in new:
                if (known := old.get(word)) is None:
                    alone[word] = None
                else:
                    new[word] = known
        alone.update(dict.fromkeys({r[-1] for r in marked}.difference(new)))
        # The bytes of all runs that are one word, without a step for each.
        distinct = "\n".join(alone).encode().replace(b"\n", self.end + b"\n").split(b"\n") if alone else []
        if alone:
            distinct[-1] += self.end
        named = len(distinct)
        distinct += dict.fromkeys([w for _, words in rest for w in words])
        ids = self.encode_words(distinct)
        new.update(zip(alone, ids, strict=False))
        of = dict(zip(distinct[named:], ids[named:], strict=True))
        for run, words in rest:
            new[run] = of[words[0]] if len(words) == 1 else b"".join([of[w] for w in words])
        for r in marked:
            new[r] = new[r[:-1]] + new[r[-1]]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._pieces(t) for t in batch]
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        for token, i in self.special.items():
            new[token] = np.array([i], "<u4").tobytes()
        unmet = set().union(*split).difference(new)
        again = unmet.intersection(old)
        new.update(zip(again, map(old.__getitem__, again), strict=True))
        self._learn(unmet.difference(again))
        return [b"".join(map(new.__getitem__, runs)) for runs in split]

    def _pieces(self, text: str) -> list[str | bytes]:
        """Runs, with each special token apart."""
        if not any(token in text for token in self.special):
            return self.runs(text)
        out: list[str | bytes] = []
        for part in self.splitter.split(text):
            out += [part] if part in self.special else self.runs(part)
        return out

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


class WordBpe(Bpe):
    """BPE with ends of words, lower case and without white space."""

    end = END

    def is_word(self, run: str) -> bool:
        return run.isalpha()

    def words(self, run: str) -> list[bytes]:
        return [w.encode() + END for w in LOWER_WORDS.findall(run)]

    def runs(self, text: str) -> list[str | bytes]:
        if text.isascii():
            text = text.lower()
        elif _has_unassigned(text):
            return [w + END for w in self._by_library(text)]
        else:
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return SOLID.findall(text) if SEPARATORS.search(text) else text.split()


def _has_unassigned(text: str) -> bool:
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


@lru_cache(maxsize=2)
def load(content: str) -> Bpe:
    """The vocabulary of a tokenizers file with a byte-level BPE model."""
    return (WordBpe if json.loads(content)["model"].get("end_of_word_suffix") else Bpe)(content)


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True
) -> DataFrame:
    """Ids of every whole text, and the text that they decode to.

    ``vocabulary`` is the content of a byte-level BPE file; it goes to the tasks inside
    the function, so workers need no such file. Returns one row per row of ``docs``:
    the id, ``ids`` (binary, little-endian unsigned 32-bit) and, with ``decode``,
    ``decoded``. Null texts count as empty and have no ids; null ids of documents and
    repeated rows pass through; other columns are ignored. Special tokens that stand in
    a text are encoded as such and decoded to the same string.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for part in slices(batches, "text", SLICE):
            ids = bpe.encode(texts(part, "text"))
            columns = [part.column("id"), pa.array(ids, pa.binary())]
            names = [id_col, "ids"]
            if decode:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind}, ids binary" + ", decoded string" * decode
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

