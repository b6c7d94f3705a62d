"""Toxicity by a lexicon that tolerates misspellings, with regard to quotation.

The lexicon is a trie of terms and of stems (beginnings of words). Terms and stems of at
least ``FUZZY_FROM`` letters also match at one edit: a letter more, less or changed, or two
neighbours swapped. Shorter ones of at least ``SHORT_FROM`` letters match at a swap, or
where a sign or digit stands for a letter, which other words hardly do. Trie and
Levenshtein automata are intersected into one automaton whose states are built as words
reach them, so a word is read once, and left as soon as no term can match it. Each match
is weighed by the words around it: between quotation marks, or near words of reporting, it
counts for less. A logistic model makes one probability of the weighed matches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import slices, texts

FUZZY_FROM, SHORT_FROM = 5, 4
WINDOW = 8
#: Letters of the beginnings that may be stems. A longer beginning starts with one of these; words are terms at any length.
STEM_LETTERS = (3, 9)
#: Words that tell of speech rather than speak, in en, es, fr and de.
REPORTING = frozenset(
    "said says say quote quoted quotes wrote writes called term word dijo dice cita palabra llamado"
    " dit disait cite citation mot sagte sagt zitat zitiert wort nannte".split()
)
#: Quotation marks and ends of paragraphs, and which open marks a mark closes.
MARK = re.compile(r"[\"“”«»„]|\n[^\S\n]*\n")
CLOSES = {'"': '"„', "“": "„", "”": "“„”", "«": "»", "»": "«»"}
QUOTED_LINE = re.compile(r"^>[^\n]*", re.MULTILINE)
#: Letters and digits, and signs within a word that may stand for letters.
WORD = re.compile(r"[^\W_](?:[*@$!]?[^\W_])*")
FEATURES = 5


def quotations(text: str) -> list[tuple[int, int]]:
    """Starts and ends of the quotations of a text, of any length within a paragraph, and of quoted lines."""
    out = [m.span() for m in QUOTED_LINE.finditer(text)]
    opened: list[tuple[int, str]] = []
    waiting: Counter[str] = Counter()

    for m in MARK.finditer(text):
        mark = m.group()
        if mark[0] == "\n":
            opened.clear()
            waiting.clear()
            continue
        closes = CLOSES.get(mark, "")
        if mark == '"' and not waiting['"'] and m.start() and not text[m.start() - 1].isspace():
            closes += "“"  # a plain mark behind a letter ends what a curly one began
        if not any(waiting[kind] for kind in closes):
            opened.append((m.start(), mark))
            waiting[mark] += 1
            continue
        while True:
            start, kind = opened.pop()
            waiting[kind] -= 1
            if kind in closes:
                break
        out.append((start, m.end()))
    return out


class Automaton:
    """The trie of a lexicon intersected with Levenshtein automata of one edit.

    A state is a set of positions (trie node, edits so far, letter that a swap still
    wants). ``EXACT`` and ``FUZZY`` say how a word matches; a word that runs into a stem
    matches whatever follows.
    """

    EXACT, FUZZY = 1, 2
    #: The node of words that have run into a stem with an edit.
    WITHIN = -1

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends, self.stems = [False], [False]
        # What edits may still lead to below a node: terms at any edit, terms at a swap or sign, stems likewise.
        self.any_edit, self.some_edit = [False], [False]
        for word, marks in [(t, self.ends) for t in terms] + [(s, self.stems) for s in stems]:
            node, path = 0, [0]
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    for table in (self.ends, self.stems, self.any_edit, self.some_edit):
                        table.append(False)
                node = self.children[node][letter]
                path.append(node)
            marks[node] = True
            for n in path:
                self.any_edit[n] |= len(word) >= FUZZY_FROM
                self.some_edit[n] |= len(word) >= SHORT_FROM
        self.length = [0] * len(self.children)
        for node, after in enumerate(self.children):
            for n in after.values():
                self.length[n] = self.length[node] + 1
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepts: list[int] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    # Edits of a position: 0 none, 1 a swap or a sign for a letter, 2 any other.
    def _open(self, node: int, edits: int) -> bool:
        return edits == 0 or (self.some_edit[node] if edits == 1 else self.any_edit[node])

    def _done(self, node: int, edits: int, table: list[bool]) -> bool:
        return table[node] and (edits == 0 or self.length[node] >= (SHORT_FROM if edits == 1 else FUZZY_FROM))

    def _closure(self, positions: set) -> frozenset:
        """With a letter of the term left out, at the price of an edit."""
        out = set(positions)
        for node, edits, want in positions:
            if edits == 0 and node != self.WITHIN:
                out.update((n, 2, "") for n in self.children[node].values() if self.any_edit[n])
        # Running into a stem with an edit settles all but an exact match.
        if any(node != self.WITHIN and not want and edits and self._done(node, edits, self.stems) for node, edits, want in out):
            out.add((self.WITHIN, 1, ""))
        return frozenset(p for p in out if p[1] == 0 or p[2] or (p[0], 0, "") not in out)

    def _state(self, positions: set) -> int:
        key = self._closure(positions)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            exact = any(e == 0 and n != self.WITHIN and self.ends[n] for n, e, _ in key)
            fuzzy = any(n == self.WITHIN or (not want and self._done(n, e, self.ends)) for n, e, want in key)
            # A term or stem whose last letter the word lacks.
            self.accepts.append(self.EXACT if exact else self.FUZZY if fuzzy else 0)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        """The next state; -1 if there is none, -2 if a stem is complete."""
        reached = set()
        for node, edits, want in self.sets[state]:
            if node == self.WITHIN:
                reached.add((node, 1, ""))
                continue
            after = self.children[node]
            if want:
                if letter == want:
                    reached.add((node, edits, ""))
                continue
            if (n := after.get(letter)) is not None:
                if edits == 0 and self.stems[n]:
                    return -2
                if self._open(n, edits):
                    reached.add((n, edits, ""))
            if edits == 0:
                if self.any_edit[node]:
                    reached.add((node, 2, ""))  # a letter too many
                kind = 2 if letter.isalpha() else 1
                reached.update((n, kind, "") for n in after.values() if self._open(n, kind))  # another letter
                for first, n in after.items():  # two letters the other way round
                    if first != letter and (m := self.children[n].get(letter)) is not None and self.some_edit[m]:
                        reached.add((m, 1, first))
        return self._state(reached) if reached else -1

    def match(self, word: str) -> int:
        state = self.start
        for letter in word:
            moves = self.moves[state]
            if (after := moves.get(letter)) is None:
                after = moves[letter] = self._move(state, letter)
            if after < 0:
                return self.EXACT if after == -2 else 0
            state = after
        return self.accepts[state]


@dataclass(frozen=True)
class Model:
    terms: list[str]
    stems: list[str]
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0


class Scorer:
    """Features and scores of texts; one for each worker."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms, model.stems)
        self.known: dict[str, int] = {}

    def features(self, text: str) -> np.ndarray:
        """Weighed and quoted matches, their density, misspelled ones, length."""
        words = WORD.findall(text.lower())
        known, match = self.known, self.automaton.match
        hits = []
        for i, word in enumerate(words):
            if (kind := known.get(word)) is None:
                kind = known[word] = match(word)
            if kind:
                hits.append((i, kind))
        if len(known) > 400_000:
            known.clear()
        if not hits:
            return np.array([0, 0, 0, 0, np.log1p(len(words))])
        lowered = text.lower()
        # How many quotations more, or fewer, each word is in than the one before.
        turns = np.zeros(len(words) + 1, np.int64)
        if spans := quotations(lowered):
            starts = np.array([m.start() for m in WORD.finditer(lowered)])
            at = np.searchsorted(starts, np.array(spans))
            np.add.at(turns, at[:, 0], 1)
            np.add.at(turns, at[:, 1], -1)
        quoted = np.cumsum(turns) > 0
        full = told = fuzzy = 0.0
        for i, kind in hits:
            around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            reported = bool(quoted[i]) or any(w in REPORTING for w in around)
            weight = (0.25 if reported else 1.0) * (0.7 if kind == Automaton.FUZZY else 1.0)
            full += weight
            told += reported
            fuzzy += kind == Automaton.FUZZY
        return np.array([np.log1p(full), np.log1p(told), 100 * full / (len(words) + 20), np.log1p(fuzzy), np.log1p(len(words))])

    def score(self, features: np.ndarray) -> float:
        x = float(np.dot(self.model.weights, features) + self.model.bias)
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _features_of(docs: DataFrame, model: Model, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    kinds = {c: docs.schema[c].dataType.simpleString() for c in [id_col, *carry]}
    schema = ", ".join(f"`__k{i}` {k}" for i, k in enumerate(kinds.values())) + ", features array<double>, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches, "text"):
            rows = [scorer.features(t) for t in texts(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column(f"__k{i}") for i in range(len(kinds))]
                + [pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), pa.array([scorer.score(r) for r in rows])],
                names=[*[f"__k{i}" for i in range(len(kinds))], "features", "score"],
            )

    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(kinds)], F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(kinds)], "features", "score"
    )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most_rows: int = 20_000, most_entries: int = 100_000) -> Model:
    """A model from labelled documents.

    ``labels`` has ids and 0/1 labels; rows with a null or without a document are left
    out. At most ``most_rows`` labelled rows, those whose hashed ids are smallest, are
    used. Words, or beginnings of ``STEM_LETTERS`` letters, that at least four toxic
    documents have and hardly any other are the lexicon: at most ``most_entries``, those
    that most toxic documents have. Both bound what is broadcast and what the driver
    receives. Without two classes the model has no lexicon and scores 0 and up.
    """
    used = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
        .dropDuplicates(["__id"])
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most_rows)
    )
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(used), "__id")

    least, most = STEM_LETTERS

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            seen: dict[tuple[str, int], int] = {}
            for text, label in zip(texts(part, "text"), part.column("label").to_pylist(), strict=True):
                words = set(WORD.findall(text.lower()))
                found = {w + "$" for w in words}
                found.update(w[:n] for w in words for n in range(least, min(len(w), most + 1)))
                for x in found:
                    seen[x, label] = seen.get((x, label), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for x, _ in seen], pa.string()),
                    pa.array([label for _, label in seen], pa.int32()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                names=["entry", "label", "n"],
            )

    counted = rows.select("text", "label").mapInArrow(beginnings, "entry string, label int, n long")
    sides = counted.groupBy("entry").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("clean"),
    )
    # A true term is hardly ever in a clean document.
    telling = sides.where("toxic >= 4 and clean * 8 <= toxic").orderBy(F.desc("toxic"), "entry").limit(most_entries)
    found = {r["entry"]: (r["toxic"], r["clean"]) for r in telling.collect()}
    terms, stems = choose_entries(found)
    model = Model(terms, stems)
    got = _features_of(rows, model, "__id", "text", ["label"]).select("label", "features").collect()
    if len({r["label"] for r in got}) < 2:
        return model
    x, y = np.array([r["features"] for r in got]), np.array([r["label"] for r in got], float)
    weights, bias = logistic(x, y)
    return Model(terms, stems, weights.tolist(), float(bias))


def choose_entries(found: dict[str, tuple[int, int]]) -> tuple[list[str], list[str]]:
    """Terms and stems: a beginning stands for its longer forms if no one word makes up most of it."""
    least, most = STEM_LETTERS
    #: Documents of the commonest whole word with each beginning.
    whole: dict[str, int] = {}
    for entry in found:
        if entry.endswith("$"):
            for n in range(least, min(len(entry) - 1, most) + 1):
                whole[entry[:n]] = max(whole.get(entry[:n], 0), found[entry][0])
    terms, stems = [], set()
    begins = lambda word: any(word[:n] in stems for n in range(least, min(len(word), most) + 1))
    for entry in sorted(found, key=lambda e: (len(e.rstrip("$")), e)):
        word = entry.removesuffix("$")
        if begins(word):
            continue
        if entry.endswith("$"):
            terms.append(word)
        elif whole.get(word, 0) < 0.7 * found[entry][0]:
            stems.add(word)
    return [t for t in terms if not begins(t)], sorted(stems)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = ridge * len(x) / 100 * np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, w[-1] - weights @ mean


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, score (0 to 1) and features.

    Whole texts are read; null counts as empty, and empty texts have a score too. Null
    and repeated ids are scored as any others; other columns are ignored.
    """
    return _features_of(docs, model, id_col, text_col, [])


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without those that score ``threshold`` or more.

    Null and empty texts have no matches and stay, unless the model finds even those
    toxic. Null and repeated ids are judged row by row; other columns stay as they are,
    whatever their names. An empty table gives an empty result.
    """
    named = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in named.items()])
    scored = _features_of(rows, model, "__d0", named[text_col], list(named.values())[1:])
    return scored.where(F.col("score") < threshold).select(*[F.col(n).alias(c) for c, n in named.items()])
