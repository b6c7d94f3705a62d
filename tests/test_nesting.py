"""Nesting of sections against a walk over one section and one candidate at a time."""

import random
import re

import numpy as np
import pytest

from lamina.operators import nesting

SCHEMA = "doc_id long, pos long, text string, font string, size double, page long, l double, t double, n_pages long, number string"
WORDS = ["Introduction", "Methods.", "A Part", "IV. Results", "ALL CAPS", "some words", "References", "B", "", None, "1) x", "II.2 x"]


def plain_features(a, b, sizes, n_pages):
    """The features of one pair; ``a`` is None for the root."""
    name = lambda x: x[3] if x[3] is not None else "[NONE]"
    size = lambda x: -1.0 if x is None or x[4] is None else round(x[4], 4)

    def number(x):
        m = re.search(r"^([0-9.]+)", (x[2] or "") if x else "")
        if m is None:
            return None, None
        s = m.group(0).removesuffix(".")
        return s, s.rpartition(".")[0] if "." in s else None

    def period(x):
        words = (x[2] or "").strip(" ").split(" ") if x else [""]
        return len(words) > 1 and words[0].endswith(".") and words[0].count(".") == 1 and len(words[0]) <= 3

    def keyword(x):
        s = (x[2] or "").strip(" ").lower() if x else ""
        s = s[:-1] if s.endswith((".", ":")) else s
        keys = ("abstract", "introduction", "conclusions", "references", "acknowledgements", "methods", "discussion", "keywords", "appendix")
        return s != "" and len(s.split(" ")) <= 2 and s.endswith(keys)

    def caps(x):
        s = (x[2] or "").strip(" ") if x else ""
        return s != "" and s.upper() == s

    def letter(x):
        words = (x[2] or "").strip(" ").split(" ") if x else [""]
        return len(words) > 1 and len(words[0]) == 1 and "A" <= words[0] <= "Z"

    sa, sb = size(a), size(b)
    larger = sa > 0 and sb > 0 and sizes.index(sa) - sizes.index(sb) == 1
    font = name(a) if a else "[ROOT]"
    page_a, page_b = a[5] if a else -1, b[5]
    sign = lambda x, y: (x > y) - (x < y)
    al, at = (a[6], a[7]) if a else (0, 0)
    (na, _), (nb, up) = number(a), number(b)
    return [
        larger, font == name(b), sa == -1, sb == -1, "bold" in font.lower(), "bold" in name(b).lower(), (page_b - page_a) / n_pages, page_a == page_b,
        sign(at, b[7]) if a else -1, sign(al, b[6]) if a else -1, abs(al - b[6]), abs(at - b[7]), na is not None, nb is not None, nb is not None and up is None,
        na is not None and na == up, a is None, period(b), keyword(b), caps(b), letter(b), period(a), keyword(a), caps(a), letter(a),
    ]


def plain_nesting(sections, score):
    sizes = sorted({round(s[4], 4) for s in sections if s[4] is not None and s[4] > 0})
    spine, out = [None], []
    for s in sorted(sections, key=lambda s: s[1]):
        scores = [float(score(np.array([plain_features(a, s, sizes, s[8])], float))[0]) for a in spine]
        best = scores.index(max(scores))
        parent = spine[best]
        out.append((s[0], s[1], parent[1] if parent else -1, round(scores[best] / sum(scores), 9), len(spine)))
        spine = [*spine[: best + 1], s]
    return out


def document(rng, doc, n):
    rows = []
    for pos in range(n):
        text = rng.choice(WORDS)
        number = rng.choice(["", "", f"{rng.randrange(1, 4)} ", f"{rng.randrange(1, 4)}.{rng.randrange(1, 3)} ", f"{rng.randrange(1, 3)}.1.{rng.randrange(1, 3)}. "])
        rows.append((doc, pos, None if text is None else number + text, rng.choice(["Times", "Times-Bold", None]), rng.choice([10.0, 12.0, 14.00001, None]),
                     pos // 3, rng.choice([0.1, 0.2]), rng.random(), n // 3 + 1, "clash"))
    return rows


def wild_score():
    """A score that no rule has in mind, made here so that it goes to the tasks as it is."""
    weights = np.random.default_rng(5).normal(size=len(nesting.FEATURES))

    def score(x):
        return 1 / (1 + np.exp(-(x @ weights)))

    return score


@pytest.mark.parametrize("score", [nesting.rule_score, nesting.size_score, wild_score()])
def test_nesting_is_that_of_a_walk(spark, monkeypatch, score):
    monkeypatch.setattr(nesting, "SECTIONS", 100)
    rng = random.Random(6)
    docs = {d: document(rng, d, rng.choice([0, 1, 2, 9, 30])) for d in range(60)}
    rows = [r for d in docs.values() for r in d]
    rng.shuffle(rows)
    got = nesting.nest_by_score(spark.createDataFrame(rows, SCHEMA).repartition(3), score).collect()
    want = [r for d in docs.values() for r in plain_nesting(d, score)]
    assert sorted((r.doc_id, r.pos, r.parent, round(r.share, 9), r.n_open) for r in got) == sorted(want)


def test_features_have_their_names():
    assert len(nesting.FEATURES) == 25 == len(set(nesting.FEATURES))


def test_without_rows_and_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nesting.nest_by_score(empty).count() == 0
    rows = [(None, k, "x", None, None, None, None, None, None, None) for k in range(3)]
    got = nesting.nest_by_score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.n_open > 0) for r in got] == [(None, True)] * 3


def test_bounds_of_memory():
    """An executor's Python came to 3.6 GB in larger runs with four times as much at once."""
    from lamina.operators import inrow

    assert inrow.SLICE <= 1 << 20 and nesting.SECTIONS <= 5_000
