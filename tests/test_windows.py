"""Windows of sub-words, mentions and bibliography records against plain walks over one text at a time."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import ascii as fold
from lamina.functions import text
from lamina.operators import bibliography, inrow, segments, windows

PIECE = 4


def plain_windows(sizes, room, overlap):
    """First, end, first labelled and end of labelled words of each window, one word at a time."""
    out, begin, own, n = [], 0, 0, len(sizes)
    while True:
        end, held = begin, 0
        while end < n and (held + sizes[end] <= room or end == begin):
            held += sizes[end]
            end += 1
        if end == n:
            out.append((begin, end, own, n))
            return out
        following = end
        while following - 1 > begin and sum(sizes[following - 1 : end]) <= overlap:
            following -= 1
        split = following
        while split < end and sum(sizes[following:split]) <= sum(sizes[split + 1 : end]):
            split += 1
        split = max(split, own)
        out.append((begin, end, own, split))
        begin, own = following, split


def test_windows_are_those_of_a_walk():
    rng = random.Random(1)
    for _ in range(300):
        room = rng.choice([4, 9, 20])
        overlap = rng.randrange(room // 2 + 1)
        parts = [[rng.randrange(1, rng.choice([2, 4, 12])) for _ in range(rng.choice([1, 2, 10, 60]))] for _ in range(rng.randrange(4))]
        sizes = np.array([s for p in parts for s in p], np.int64)
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        got = sorted(zip(*(x.tolist() for x in windows.cut(sizes, part, room, overlap)), strict=True))
        want, base = [], 0
        for p in parts:
            want += [tuple(base + x for x in w) for w in plain_windows(p, room, overlap)]
            base += len(p)
        assert got == sorted(want)
        labelled = [i for w in got for i in range(w[2], w[3])]
        assert sorted(labelled) == list(range(len(sizes)))  # every word once


def odd_texts(rng):
    words = ["a", "Ab", "12", "x" * 9, "É" * 5, "y" * 101, "Cd", "Ee", "-", "10.1/x", "ﬁ", "𝒳" * 6, "I", "1999"]
    space = [" ", "\n", "  ", "\t", ". ", "\n\n"]
    texts = ["".join(rng.choice(words) + rng.choice(space) for _ in range(rng.choice([0, 1, 3, 50, 400]))) for _ in range(40)]
    return [None, "", " \n ", *texts, "Z " * 5000, "one" * 3000]


def local_score():
    """Labels by a hash of the sub-words three words around each, made here so that it goes to the tasks as it is."""

    def score(batch):
        out = np.zeros(batch.ids.shape, np.int64)
        for r in range(len(out)):
            n = int(batch.mask[r].sum())
            word = batch.word[r, :n]
            for c in range(n):
                near = np.abs(word - word[c]) <= 3
                out[r, c] = (int(batch.ids[r, :n][near].sum()) + int(batch.first[r, c]) * 7 + c - int(np.flatnonzero(word == word[c])[0])) % 5
        return out

    return score


def test_windows_leave_no_trace(spark):
    rng = random.Random(2)
    rows = [(i, t, "clash") for i, t in enumerate(odd_texts(rng)[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)
    short = windows.label_words(docs, local_score(), windows.pages, size=58, overlap=28).collect()
    unsplit = windows.label_words(docs, local_score(), windows.pages, size=1 << 20, overlap=128).collect()
    key = lambda r: (r.doc_id, r.part)
    assert sorted(short, key=key) == sorted(unsplit, key=key)
    assert sum(sum(map(len, r.labels)) > 56 for r in short) > 5


def test_pieces_and_offsets(spark):
    rng = random.Random(3)
    texts = dict(enumerate(odd_texts(rng)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in windows.label_words(docs, lambda b: b.length % 100).collect()}
    for i, t in texts.items():
        words = list(re.finditer(r"[^ \t\n]+", t or ""))
        if not words:
            assert i not in got
            continue
        r = got[i]
        assert (r.part, r.start, r.text) == (0, 0, t)
        assert list(zip(r.starts, r.ends, strict=True)) == [w.span() for w in words]
        size = lambda w: [len(w) % 100] if len(w) > 100 else [min(PIECE, len(w) - k) for k in range(0, len(w), PIECE)]
        assert r.labels == [size(w.group()) for w in words]


def test_odd_rows(spark):
    run = lambda rows: windows.label_words(spark.createDataFrame(rows, "doc_id long, text string"), windows.rule_mentions)
    assert run([]).count() == 0 and windows.mentions(run([])).count() == 0
    assert [(r.doc_id, r.labels) for r in run([(None, "A b"), (None, "A b")]).collect()] == [(None, [[4], [0]])] * 2
    with pytest.raises(ValueError):
        windows.label_words(spark.createDataFrame([], "doc_id long, text string"), windows.rule_mentions, size=10, overlap=5)


def plain_mentions(labels, keep_first):
    """Groups of words, from the labels of each word's sub-words in turn."""
    out, open_ = [], []

    def close():
        if open_:
            out.append((open_[0], open_[-1], len(open_)))
        open_.clear()

    for i, parts in enumerate(labels):
        if i == 0 and not keep_first:
            continue
        edges = [x for x in parts if x in "BLU"]
        label = edges[0] if len(set(edges)) > 1 else "I" if "I" in parts else parts[0]
        if label in "BU":
            close()
        if label != "O":
            open_.append(i)
        if label in "LU":
            close()
    close()
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_mentions_are_those_of_a_walk(spark, keep_first):
    rng = random.Random(4)
    cases = {(d, p): [[rng.choice("OOBILU") for _ in range(rng.choice([1, 1, 2, 3]))] for _ in range(rng.choice([1, 2, 8, 30]))] for d in range(30) for p in range(2)}
    rows = [(d, p, 100 * p, [10 * i for i in range(len(v))], [10 * i + 3 for i in range(len(v))], [[windows.MENTION.index(x) for x in w] for w in v]) for (d, p), v in cases.items()]
    labelled = spark.createDataFrame(rows, "doc_id long, part long, start long, starts array<int>, ends array<int>, labels array<array<tinyint>>")
    got = sorted(tuple(r) for r in windows.mentions(labelled, keep_first).select("doc_id", "pos", "part", "first", "last", "n", "start", "end").collect())
    want = []
    for d in range(30):
        found = [(p, *m) for p in range(2) for m in plain_mentions(cases[d, p], keep_first)]
        want += [(d, pos, p, a, b, n, 100 * p + 10 * a, 100 * p + 10 * b + 3) for pos, (p, a, b, n) in enumerate(found)]
    assert got == want


def plain_fields(content, spans, labels):
    def first(wanted):
        got = None
        for (a, b), x in zip(spans, labels, strict=True):
            if x == wanted:
                got = (got[0] if got else a, b)
            elif got:
                break
        return got

    authors, opened = [], None
    for (a, b), x in zip(spans, labels, strict=True):
        if x in (2, 3, 4) and opened:
            opened = (opened[0], b)
        elif x == 2:
            opened = (a, b)
        elif opened:
            authors.append(opened)
            opened = None
    say = lambda s: s and (*s, content[s[0] : s[1]])
    kinds = {"number": 1, "title": 8, "year": 7, "doi": 15, "url": 14}
    return {n: say(first(k)) for n, k in kinds.items()} | {"venue": say(first(9) or first(16)), "authors": [say(s) for s in authors]}


def test_fields_are_those_of_a_walk(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(200):
        n = rng.choice([0, 1, 2, 12])
        content = " ".join(rng.choice(["a", "Bé", "10.1 X", "c-"]) for _ in range(n))
        spans = [m.span() for m in re.finditer(r"\S+", content)]
        labels = [[rng.choice([0, 1, 2, 2, 3, 4, 7, 8, 8, 9, 14, 15, 16]) for _ in range(rng.choice([1, 2]))] for _ in spans]
        rows.append((d, 0, 50, content, [a for a, _ in spans], [b for _, b in spans], labels))
        want[d] = plain_fields(content, spans, [x[0] for x in labels])
    entries = spark.createDataFrame(rows, "doc_id long, part long, start long, text string, starts array<int>, ends array<int>, labels array<array<tinyint>>")
    found = bibliography.fields(entries)
    for r in found.collect():
        assert {n: [tuple(x) for x in r[n]] if n == "authors" else r[n] and tuple(r[n]) for n in want[r.doc_id]} == want[r.doc_id]
    layers = sorted(tuple(r) for r in bibliography.layers(found).select("doc_id", "field", "pos", "start", "end").collect())
    assert layers == sorted(
        (d, n, i, 50 + s[0], 50 + s[1]) for d, w in want.items() for n, v in w.items() for i, s in enumerate(v if n == "authors" else [v] if v else [])
    )


def test_authors_of_rows_are_those_of_arrays(spark):
    rng = random.Random(6)
    names = {0: "MISC", 2: "START", 3: "MIDDLE", 4: "END"}
    cases = {d: [rng.choice([0, 2, 3, 4]) for _ in range(9)] for d in range(60)}
    rows = spark.createDataFrame([(d, i, names[x]) for d, v in cases.items() for i, x in enumerate(v)], "doc_id long, pos long, label string")
    got = sorted(tuple(r) for r in segments.author_spans(rows, "doc_id", "pos").collect())
    spans = [(i, i) for i in range(9)]
    assert got == sorted((d, a, b) for d, v in cases.items() for a, b, _ in plain_fields("", spans, v)["authors"])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_records_are_cleaned(spark):
    clean = lambda s: one(spark, text.clean_field(F.lit(s)))
    assert clean("  Über- \n setzung der Straße—ein Maß ") == "Ubersetzung der Strasse--ein Mass"
    assert clean("5– 6") == "56" and clean("   ") is None and clean("") is None
    doi = lambda s: one(spark, text.clean_doi(F.lit(s)))
    assert doi(" 10.10 00/ABC d ") == "10.1000/abcd" and doi("1 0.1/x") is None and doi("doi:10.1") is None
    assert one(spark, text.clean_field(F.lit(None).cast("string"))) is None


def test_letters_in_ascii(spark):
    cases = {
        "Ärger, Žižek, naïve Œuvre, ﬁn": "Arger, Zizek, naive OEuvre, fin".replace("OE", "Oe"), "Щука и Жук": "Shchuka i Zhuk", "ёлка": "iolka",
        "Ψυχή ὦ": "Psukhe o", "Łódź ½ №": "Lodz 1/2 No", "é": "e", "漢字 Å": "漢字 A", "plain": "plain", "": "", "Ｗｉｄｅ": "Wide", "æ𝒳": "ae𝒳",
    }
    for given, want in cases.items():
        assert one(spark, fold.to_ascii(F.lit(given))) == want


def test_the_table_follows_from_decompositions(spark):
    latin = [c for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0].isascii()]
    got = spark.createDataFrame([(c,) for c in latin], "c string").select("c", fold.to_ascii(F.col("c")).alias("x")).collect()
    assert len(latin) > 200 and all(r.x == unicodedata.normalize("NFD", r.c)[0] for r in got)
    assert all(v.isascii() for v in fold.table().values())


def test_fuzz_ratio_of_tables_is_that_of_a_plain_table(spark):
    from lamina.plans.table_queries import _pairs
    from lamina.plans.window_queries import fuzz_ratio_of_documents

    data = "/root/testdata/sf0.001"
    mentions, entries = (x.collect() for x in _pairs(spark, data))
    said = {r.pos: r.text for r in mentions}, {r.pos: r.text for r in entries}
    rows = fuzz_ratio_of_documents(spark, data).collect()
    assert len(rows) > 900
    for r in rows:
        a, b = said[0][r.pos], said[1][r.entry_pos]
        line = [0] * (len(b) + 1)
        for x in a:
            line_before, line = line, [0]
            for j, y in enumerate(b):
                line.append(line_before[j] + 1 if x == y else max(line_before[j + 1], line[j]))
        assert r.fuzz_ratio == (round(200 * line[-1] / (len(a) + len(b))) if a or b else 100)


def test_parts_are_pages(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"w{i}" for i in range(90)))], "doc_id long, text string")
    got = windows.label_words(docs, windows.rule_mentions, windows.pages).orderBy("part").collect()
    assert [(r.part, len(r.starts), r.text.count("\n")) for r in got] == [(0, 40, 39), (1, 40, 39), (2, 10, 9)]
    assert windows.label_words(docs, windows.rule_mentions, inrow.Texts.sentences).count() == 1
