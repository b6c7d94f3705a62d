"""The tree of a full text against a recursive walk over its elements, and its layers against a walk over tokens."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lamina.sources import tei

NS = "{http://www.tei-c.org/ns/1.0}"


def coords(rng):
    return ";".join(f"{rng.choice([1, 1, 2, 3])},{rng.randrange(80)},{rng.randrange(36)},{rng.randrange(1, 60)},{rng.randrange(1, 4)}" for _ in range(rng.choice([1, 1, 2])))


def full_text(rng):
    def attr(share=0.9):
        return f' coords="{coords(rng)}"' if rng.random() < share else ""

    out = ['<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><p>no</p></teiHeader><facsimile>']
    out += [f'<surface n="{n}" lrx="100" lry="40"/>' for n in (1, 2)]
    out.append("</facsimile><text><body>")
    for d in range(rng.randrange(4)):
        out.append("<div>")
        if rng.random() < 0.7:
            out.append(f'<head n="{d}."{attr()}>Head {d} &amp; more</head>')
        for _ in range(rng.randrange(4)):
            out.append("<p>" + "".join(f'<s{attr()}>words <ref type="bibr" target="#b{k}">[{k}]</ref> end</s>' for k in range(rng.randrange(4))) + "</p>")
        out.append("</div>")
    return "".join(out) + "<note/></body><back/></text></TEI>"


def plain_tree(xml):
    """(level, section, paragraph, sentence, last, number, title, coords) of the nodes in order."""
    nodes = []

    def add(level, place, number=None, title=None, at=None, inner=()):
        k = len(nodes)
        nodes.append([level, *place, k, number, title, at])
        for make in inner:
            make()
        nodes[k][4] = len(nodes) - 1

    def paragraph(i, j, p):
        held = [s for s in p.findall(NS + "s") if "coords" in s.attrib]
        add("paragraph", (i, j, None), inner=[lambda k=k, s=s: add("sentence", (i, j, k), at=s.attrib["coords"]) for k, s in enumerate(held)])

    body = ET.fromstring(xml).find(f"{NS}text/{NS}body")
    for i, div in enumerate(body.findall(NS + "div")):
        head = div.find(NS + "head")
        n, t = (head.attrib.get("n"), head.text) if head is not None else (None, None)
        inner = [lambda i=i, j=j, p=p: paragraph(i, j, p) for j, p in enumerate(div.findall(NS + "p"))]
        if head is not None and "coords" in head.attrib:
            inner.insert(0, lambda i=i, n=n, t=t, head=head: add("heading", (i, None, None), n, t, head.attrib["coords"]))
        add("section", (i, None, None), n, t, inner=inner)
    return [tuple(x) for x in nodes]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    made = {d: full_text(rng) for d in range(60)}
    return made, spark.createDataFrame(list(made.items()), "doc_id long, tei string").repartition(3)


COLUMNS = ("level", "section", "paragraph", "sentence", "last", "number", "title", "coords")


def test_tree_is_that_of_a_recursive_walk(texts):
    made, docs = texts
    got = {}
    for r in tei.tree(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(tuple(r[c] for c in COLUMNS))
    assert got == {d: t for d, x in made.items() if (t := plain_tree(x))}


def test_what_is_no_full_text_has_no_nodes(spark):
    rows = [(1, None), (2, ""), (3, "no <xml"), (4, "<TEI/>"), (5, "<TEI><text><body/></text></TEI>"), (None, "<TEI><text><body><div/></body></text></TEI>")]
    got = tei.tree(spark.createDataFrame(rows, "doc_id long, tei string")).collect()
    assert [(r.doc_id, r.level, r.pos, r.last) for r in got] == [(None, "section", 0, 0)]
    assert tei.tree(spark.createDataFrame([], "doc_id long, tei string")).count() == 0


def tokens_of(rng):
    """Tokens in reading order with the space between two from none to two."""
    out, at = [], 0
    for page in range(3):
        for row in range(0, 40, rng.choice([1, 2])):
            left = 0
            while left < 90:
                n = rng.randrange(1, 9)
                out.append((len(out), at, at + n, page, left / 100, row / 40, n / 100, 1 / 40))
                at += n + rng.choice([0, 1, 1, 2])
                left += n + rng.choice([0, 1, 5, 20])
    return out


def plain_layers(xml, tokens):
    """(level, id, n_spans, start, end), each token given out once, box after box."""
    free = {t[0]: t for t in tokens}
    mean = {p: sum(t[6] for t in tokens if t[3] == p) / sum(1 for t in tokens if t[3] == p) / 2 for p in range(3)}

    def take(node):
        taken = []
        for box in node[7].split(";"):
            page, left, top, w, h = (float(v) for v in box.split(","))
            page = int(page) - 1
            if page > 1:
                continue  # of no known size
            pad = mean[page] if node[0] == "sentence" else 0.0
            left, top, w, h = left / 100 - pad, top / 40, w / 100 + 2 * pad, h / 40
            for t in list(free.values()):
                x, y = (t[4] + (t[4] + t[6])) / 2, (t[5] + (t[5] + t[7])) / 2
                if t[3] == page and left <= x <= left + w and top <= y <= top + h:
                    taken.append(free.pop(t[0]))
        taken.sort()
        runs = []
        for t in taken:
            if runs and t[1] - runs[-1][-1][2] <= 1:
                runs[-1].append(t)
            else:
                runs.append([t])
        spans = []
        for run in runs:
            piece = None
            held = {t[0] for t in run}
            for t in tokens[run[0][0] : run[-1][0] + 1]:
                if t[0] in held or t[0] in free:
                    free.pop(t[0], None)
                    piece = (piece[0] if piece else t[1], t[2])
                elif piece:
                    spans.append(piece)
                    piece = None
            if piece:
                spans.append(piece)
        return spans

    nodes = plain_tree(xml)
    spans = {k: take(n) for k, n in enumerate(nodes) if n[7] is not None}
    out, count = [], {}
    dropped = {(n[1], n[2]) for k, n in enumerate(nodes) if n[0] == "sentence" and not spans[k]}
    for k, n in enumerate(nodes):
        if n[2] is not None and (n[1], n[2]) in dropped:
            continue
        below = [s for j in range(k, n[4] + 1) if nodes[j][7] is not None and (nodes[j][1], nodes[j][2]) not in dropped for s in spans[j]]
        out.append((n[0], count.get(n[0], 0), len(below), min((s[0] for s in below), default=None), max((s[1] for s in below), default=None)))
        count[n[0]] = count.get(n[0], 0) + 1
    return out


def test_layers_are_those_of_a_walk(spark, texts):
    made, docs = texts
    rng = random.Random(8)
    tokens = {d: tokens_of(rng) for d in range(20)}
    rows = [(d, *t) for d, v in tokens.items() for t in v]
    table = spark.createDataFrame(rows, "doc_id long, pos long, start long, end long, page long, l double, t double, w double, h double")
    got = {}
    for r in tei.tree_layers(tei.tree(docs.where(F.col("doc_id") < 20)), table).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.level, r.id, r.n_spans, r.start, r.end))
    want = {d: w for d in tokens if (w := plain_layers(made[d], tokens[d]))}
    assert got == want
    assert any(n == 0 for v in got.values() for _, _, n, _, _ in v) and any(n > 2 for v in got.values() for _, _, n, _, _ in v)
