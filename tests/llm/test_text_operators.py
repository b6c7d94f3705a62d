"""BPE, packing, toxicity, quality, chunking and licences against brute force."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import bpe, licenses, packing, quality_cnn, queries, substring_dedup, toxicity

#: White space, controls that Python alone takes for white space, letters of late versions of Unicode and others.
ALPHABET = "ab cER\n\t'srテ😀éß<|endoftext|>0_.\x1c\x1d\x1e\x1f\x0b\x0c\x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b\x7fΣς\u1c89\ua7cb\u0558½²\u0301"


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    fixed = ["", "a", "  ", "\n\n", "a  b", " \t\n x", "<|endoftext|>", "aaaa aaaaaaa", "I'm don't we'LL 's", " " * 50 + "x", "\x00 a"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    mine, library = bpe.load(queries.vocabulary(name)), Tokenizer.from_file(public_tokenizers.path(name))
    texts = odd_texts()
    for text, ids, want in zip(texts, mine.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
        if name.startswith("byte"):
            assert mine.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_lone_marks_in_a_fresh_worker(name):
    content, library = queries.vocabulary(name), Tokenizer.from_file(public_tokenizers.path(name))
    fresh = type(bpe.load(content))(content)
    special = next(iter(fresh.special), "")
    for mark in sorted(bpe.MARKS):
        for text in (mark, f"{mark} x", f"x {mark}", f" {mark}", f"{mark}{mark}", f"a{mark} b {mark}\n{mark}", f"{special}{mark} a", f"a{special}{mark}"):
            fresh.old, fresh.new = {}, {}
            assert np.frombuffer(fresh.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_character_is_split_as_the_library_splits_it(name):
    mine, library = bpe.load(queries.vocabulary(name)), Tokenizer.from_file(public_tokenizers.path(name))
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and (p < 0x3100 or p % 41 == 0)]
    texts = [f"a{chr(p)}b 1{chr(p)}2 .{chr(p)}. {chr(p)}{chr(p)} {chr(p)}A" for p in points]
    for text, ids, want in zip(texts, mine.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_without_end(name):
    rng = random.Random(7)
    mine, library = bpe.load(queries.vocabulary(name)), Tokenizer.from_file(public_tokenizers.path(name))
    letters = ["abcdefghijklmnopqrstuvwxyz", "ab", "".join(map(chr, range(0x4E00, 0x9FFF))), ".-"]
    texts = ["".join(rng.choice(x) for _ in range(n)) for x in letters for n in (255, 256, 257, 3000)] + ["a" * 5000, "information" * 400]
    for text, ids, want in zip(texts, mine.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
    began = time.process_time()
    mine.encode(["".join(rng.choice(letters[0]) for _ in range(1_000_000)), "".join(rng.choice(letters[2]) for _ in range(300_000))])
    assert time.process_time() - began < 60


def test_compatible_pairs_are_those_that_merging_keeps():
    mine = bpe.load(queries.vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    merged = mine.merge([mine.bytes_of[x] + mine.bytes_of[y] for x, y in zip(a, b, strict=True)])
    want = [np.frombuffer(m, "<u4").tolist() == [x, y] for m, x, y in zip(merged, a, b, strict=True)]
    assert mine.compatible(a, b).tolist() == want


CASES = [(1, None, "x", 1), (2, "", "y", 2), (3, "A b c", None, None), (3, "A b c", "z", 3), (None, "some words here", "q", 4), (5, "word " * 5000, "q", 5)]
SCHEMA = "doc_id long, text string, lang string, id long"


def test_encoding_of_odd_rows(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    got = bpe.encode_documents(docs, queries.vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == len(CASES)
    assert sorted(r.decoded for r in got) == sorted(c[1] or "" for c in CASES)
    assert bpe.encode_documents(docs.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


CAPACITIES = [
    packing.Capacity(), packing.Capacity(documents=6), packing.Capacity(tokens=100, documents=100, attention=100 * 100),
    packing.Capacity(tokens=100, documents=5, attention=6000, weights=(1, 1, 1)),
    packing.Capacity(tokens=100, documents=7, attention=7000, weights=(1, 1, 1), choose_by="dot"),
]


def one_by_one(lengths, capacity):
    """Residuals of the sequences that vector best-fit makes, a piece at a time."""
    limits, weights = np.array([capacity.tokens, capacity.documents, capacity.attention], float), np.array(capacity.weights)
    room = []
    for n in sorted(lengths, reverse=True):
        need, best = np.array([n, 1, n * n], float), None
        for i, r in enumerate(room):
            if (r >= need).all():
                score = ((r - need) / limits) ** 2 @ weights if capacity.choose_by == "norm" else -(r / limits @ (weights * need / limits))
                best = min(best or (((np.inf,),)), ((score, *r), i))
        if best is None:
            room.append(limits - need)
        else:
            room[best[1]] = room[best[1]] - need
    return Counter(tuple(map(int, r)) for r in room)


@pytest.mark.parametrize("capacity", CAPACITIES)
def test_packing_is_vector_best_fit(capacity):
    rng = random.Random(1)
    most = min(capacity.tokens, int(capacity.attention**0.5))
    for n in (0, 1, 40, 900):
        lengths = [min(most, int(rng.lognormvariate(3 if capacity.tokens == 100 else 6, 1.2)) + 1) for _ in range(n)]
        plan = packing.best_fit(Counter(lengths), capacity)
        assert len(plan) <= packing.plan_bound(capacity)
        bins = {}
        for length, _, pieces, first, offset, each in plan.tolist():
            for k in range(pieces):
                bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
        for held in bins.values():
            end = 0
            for offset, length in sorted(held):
                assert offset == end
                end += length
        assert sorted(n for held in bins.values() for _, n in held) == sorted(lengths)
        room = lambda held: (capacity.tokens - sum(n for _, n in held), capacity.documents - len(held), capacity.attention - sum(n * n for _, n in held))
        got = Counter(map(room, bins.values()))
        assert got == one_by_one(lengths, capacity) and all(min(r) >= 0 for r in got)
        if capacity == packing.Capacity() and n:
            assert len(bins) <= -(-sum(lengths) // 2048) + 1


def test_the_plan_of_any_corpus_is_bounded():
    rng = np.random.default_rng(3)
    for _ in range(3):
        counts = {int(n): int(c) for n, c in zip(rng.permutation(2048)[:1500] + 1, rng.integers(1, 10**9, 1500), strict=True)}
        assert len(packing.best_fit(counts, packing.Capacity())) <= packing.plan_bound(packing.Capacity()) < 400_000


def test_all_residuals_take_part():
    # Both sequences have ten tokens left; that with two pieces has less room for documents, that with one for attention.
    place = lambda weights: {row[0]: row[3] for row in packing.best_fit({90: 1, 45: 2, 10: 1}, packing.Capacity(100, 100, 10000, weights)).tolist()}
    by_documents, by_attention = place((1, 0.01, 0)), place((1, 0, 0.01))
    assert by_documents[10] == by_documents[45] and by_attention[10] == by_attention[90]


def test_packed_documents(spark):
    docs = spark.createDataFrame(CASES, SCHEMA).repartition(3)
    got = queries.pack_documents(docs).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, _, _ in CASES:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want.append((i, k // 2048, k, len(part) // 4, zlib.crc32(part)))
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert queries.pack_documents(docs.limit(0)).count() == 0


def one_edit(a, b):
    """0 for equal words, 1 for a swap or a sign for a letter of ``b``, 2 for another edit, 3 for more."""
    if a == b:
        return 0
    if len(a) == len(b):
        off = [i for i in range(len(a)) if a[i] != b[i]]
        if len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]:
            return 1
        return (2 if a[off[0]].isalpha() else 1) if len(off) == 1 else 3
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return 2 if len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))) else 3


def test_automaton_matches_what_edit_distance_matches():
    terms, stems = ["idiot", "scum", "clown", "clowns", "moron", "abcabc", "xy"], ["réeux", "ab", "qrst"]
    automaton = toxicity.Automaton(terms, stems)
    rng = random.Random(4)
    words = set(terms)
    for _ in range(12000):
        w = list(rng.choice(terms + ["réeuxe", "zzz", "qrstuv", "qrst"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.3 and at + 1 < len(w):
                w[at], w[at + 1] = w[at + 1], w[at]
            else:
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "o", "c", "s", "é", "1", "*"])
        words.add("".join(w))
    long_enough = lambda kind, t: kind == 0 or (kind == 1 and len(t) >= toxicity.SHORT_FROM) or (kind == 2 and len(t) >= toxicity.FUZZY_FROM)
    for w in words:
        stem = any(w.startswith(s) for s in stems)
        fuzzy = any(long_enough(one_edit(w, t), t) for t in terms)
        fuzzy |= any(long_enough(one_edit(w[:n], s), s) for s in stems for n in range(len(s) - 1, len(s) + 2) if n <= len(w))
        want = automaton.EXACT if stem or w in terms else automaton.FUZZY if fuzzy else 0
        assert automaton.match(w) == want, w


@pytest.mark.parametrize("word", ["idoit", "id1ot", "idi*t", "idi0t", "idiott", "idot", "iidiot", "scmu", "sc*m", "5cum", "mor0nic", "mornoic"])
def test_misspelled_terms_count(word):
    scorer = toxicity.Scorer(toxicity.Model(["idiot", "scum"], ["moron"], [1, 0, 0, 0, 0], 0))
    assert scorer.features(f"such a {word} as that")[3] > 0
    assert scorer.features("scam, sum, drum, patriot, memory, a 1st, e-mail a@b.org")[3] == 0


def test_long_texts_take_linear_time():
    scorer = toxicity.Scorer(toxicity.Model(["idiot"], [], [1, 0, 0, 0, 0], 0))
    began = time.process_time()
    scorer.features('he "idiot" wrote and so on for ever ' * 30_000)
    scorer.features('"' + "idiot words " * 80_000)
    scorer.features("x" * 1_000_000 + " idiot")
    assert time.process_time() - began < 30


def test_lexicon_of_long_words(spark):
    toxic, clean = "unbelievablyridiculousfellowhood" * 2, "quite a decent paragraph number"
    docs = spark.createDataFrame([(i, f"{toxic} {i}" if i % 2 else f"{clean} {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((s > 0.7) == bool(i % 2) for i, s in scores.items())


def brute_features(model, text):
    """Features word by word, with quotations from their ends and matches from edit distances."""
    import re

    lowered = text.lower()
    words = [(m.start(), m.group()) for m in re.finditer(r"[^\W_](?:[*@$!]?[^\W_])*", lowered)]
    full = told = fuzzy = 0.0
    for i, (at, w) in enumerate(words):
        exact = w in model.terms or any(w.startswith(s) for s in model.stems)
        kinds = [one_edit(w, t) for t in model.terms if len(t) >= 5]
        if not exact and min(kinds, default=3) > 2:
            continue
        near = [x for _, x in words[max(0, i - 8) : i] + words[i + 1 : i + 9]]
        reported = any(a <= at < b for a, b in toxicity.quotations(lowered)) or any(x in toxicity.REPORTING for x in near)
        full += (0.25 if reported else 1.0) * (1.0 if exact else 0.7)
        told += reported
        fuzzy += not exact
    return [np.log1p(full), np.log1p(told), 100 * full / (len(words) + 20), np.log1p(fuzzy), np.log1p(len(words))]


def test_features_are_those_of_brute_force():
    rng = random.Random(12)
    model = toxicity.Model(["idiot", "clown"], ["dumbo"], [0.5, -0.2, 0.1, 0.3, 0.01], -1.0)
    scorer = toxicity.Scorer(model)
    pool = ["idiot", "idoit", "clwn", "dumbos", "said", '"', "“", "”", "\n\n", "\n> ", "plain", "words", "and", "more", "1", "«", "»"]
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        got = scorer.features(text)
        assert np.allclose(got, brute_features(model, text)), text
        assert np.isclose(scorer.score(got), 1 / (1 + np.exp(-(np.dot(model.weights, got) + model.bias))))


def test_quotation_counts_for_less():
    scorer = toxicity.Scorer(toxicity.Model(["idiot"], [], [1, 0, 0, 0, 0], 0))
    plain = scorer.features("you are an idiot and that is all there is to it")
    quoted = scorer.features('you are an "idiot" and that is all there is to it')
    told = scorer.features("you are an idiot he said and that is all")
    assert plain[0] > quoted[0] and plain[0] > told[0] and quoted[1] > 0
    assert scorer.features("an idoit")[0] == scorer.features("an idiot")[0] or scorer.features("an idiott")[3] > 0


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    model = toxicity.Model(["idiot"], [], [1, 0, 0, 0, 0], 0)
    assert toxicity.score_toxicity(docs, model).count() == len(CASES)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    labels = spark.createDataFrame([(None, 1), (9, None)], "doc_id long, toxic int")
    learned = toxicity.learn(docs, labels)
    assert learned.terms == [] and toxicity.score_toxicity(docs.limit(0), learned).count() == 0


def test_held_out_toxicity(spark):
    data = "/root/testdata/sf0.01"
    got = queries.op5_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit, toxic = got.predicted == 1, got.toxic == 1
    assert (hit & toxic).sum() >= 0.6 * toxic.sum() and (hit & ~toxic).sum() <= 0.02 * len(got)


def test_held_out_quality(spark):
    data = "/root/testdata/sf0.01"
    got = queries.op4_quality_cnn(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean()) >= 0.9


def test_chunks_of_the_network_cover_the_text():
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        text = bytes(i % 251 for i in range(n))
        chunks = quality_cnn.chunks_of(text)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        seen = b"".join(bytes(c[:step].clip(max=255).astype(np.uint8)) for c in chunks[:-1])
        tail = chunks[-1][chunks[-1] != quality_cnn.PAD].astype(np.uint8).tobytes()
        assert seen + tail == text


def test_quality_without_labels(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    labels = spark.createDataFrame([(None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality_cnn.score_quality(docs, quality_cnn.learn(docs, labels)).collect()} == {0.5}


def test_gear_hash_is_the_recurrence():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(substring_dedup.GEAR[b])) % (1 << 32)
        want.append(h)
    assert substring_dedup.rolling(data).tolist() == want


def test_cut_points_cover_texts_and_resist_insertions():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(400)).encode()
    (ends,) = substring_dedup.cut_points([text])
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    # An end depends on the bytes that the hash looks back on, so all others stay where they were.
    first, second = b"something new ", b" inserted "
    (moved,) = substring_dedup.cut_points([first + text[:900] + second + text[900:]])
    shift = lambda e: e + len(first) + len(second) * (e > 900)
    near = lambda e: e <= substring_dedup.REACH or 900 < e <= 900 + substring_dedup.REACH
    assert {shift(e) for e in ends if not near(e)} <= set(moved)
    assert set(moved) <= {shift(e) for e in ends} | {shift(e) for e in range(len(text) + 1) if near(e)} | set(range(len(first) + 1)) | set(
        range(900 + len(first), 900 + len(first) + len(second) + 1)
    )
    (both,) = substring_dedup.cut_points(["é" .encode() * 1000])
    assert all(b % 2 == 0 for b in both)
    assert substring_dedup.cut_points([b"", b"a"]) == [[], [1]]


def test_repeated_passage_is_found_and_cut(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = words(60)
    texts = [(i, f"{words(50)} {passage} {words(50)}") for i in range(4)] + [(9, words(200)), (10, None), (None, passage), (11, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {1, 2, 3, None} and all(0 in r.first_ids for r in found)
    cleaned = {r.doc_id: r.text for r in substring_dedup.drop_repeated_passages(docs).collect()}
    assert cleaned[0] == texts[0][1] and cleaned[9] == texts[4][1] and cleaned[10] is None
    for i in (1, 2, 3):
        assert len(cleaned[i].split()) < 110 + 20 and cleaned[i].split()[:40] == texts[i][1].split()[:40]
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    docs = spark.createDataFrame(
        [(1, "// Copyright (c) 2020 Someone\n" + mit.upper()), (2, mit.replace(",", " ;")), (3, mit + " extra"), (4, None), (5, ""),
         (6, licenses.KNOWN["ISC"].replace("license", "licence")), (None, "MIT License\n\nCopyright 2001 X\n\n" + mit)],
        "doc_id long, text string",
    )
    got = sorted(((r.doc_id or 0, r.license) for r in licenses.scan_licenses(docs).collect()))
    assert got == [(0, "MIT (with title)"), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "ISC")]


@pytest.mark.parametrize("marks", ['""', "“”", "„“", "«»", "»«", '„"', '“"', "””"])
def test_long_quotations(marks):
    scorer = toxicity.Scorer(toxicity.Model(["idiot"], [], [1, 0, 0, 0, 0], 0))
    filler = ("plain words without end " * 11).strip()
    quotation = f"{marks[0]}{filler}\nidiot {filler}{marks[1]}"
    assert len(quotation) > 500 and "\n" in quotation
    assert scorer.features(f"they put it so {quotation} and left")[1] > 0
    # The author's own words between two long quotations are nobody else's.
    clean = quotation.replace("idiot", "")
    assert scorer.features(f"{clean} you are an idiot {clean}")[1] == 0
    # A mark that nothing closes ends with its paragraph.
    assert scorer.features(f"a 5{marks[0]} pipe\n\nyou are an idiot {filler}")[1] == 0
    assert scorer.features("> " + filler + " idiot\nand so on")[1] > 0


def random_network(seed=5):
    rng = np.random.default_rng(seed)
    q = quality_cnn
    net = q.Network(rng.normal(0, 0.5, (257, q.DEPTH)), rng.normal(0, 0.2, (q.WIDTH * q.DEPTH, q.FILTERS)), rng.normal(0, 0.1, q.FILTERS),
                    rng.normal(0, 0.3, 2 * q.FILTERS), 0.1)
    net.embed[q.PAD] = 0
    return net


def plain_score(net, text):
    """The network by loops over chunks, spots and filters."""
    q = quality_cnn
    step, best = q.CHUNK - q.OVERLAP, []
    n = max(1, -(-(len(text) - q.OVERLAP) // step))
    for k in range(n):
        data = list(text[k * step : k * step + q.CHUNK])
        data += [q.PAD] * (q.CHUNK - len(data))
        most = np.full(q.FILTERS, -np.inf)
        for at in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE):
            seen = np.concatenate([net.embed[b] for b in data[at : at + q.WIDTH]])
            most = np.maximum(most, seen @ net.filters)
        best.append(np.maximum(most + net.shift, 0))
    described = np.concatenate([np.mean(best, 0), np.max(best, 0)])
    return 1 / (1 + np.exp(-(described @ net.out + net.bias)))


def test_scores_are_those_of_plain_loops():
    net, rng = random_network(), random.Random(3)
    batch = [b"", b"a", b"short text", bytes(rng.randrange(256) for _ in range(512)), bytes(rng.randrange(97, 110) for _ in range(3000)), b"same", b"same"]
    assert np.allclose(quality_cnn.scores(net, batch), [plain_score(net, t) for t in batch], atol=1e-5)


def test_gradients_are_finite_differences():
    net, rng = random_network(), np.random.default_rng(8)
    parts = [quality_cnn.chunks_of(bytes(rng.integers(97, 123, n).astype(np.uint8))) for n in (30, 700, 1400)]
    sizes, labels = np.array([len(p) for p in parts]), np.array([1.0, 0.0, 1.0])
    part = np.concatenate(parts)

    def loss():
        starts = np.cumsum(sizes) - sizes
        flat = np.ascontiguousarray(quality_cnn.windows(net, part)).reshape(len(part), quality_cnn.SPOTS, -1)
        top = np.maximum((flat @ net.filters).max(1) + net.shift, 0)
        z = np.c_[np.add.reduceat(top, starts) / sizes[:, None], np.maximum.reduceat(top, starts)] @ net.out + net.bias
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    grads = quality_cnn.gradients(net, part, sizes, labels)
    for name in ("out", "filters", "shift", "embed"):
        weights = getattr(net, name)
        spots = np.argsort(-np.abs(grads[name]).ravel())[:5]
        for spot in spots:
            at = np.unravel_index(spot, weights.shape)
            kept, step = weights[at], 1e-5
            weights[at] = kept + step
            up = loss()
            weights[at] = kept - step
            down = loss()
            weights[at] = kept
            assert np.isclose((up - down) / (2 * step), grads[name][at], rtol=2e-2, atol=1e-6), name


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([*CASES, (6, "word " * 400_000, "q", 6)], SCHEMA).withColumns({"score": F.lit(1), "size": F.lit(2)})
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (5, 0), (6, 1), (None, 1), (99, 1), (2, None)], "doc_id long, quality int")
    net = quality_cnn.learn(docs, labels)
    got = quality_cnn.score_quality(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_cnn.score_quality(docs.limit(0), net).count() == 0


def test_planted_licences_are_found_however_wrapped(spark):
    import textwrap

    import duckdb

    rows, want = [], {}
    head = {"// ": "// Copyright (c) 2019-2021 Some Body <a@b.org>. All rights reserved.\n", "": "Copyright 2001 X\nAll rights reserved.\n\n", "# ": "# © 2020 Y\n", " * ": ""}
    names = {r.digest: r.license for r in licenses.known_digests(spark).collect()}
    for name, text in licenses.KNOWN.items():
        for width in (60, 66, 72, 76, 78, 80, 100):
            for sign, line in head.items():
                wrapped = "\n".join(sign + x for p in text.split("\n") for x in (textwrap.wrap(p, width, break_on_hyphens=False) or [""]))
                want[len(rows)] = name
                rows.append((len(rows), line + wrapped))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, licenses.KNOWN["MIT"] + " and so on"), (len(rows) + 3, "copyright notice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("x"), "license": F.lit("x")})
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.license for r in got if r.license} == {i: n for i, n in want.items()}
    assert set(names.values()) >= set(licenses.DIGESTS)
    # The SQL, whose forms are written by hand, finds the same.
    import pyarrow as pa

    documents = pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows], pa.string())})
    db = duckdb.connect()
    db.register("documents", documents)
    assert {(i, d, n) for i, d, n in db.execute("SELECT doc_id, canonical_sha256, license FROM (" + queries.oracle_sql()["op2_license_scan"] + ")").fetchall()} == {
        (r.doc_id, r.canonical_sha256, r.license) for r in got
    }


def test_long_licences_of_the_system(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(k, (folder / f).read_text(encoding="utf-8", errors="replace")) for k, f in files.items() if (folder / f).exists()]
    if not rows:
        pytest.skip("no licence texts on this machine")
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.license for r in licenses.scan_licenses(docs).collect()} == {k: k for k, _ in rows}
