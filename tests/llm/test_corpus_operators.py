"""Duplicates, archives, perplexity and the pipeline against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import exact_dedup, near_dedup, perplexity, queries, substring_dedup, warc
from lamina.llm.common import join_groups, meet_groups

SCHEMA = "doc_id long, text string, keep_id long, n long, id string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def exact_rows():
    rng = random.Random(1)
    rows = [(i, rng.choice(["Same", "same", "SAME É", "same é", None, ""]) if i % 3 else f"own {i}", 1, 2, "x") for i in range(300)]
    return rows + [(0, "own 0", 1, 2, "x"), (None, "own 3", 1, 2, "y"), (None, "alone", 1, 2, "y"), (7, "long " * 20000, 1, 1, "z")]


def test_exact_copies(spark):
    rows = exact_rows()
    got = exact_dedup.mark_exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_drop_keeps_columns(spark):
    docs = spark.createDataFrame(exact_rows(), SCHEMA)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    marked = exact_dedup.mark_exact_duplicates(docs).where("kept")
    key = lambda rows: Counter(r.doc_id for r in rows)
    assert key(kept.collect()) == key(marked.collect())
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_filter_lets_every_repeat_through(spark):
    rows = spark.range(500).select((F.col("id") % 400).cast("string").alias("d"))
    seen = exact_dedup.repeat_filter(rows, "d", exact_dedup.PAGE_BITS)
    tested = exact_dedup.tested(rows.withColumnRenamed("d", "__sha"), seen, exact_dedup.PAGE_BITS).collect()
    maybe = {r["__sha"] for r in tested if r["__maybe"]}
    assert maybe >= {str(i) for i in range(100)} and len(maybe) < 130


def test_hot_groups_join_once(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_groups(rows, groups.where("n > 1"), ["k"], "n", 3000)
    assert joined.count() == 3000 and joined.where("n = 1500").count() == 1500 and joined.where("n is null").count() == 1500


def test_rows_of_a_hot_group_are_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = join_groups(rows, groups, ["k"], "n", 3000).select("*", F.spark_partition_id().alias("part"))
        # The rows themselves: for a count alone Spark would leave out the join.
        sizes = Counter(r["part"] for r in joined.collect())
        assert sum(sizes.values()) == 3000 and max(sizes.values()) < 1200
    finally:
        for k, v in set_before.items():
            spark.conf.set(k, v)


def near_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy  # chains drift, so that ends of a group are not alike
    rows += ["a b", "A  B", "a b c", "", None, "same five words right here", "Same five words\nright here", "x"]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def near_truth(rows):
    sets = {}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_copies(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.mark_near_duplicates(docs).collect()}
    assert got == near_truth(rows)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2]}


def test_near_copies_without_ids(spark):
    rows = [(5, "one two three four five six"), (None, "one two three four five six"), (None, "a text without any id at all"), (None, None), (5, "one two three four five six")]
    got = near_dedup.mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(
        [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 3, None, True), (None, 0, None, True)]
    )
    assert near_dedup.mark_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 100, 5000):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        assert (near_dedup.sketch(a) < np.iinfo(np.uint64).max).all()
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.r_[a[:600], rng.integers(0, 1 << 63, 300).astype(np.uint64)]
    share = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
    assert abs(share - 0.5) < 0.2


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_components_of_paths(spark, n):
    order = random.Random(n).sample(range(n + 1), n + 1)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_archives(spark, tmp_path):
    big, other = "x" * 1500, "é" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "u\nv", "small"), (5, "c", None), (6, "d", other), (None, "e", other), (7, "f", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload_digest", "payload_bytes", "record_type", "refers_to", "__id", "id")}).repartition(2)
    plan = warc.plan_records(pages)
    index = warc.write_bundles(plan, f"file://{tmp_path}/w")
    got = warc.read_bundles(f"file://{tmp_path}/w", warc.read_index(spark, f"file://{tmp_path}/w")).collect()
    kinds = {r.record_id: (r.record_type, r.refers_to) for r in got}
    assert len(got) == len(rows)
    assert kinds == {"1": ("revisit", "2"), "2": ("response", None), "3": ("response", None), "4": ("response", None), "5": ("response", None),
                     "6": ("response", None), None: ("revisit", "6"), "7": ("response", None)}
    texts = {None if r[0] is None else str(r[0]): (r[2] or "").encode() for r in rows}
    for r in got:
        assert r.payload_digest == hashlib.sha1(texts[r.record_id]).hexdigest() and r.payload_bytes == len(texts[r.record_id])
        assert bytes(r.payload) == (texts[r.record_id] if r.record_type == "response" else b"")
    for entry in index.collect():  # one frame is enough for one record
        headers, block = warc.read_record(warc.Store(f"{tmp_path}/w"), entry.asDict())
        assert headers["WARC-Record-ID"] == f"<urn:page:{'' if entry.page_id is None else entry.page_id}>"
        assert int(headers["Content-Length"]) == len(block) and headers["WARC-Date"].endswith("Z") and headers["Content-Type"]
    for file in (tmp_path / "w").glob("*.zst"):  # a plain reader skips the table
        data = zstandard.ZstdDecompressor().stream_reader(file.open("rb"), read_across_frames=True).read()
        assert data.startswith(b"WARC/1.1") and len(data) == sum(n for _, _, n in warc.frames_of(file.read_bytes()))
    assert warc.read_bundles(f"file://{tmp_path}/w", index.limit(0)).count() == 0
    assert warc.plan_records(pages.limit(0)).count() == 0


def base_truth(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {k for spots in at.values() if len(spots) > 1 for i in spots for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    rng = random.Random(5)
    texts = ["", "a", "a b " * 30, "x\ny\nx\n\n\nx ", "# $ % é 😀\x0b&", "one\x1ctwo"]
    texts += ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert perplexity.base_counts(t) == base_truth(t), repr(t)


def kneser_ney_truth(texts, order):
    """log p(last | rest) by the textbook, over strings of classes."""
    grams = Counter()
    for t in texts:
        c = [0] * (order - 1) + perplexity.classes(t).tolist()
        grams.update(tuple(c[i : i + order]) for i in range(len(c) - order + 1))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    shape = {}
    for n, table in levels.items():
        m = Counter(table.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else None
        for k in (1, 2, 3):
            d = k - (k + 1) * y * m[k + 1] / m[k] if y is not None and m[k] else None
            shape[n, k] = d if d is not None and 0 < d < k else 0.5 * k
    sums = {n: defaultdict(list) for n in levels}
    for n, table in levels.items():
        for g, c in table.items():
            sums[n][g[:-1]].append(c)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / perplexity.CLASSES
        rest = sums[n].get(g[:-1])
        if not rest:
            return p(g[1:])
        c = levels[n].get(g, 0)
        back = sum(shape[n, min(x, 3)] for x in rest) / sum(rest)
        return (c - shape[n, min(c, 3)] if c else 0) / sum(rest) + back * p(g[1:])

    return p


def arrays_of(model, folder):
    """The shards of a model of one language, and the arrays that tasks read for each."""
    shards = perplexity._shards(model)
    perplexity.write_shards(model, shards, str(folder))
    return shards, [perplexity._held(str(folder), i, tuple(s.languages)) for i, s in enumerate(shards)]


def test_kneser_ney_is_the_textbook_s(spark, tmp_path):
    rng = random.Random(9)
    texts = ["".join(rng.choice("aab c") for _ in range(80)) for _ in range(6)] + ["Xyz q", ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = perplexity.kneser_ney(perplexity.count_grams(docs, "lang", "text"))
    _, [arrays] = arrays_of(model, tmp_path / "whole")
    truth = kneser_ney_truth(texts, perplexity.ORDER)
    keys, _ = perplexity.grams([*texts, "abz qq", "new stuff"])
    split = lambda k: tuple(int(k) >> (perplexity.BITS * b) & (perplexity.CLASSES - 1) for b in range(perplexity.ORDER - 1, -1, -1))
    got = arrays.log_probability("en", keys)
    for k, x in zip(keys, got, strict=True):
        assert math.isclose(x, math.log(truth(split(k))), abs_tol=1e-4)


def test_contexts_of_a_frequent_symbol_are_split(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaab c") for _ in range(120)) for _ in range(6)] + ["Xyz q"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    model = perplexity.kneser_ney(perplexity.count_grams(docs, "lang", "text"))
    model = perplexity.cut(model)
    keys = np.unique(perplexity.grams([*texts, "abz qq", "new stuff", "caaaaa"])[0])
    whole = arrays_of(model, tmp_path / "whole")[1][0].log_probability("en", keys)
    monkeypatch.setattr(perplexity, "MOST_ENTRIES", 250)
    shards, read = arrays_of(model, tmp_path / "split")
    # The symbols before the letter a are too many for one shard.
    assert max(s.depth for s in shards) >= 2
    owners, parts = np.zeros(len(keys), int), np.zeros(len(keys))
    for shard, arrays in zip(shards, read, strict=True):
        # What every shard has of the shorter ends comes on top; here at most 7 grams and a context each.
        assert len(arrays.key) <= 250 + 8 * shard.depth and (np.diff(arrays.key) > 0).all()
        mine = shard.owns(keys >> perplexity.BITS)
        owners += mine
        parts += np.where(mine, arrays.log_probability("en", keys), 0)
    assert (owners == 1).all()
    assert np.allclose(parts, whole, atol=1e-6)


def test_texts_that_teach_are_distinct_without_a_shuffle_of_all(spark):
    rows = [("en", f"text {i}") for i in range(300)] + [("en", "twice")] * 100 + [("de", "twice"), ("en", ""), ("en", ""), ("en", None), ("en", None)]
    got = perplexity.distinct_texts(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(set(rows), key=str)
    assert perplexity.distinct_texts(spark.createDataFrame(rows[:0], "lang string, text string")).count() == 0


def test_shards_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.createDataFrame([(900, None, None, "s", 0), (901, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    whole = perplexity.judge_quality(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(perplexity, "MOST_ENTRIES", 9000)
    parts = perplexity.judge_quality(docs).orderBy("doc_id").collect()
    assert len(whole) == len(parts) == docs.count()
    for a, b in zip(whole, parts, strict=True):
        assert a.kept == b.kept and (a.log_perplexity == b.log_perplexity or math.isclose(a.log_perplexity, b.log_perplexity, rel_tol=1e-9))
    assert perplexity.judge_quality(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in whole:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_truth(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = left
        left = stage(spark, left, data)
        assert left.columns == docs.columns, name
        left = spark.createDataFrame(left.collect(), docs.schema)
        texts = {r.doc_id: r.text for r in before.collect()}
        got = {r.doc_id: r.text for r in left.collect()}
        assert set(got) <= set(texts)
        if name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                best[lower(t)] = max(i, best.get(lower(t), i))
            assert set(got) == set(best.values())
        if name == "near_dedup":
            assert set(got) == {i for i, v in near_truth(list(texts.items())).items() if v[2]}
        if name == "substring_dedup":
            assert set(got) == set(texts) and all(len(got[i]) <= len(texts[i]) for i in got)
    packed = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left.collect()}
    assert max(Counter(r.sequence_id for r in packed).values()) >= 1


def test_registered_queries_have_the_contract_s_columns(spark):
    data = "/root/testdata/sf0.001"
    want = {
        "op1_warc": "page_id payload_bytes payload_digest record_type refers_to", "op8_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op9_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op2_license_scan": "doc_id canonical_sha256 license",
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, data)
        assert set(columns.split()) <= set(df.columns) and df.count() > 0


def clean_and_junk(letters, joined=" ", seed=11):
    """300 texts of a vocabulary, 33 of random letters, and 33 copies of one more."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(300)]
    clean = [" ".join(joined.join(rng.choice(vocabulary) for _ in range(4)) for _ in range(rng.randint(40, 80))) for _ in range(300)]
    junk = [" ".join(joined.join(word() for _ in range(4)) for _ in range(rng.randint(40, 80))) for _ in range(33)]
    return clean, junk, [" ".join(joined.join(word() for _ in range(4)) for _ in range(60))] * 33


@pytest.mark.parametrize("letters, joined", [("abcdefghijklmnopqrstuvwxyz", " "), ("".join(map(chr, range(0x4E00, 0x5600))), "")])
def test_junk_of_a_tenth_of_a_language_is_rejected(spark, letters, joined):
    clean, junk, copies = clean_and_junk(letters, joined)
    rows = [(i, t, "xx") for i, t in enumerate([*clean, *junk, *copies])]
    got = {r.doc_id: r for r in perplexity.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    kept = [got[i].kept for i in range(len(rows))]
    assert sum(kept[: len(clean)]) >= 0.95 * len(clean)
    assert not any(kept[len(clean) :])


def test_no_two_characters_share_symbols():
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p < 0xE000 and chr(p).lower() == chr(p) and not chr(p).isspace()]
    symbols = perplexity.classes("".join(map(chr, points)))
    assert symbols.min() >= 1 and symbols.max() < perplexity.CLASSES
    single = [tuple(perplexity.classes(chr(p)).tolist()) for p in points[::97]]
    assert len(set(single)) == len(single) and sum(map(len, single)) == len(np.concatenate([perplexity.classes(chr(p)) for p in points[::97]]))


def test_near_copies_with_repeated_ids(spark):
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60))
    near = lambda t: t + " one more"
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(5, a), (3, b), (5, near(b)), (7, c), (7, c), (7, near(c)), (None, d), (None, near(d)), (None, near(a)), (8, None), (8, e), (9, ""), (9, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect())
    left = {t: [r for r in got.elements() if r[1] in (t, near(t))] for t in (a, b, c, d, e)}
    assert left[a] == [(5, a)] and left[b] == [(3, b)] and left[e] == [(8, e)]
    assert [r[0] for r in left[c]] == [7] and [r[0] for r in left[d]] == [None]
    assert sum(got.values()) == 7 and got[8, None] == got[9, ""] == 1


def test_passages_of_repeated_ids(spark):
    rng = random.Random(22)
    words = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage, own = words(60), words(90)
    rows = [(1, f"{words(20)} {passage} {words(20)}"), (2, own), (2, f"{words(20)} {passage} {words(20)}"), (2, None), (3, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.drop_repeated_passages(docs).collect()
    assert len(got) == len(rows)
    texts = {r.text for r in got}
    assert {rows[0][1], own, None, "é"} <= texts
    (rest,) = texts - {rows[0][1], own, None, "é"}
    assert rest.split()[:18] == rows[2][1].split()[:18] and len(rest.split()) < 75


def passages_truth(rows):
    """Windows by the ends of chunks, first occurrences of their bytes and what the others cover, all in memory."""
    least = substring_dedup.LEAST_WORDS
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    windows = {}
    for i, t in set(rows):
        if t:
            raw = t.encode()
            (ends,) = substring_dedup.cut_points([raw])
            bounds = [0, *ends]
            words = [substring_dedup.count_words(raw[a:b]) for a, b in zip(bounds, ends, strict=False)]
            windows[i, t] = own = []
            for k in range(len(ends)):
                upto = next((e for e in range(k + 1, len(ends) + 1) if sum(words[k:e]) >= least), None)
                if upto:
                    own.append((bounds[k], bounds[upto], sum(words[:k]), sum(words[:upto]), raw[bounds[k] : bounds[upto]]))
    first = {}
    for key in sorted(windows, key=lambda k: order((k[0], hash_of[k[1]]))):
        for w in windows[key]:
            first.setdefault(w[4], (key, w[0]))
    out = Counter()
    for key, own in windows.items():
        run = []
        for w in [*own, None]:
            if w is not None and first[w[4]] == (key, w[0]):
                continue
            if run and (w is None or w[0] > run[-1][1]):
                ids = tuple(sorted({first[x[4]][0][0] for x in run if first[x[4]][0][0] is not None}))
                out[key[0], run[0][0], run[-1][1] - run[0][0], run[-1][3] - run[0][2], ids] += 1
                run = []
            run.append(w)
    return out


hash_of = {}


@pytest.mark.parametrize("joined", [" ", ""])
def test_passages_are_those_of_brute_force(spark, joined):
    rng = random.Random(31)
    letters = "abcdefghij" if joined else "".join(map(chr, range(0x4E00, 0x5200)))
    words = lambda n: joined.join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))
    passages = [words(rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [words(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), words(rng.randint(1, 30))]
        rows.append((rng.choice([i, i, i, 3, None]), joined.join(parts)))
    rows += [rows[0], rows[5], (70, None), (71, ""), (3, None), (72, words(20_000) + joined + passages[0]), (73, "a" * 5000), (74, "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hash_of.update({r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    got = Counter((r.doc_id, r.start, r.size, r.words, tuple(r.first_ids)) for r in substring_dedup.repeated_passages(docs.repartition(4)).collect())
    assert got == passages_truth(rows) and len(got) > 20
    cleaned = substring_dedup.drop_repeated_passages(docs).collect()
    assert len(cleaned) == len(rows) and sum(len(r.text or "") for r in cleaned) < sum(len(t or "") for _, t in rows)
    texts = {(i, t) for i, t in rows}
    assert {(r.doc_id, r.text) for r in cleaned} >= {(70, None), (71, ""), (3, None)} & texts


def test_a_passage_without_white_space_is_found(spark):
    rng = random.Random(32)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    passage = text(4000)
    docs = spark.createDataFrame([(1, text(500) + passage + text(300)), (2, text(7) + passage), (3, text(3000))], "doc_id long, text string")
    cleaned = {r.doc_id: r.text for r in substring_dedup.drop_repeated_passages(docs).collect()}
    assert len(cleaned[1]) == 4800 and len(cleaned[3]) == 3000 and len(cleaned[2]) < 200


@pytest.mark.parametrize("n", [300, 3000])
def test_common_words_alone_make_no_passage(spark, n):
    rng = random.Random(33)
    common = [f"c{k}" for k in range(21)]
    passage = " ".join(rng.choice(common) for _ in range(50))
    rows = [(i, " ".join(rng.choice(common) for _ in range(200))) for i in range(n)]
    rows += [(n + k, f"{rows[k][1][:300]} {passage} {rows[k + 9][1][:300]}") for k in range(2)]
    cleaned = {r.doc_id: r.text for r in substring_dedup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = {i for i, t in rows if cleaned[i] != t}
    # The texts planted last share the passage and begin as earlier ones do.
    assert changed == {n, n + 1}
    assert len(rows[-1][1].split()) - len(cleaned[n + 1].split()) >= 35


ODD_NAMES = "`a.b` long, doc_id long, text string, __lost long, __at long, __id long, __of long, __spans long, __key long, id string, at long, c0 long, spans long, start long"


def test_any_names_of_columns(spark):
    rng = random.Random(34)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    long = words(80)
    rows = [(1, long), (2, long + " end"), (3, f"{words(30)} {long} {words(30)}"), (4, None), (None, words(9))]
    docs = spark.createDataFrame([(7, i, t, 1, 2, 3, 4, 5, 6, "x", 8, 9, 10, 11) for i, t in rows], ODD_NAMES)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r["__at"]) for r in kept.collect()) == [(0, 2), (1, 2), (3, 2), (4, 2)]
    cleaned = substring_dedup.drop_repeated_passages(docs)
    assert cleaned.columns == docs.columns and {r.doc_id: len((r.text or "").split()) < 70 for r in cleaned.collect()} == {1: False, 2: True, 3: True, 4: True, None: True}


def test_slots_that_two_windows_have(spark):
    docs = spark.createDataFrame([("one two three four five " * 9,), ("own words of this text only",), (None,), ("",)], "text string").repartition(3)
    bits = substring_dedup.repeated_slots(docs, substring_dedup.PAGE_SLOTS)
    slots = Counter()
    for r in docs.collect():
        found = substring_dedup.windows([(r.text or "").encode()], substring_dedup.LEAST_WORDS).digest
        slots.update((found[:, 0] & (substring_dedup.PAGE_SLOTS - 1)).tolist())
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == {k for k, n in slots.items() if n > 1}


def test_hot_groups_meet_once(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 or k % 3 = 0")
    for total in (3000, 10**9):
        joined = meet_groups(rows, groups, "k", "n", total)
        assert joined.count() == 2000 and joined.where("n = 1500").count() == 1500 and joined.select("id").distinct().count() == 2000
