"""Runs, fingerprints and conversation tries against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import prefix_trie, queries, simhash, tandem_runs
from lamina.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, id string, print long, node long, cell long, label long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], DOCS).repartition(3)


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                out.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def random_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 2, 3, 5, 50])) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        if words:
            at = rng.randrange(len(words))
            words[at:at] = words[at : at + rng.randrange(1, 6)] * rng.randrange(1, 7)
    return [b"%d" % x for x in words]


def test_runs_equal_those_of_all_periods():
    rng = random.Random(3)
    for _ in range(1500):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 4))]
        assert tandem_runs.runs_of_texts(texts) == [plain_runs(w) for w in texts]


def test_vocabulary_has_each_kind_of_tandem_repeat_once():
    rng = random.Random(4)
    for _ in range(300):
        s = np.array([rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(2, 40))] + [9])
        names = tandem_runs.Names(s)
        tree = tandem_runs.SuffixTree(s, names)
        kinds = tandem_runs.vocabulary(tree, *tandem_runs.covering(s, names, tree, len(s)))
        got = [tuple(s[tree.least[v] : tree.least[v] + 2 * q].tolist()) for v, q in kinds]
        x, want = s.tolist(), set()
        for a in range(len(x)):
            for q in range(1, (len(x) - a) // 2 + 1):
                half = x[a : a + q]
                if half == x[a + q : a + 2 * q] and not any(q % d == 0 and half == half[:d] * (q // d) for d in range(1, q)):
                    want.add(tuple(half * 2))
        assert sorted(got) == sorted(want)


def test_long_periods():
    words = [b"%d" % i for i in range(500)]
    assert tandem_runs.runs_of_texts([words + words[:100] * 5 + [b"x"], [b"a"] * 3000]) == [[(500, 500, 100)], [(0, 3000, 1)]]


def expected_runs(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def odd_texts():
    rng = random.Random(5)
    rows = [(None, None), (None, "a " * 50), (1, ""), (1, ""), (2, None), (3, " \t\n\x0b\x0c\r "), (4, "a a a a a"), (5, "a a a a a a"), (6, "É É É É É É É")]
    rows += [(7, "A a " * 30), (7, "A a " * 30), (-8, "one two three " * 40 + "end"), (9, "  x" * 20), (10, "w" * 100_000 + " b b b b b b")]
    rows += [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 300)))) for i in range(20, 120)]
    return rows


def test_op11_over_odd_rows(spark, tmp_path):
    rows = odd_texts()
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_tandem_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.select(names).collect())) == Counter(expected_runs(*r) for r in rows)
    assert sum(expected_runs(*r)[1] > 0 for r in rows if r[0] and r[0] >= 20) > 3


def plain_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def tops(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_pairs(prints):
    p = np.array(prints, np.uint64)
    return [(i, j) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[:i]) <= 3).tolist()]


def test_op12_over_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = odd_texts()
    long = [f"w{rng.randrange(5000)}" for _ in range(400)]
    for i in range(200, 300):
        words = list(long)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(400)] = "new"
        rows.append((i, " ".join(words)))
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_print(t) for _, t in rows]
    top = tops(len(rows), near_pairs(prints))
    least = defaultdict(lambda: None)
    for (i, _), t in zip(rows, top, strict=True):
        if i is not None:
            least[t] = i if least[t] is None else min(least[t], i)
    want = Counter((i, f"{p:016x}", least[t]) for (i, _), p, t in zip(rows, prints, top, strict=True))
    got = queries.op12_simhash(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == want
    assert len({t for _, _, t in want}) > 50 and len(set(prints[-100:])) > 20
    same = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.mark_similar(same).collect()] == [None, None]


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 64, 5000, np.uint64)
    b = a ^ rng.integers(0, 1 << 64, 5000, np.uint64) & rng.integers(0, 1 << 64, 5000, np.uint64)
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(3)) for s in range(0, 64, 2)]).astype(int)
    apart = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == apart).all() and (apart <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("block", [60, 2048])
def test_dense_cells_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, prints = random.Random(8), set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(500):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    own = np.array(sorted(prints), np.uint64)
    at = {x: i for i, x in enumerate(own.view(np.int64).tolist())}
    df = spark.createDataFrame([(x,) for x in at], "print long").repartition(4)
    links = simhash._links(simhash._dealt(cut(simhash._placed(df)))).collect()
    pairs = near_pairs(own)
    assert tops(len(own), [(at[r.a], at[r.b]) for r in links]) == tops(len(own), pairs)
    assert len(links) < len(pairs)


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)

    def sums(k):
        below = [sums(x) for x in children[k]]
        own_saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        return (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))

    out = Counter()
    for k, members in nodes.items():
        leaves, saved = sums(k)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out[
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children[k]), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


TURNS = "conv_id long, turn long, role string, text string, digest string, path string, depth long, key long"


def trie_rows(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], TURNS).repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).select(names).collect()))


def test_op13_over_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, None, "", ""), (0, 3, "a", "bc"), (1, 3, "ab", "c"), (2, 3, "ab", "c"), (2, 3, "ab", "c")]
    rows += [(-7, 1, "user", "é" * 1000), (-5, 1, "user", "x"), (-5, 2, "user", "x" * 200_000), (1 << 62, 5, "user", None)]
    for c in range(10, 260):
        start = rng.randrange(4)
        rows += [(c, t * 2 - 5, rng.choice(["user", "assistant"]) if t > 2 else "user", f"{start if t < 3 else rng.randrange(3)} é") for t in range(rng.randrange(12))]
    rows += [(1000 + k, t, "u", "common") for k in range(300) for t in range(3)] + [(2000, t, "u", str(t)) for t in range(400)]
    assert trie_rows(spark, tmp_path, rows) == plain_trie(rows)


def test_op13_without_rows(spark, tmp_path):
    assert not trie_rows(spark, tmp_path, [])
    assert not trie_rows(spark, tmp_path, [(None, 1, "a", "b")])


def test_members_of_a_key_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = spark.range(-50, 500).select((F.col("id") % 3 == 0).cast("string").cast("binary").alias("k"), "id").repartition(5)
    got = {bytes(r.k): r.members_sha256 for r in prefix_trie.joined_members(rows, "k", "id").collect()}
    for key, hit in ((b"true", True), (b"false", False)):
        ids = ",".join(str(i) for i in range(-50, 500) if (np.fmod(i, 3) == 0) == hit)
        assert got[key] == hashlib.sha256(ids.encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    docs_of(spark, [(1, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_tandem_runs(spark, str(tmp_path)).count() == 0
    assert queries.op12_simhash(spark, str(tmp_path)).count() == 0
