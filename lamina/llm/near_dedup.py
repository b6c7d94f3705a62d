"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``T`` coordinates. In each round every shingle is hashed to a coordinate and
a value; values of later rounds are larger, and a coordinate keeps its smallest. The
first ``T`` rounds choose the coordinate at random, the next ``T`` take them in turn, so
every coordinate is filled; the share of equal coordinates concentrates around the
Jaccard similarity. Bands of four coordinates propose candidates. Documents with the
same set are one node from the start.

In a bucket no list of all pairs is made. Every member is compared with a leader, the
smallest, and groups of copies are mostly connected by that. In the buckets that are
not, the members outside the largest component are compared with all others, in blocks
of bounded size that give nothing but links. So no link between candidates is lost. A
bucket of n sets that are all unlike, which takes texts that agree on a band by chance or
by design, ships each set once for every block of others, n * n / BLOCK in all.

Buckets and leaders that many rows share are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, join_groups, meet_groups, raw_texts, slices

T, ROWS = 128, 4
BANDS = T // ROWS
SHINGLE = 5
#: Nodes of a block; a task holds the sets of two.
BLOCK = 256
PERCENT = 75

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
ROUND = np.arange(1, 2 * T + 1, dtype=np.uint64) * _STEP


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words, or of all words if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    got = np.full(n, np.uint64(width))
    for k in range(width):
        got = mix(got * _STEP + hashed[k : k + n])
    return np.unique(got)


def sketch(shingles: np.ndarray) -> np.ndarray:
    out = np.full(T, np.iinfo(np.uint64).max)
    low = np.uint64((1 << 50) - 1)
    for i in range(2 * T):
        hashed = mix(shingles + ROUND[i])
        value = (np.uint64(i) << np.uint64(50)) | (hashed & low)
        if i < T:
            np.minimum.at(out, (hashed >> np.uint64(57)).astype(np.intp), value)
        else:
            out[i - T] = min(out[i - T], value.min())
        if (out < np.iinfo(np.uint64).max).all():
            break
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64)


def words_of(text: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; so does bytes' own lower() and split()."""
    return text.lower().split()


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, high, low, keys = [], [], [], []
            for text in raw_texts(part, "text"):
                shingles = shingle_set(words_of(text))
                digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
                n.append(len(shingles))
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                keys.append(bands(sketch(shingles)).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("at"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.binary())],
                names=["id", "at", "n", "high", "low", "keys"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("at"))
    return rows.mapInArrow(run, f"id {kind}, at long, n long, high long, low long, keys binary")


def _exploded(rows: DataFrame) -> DataFrame:
    """(bucket, node) of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                flat = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64)
                node = np.repeat(part.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node)], names=["bucket", "node"])

    return rows.select("node", "keys").mapInArrow(run, "bucket long, node long")


def _sets(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes (node, id, at) asked for; the texts are read again, and only these move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            got = [shingle_set(words_of(t)).view(np.int64) for t in raw_texts(part, "text")]
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "shingles"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("__at"))
    rows = rows.join(nodes, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__at") == F.col("at")))
    # Rows that repeat an id and a text hold the same set.
    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets meet the threshold; a set of ``a`` goes to one task for every ``BLOCK`` pairs."""
    fans = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    fans = cut(fans)
    total = fans.agg(F.sum("n")).first()[0] or 1
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    dealt = meet_groups(pairs, fans, "a", "n", total).select("a", "b", part.alias("part"))
    left = sets.withColumnRenamed("node", "a").join(fans, "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("sa")
    )
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = dealt.join(left, ["a", "part"]).join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    met = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb") - shared).alias("u"))
    return met.where(F.col("i") * 100 >= F.col("u") * PERCENT).select("a", "b")


def _relabel(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """(node, label) with the labels that ``moved`` (label, to) names replaced.

    The join is the last thing of its stage, so Spark itself deals out a label that many nodes have.
    """
    return cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node connected to it.

    Every node hooks to its smallest smaller neighbour; edges are then drawn between what
    their ends hook to. Each round removes all nodes but the local minima.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        hook = edges.groupBy("a").agg(F.min("b").alias("to"))
        # Two hooks at once; what is left of a chain is followed in the next rounds.
        onward = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hook = cut(hook.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to")))
        to_a, to_b = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        drawn = edges.join(to_a, "a").join(to_b, "b", "left").select("ra", F.coalesce("rb", "b").alias("rb"))
        edges = cut(
            drawn.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        )
        labels = _relabel(labels, hook.toDF("label", "to"))
    while True:
        onward = labels.where("node <> label").toDF("label", "to")
        if onward.join(labels.select("label").distinct(), "label", "left_semi").isEmpty():
            return labels
        labels = _relabel(labels, onward)


def _buckets(members: DataFrame, total: int) -> DataFrame:
    """(bucket, node, first) of buckets with two nodes or more, each set of nodes once; ``total`` members in all."""
    summary = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("node").alias("first"), F.sum(F.xxhash64("node") % (1 << 40)).alias("s1"),
        F.sum(F.xxhash64("node", F.lit(1)) % (1 << 40)).alias("s2"),
    )
    alike = cut(summary.where("n > 1").groupBy("n", "first", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "first", "n"))
    return meet_groups(members, alike, "bucket", "n", total).select("bucket", "node", "first")


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their labels."""
    known = cut(members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")))
    mixed = known.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    mixed = cut(mixed.select("bucket", "n"))
    return meet_groups(known, mixed, "bucket", "n", known.count()).drop("n")


def _blockwise_links(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket (bucket, node, label) with different labels.

    The members outside a bucket's largest component are its queries, and meet all of its
    members. Both are dealt into blocks of about ``BLOCK`` nodes; a task gets the sets of
    one block of either kind, never a bucket as a whole, and makes no pairs but links.
    """
    size = left.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = size.groupBy("bucket").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside")
    )
    main = cut(main)
    placed = meet_groups(left, main, "bucket", "n", main.agg(F.sum("n")).first()[0] or 1).select(
        "bucket", "node", "label", (F.col("label") != F.col("main")).alias("asks"),
        F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("outside") / BLOCK).alias("query_blocks"),
    )
    at = F.pmod(F.xxhash64("node"), F.col("blocks"))
    asks_at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("query_blocks"))
    placed = placed.select("*", at.alias("at"), asks_at.alias("asks_at"))
    answers = placed.select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("query_blocks") - 1)).alias("q"), F.col("at").alias("m"), "node", "label",
        "asks", "asks_at",
    ).select("bucket", "q", "m", "node", "label", (F.col("asks") & (F.col("q") == F.col("asks_at"))).alias("query"), F.lit(True).alias("member"))
    queries = placed.where("asks").select(
        "bucket", F.col("asks_at").alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("m"), "node", "label", "at"
    ).where("m <> at").select("bucket", "q", "m", "node", "label", F.lit(True).alias("query"), F.lit(False).alias("member"))
    rows = answers.unionByName(queries).join(sets, "node")

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        query = np.flatnonzero(table.column("query").to_numpy(zero_copy_only=False))
        member = np.flatnonzero(table.column("member").to_numpy(zero_copy_only=False))
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        flat = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(node)), sizes)
        _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n[column] > 1
        column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
        met = np.zeros((len(query), len(member)), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        place_q, place_m = np.full(len(node), -1), np.full(len(node), -1)
        place_q[query], place_m[member] = np.arange(len(query)), np.arange(len(member))
        width = 2048
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [first, first + width])
            c, o = column[lo:hi] - first, owner[lo:hi]
            a, b = np.zeros((len(query), width), np.float32), np.zeros((len(member), width), np.float32)
            in_q, in_m = place_q[o] >= 0, place_m[o] >= 0
            a[place_q[o[in_q]], c[in_q]] = 1
            b[place_m[o[in_m]], c[in_m]] = 1
            met += a @ b.T
        union = sizes[query][:, None] + sizes[member][None] - met
        i, j = np.nonzero((met * 100 >= union * PERCENT) & (label[query][:, None] != label[member][None]))
        # One link from a query to each component says all.
        _, once = np.unique(np.c_[i, label[member][j]], axis=0, return_index=True)
        x, y = node[query][i[once]], node[member][j[once]]
        return pa.table({"a": pa.array(np.maximum(x, y), pa.int64()), "b": pa.array(np.minimum(x, y), pa.int64())})

    return rows.groupBy("bucket", "q", "m").applyInArrow(find, "a long, b long").distinct()


def _settled(docs: DataFrame) -> DataFrame:
    """(id, at, n, lead) of every row of ``docs`` (id, text).

    ``at`` is the hash of the text; with the id it names the row. ``lead`` has the id and
    ``at`` of the first row of the component, rows without an id last; null without words.
    """
    sketched = cut(_sketched(docs, "id", "text"))
    total = sketched.count()
    filled = sketched.where("n > 0")
    # A set is a node, named by half of its digest, so an id may stand for any number of them.
    groups = cut(
        filled.groupBy("high", "low").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("own"), F.count("*").alias("copies"))
        .withColumn("node", F.col("high"))
    )
    leading = groups.select("node", F.col("own.id").alias("own_id"), F.col("own.at").alias("own_at"))
    of_own = (F.col("high") == F.col("node")) & F.col("id").eqNullSafe(F.col("own_id")) & (F.col("at") == F.col("own_at"))
    first = cut(filled.join(leading, of_own).select("node", "keys").dropDuplicates(["node"]))
    members = cut(_buckets(_exploded(first), BANDS * groups.count()))
    star = cut(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    wanted = members.select("node").distinct()
    sets = cut(_sets(docs, "id", "text", leading.toDF("node", "id", "at").join(wanted, "node")))
    links = _linked(star, sets)
    labels = components(links)
    # What has led was compared with its whole bucket, so only the others are left in it.
    left = cut(_unresolved(members.where("node <> first").select("bucket", "node"), labels))
    new = cut(_blockwise_links(left, sets))
    if not new.isEmpty():
        # Labels of labels: only components that a new link joins change.
        ends = new.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        joined = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
        fresh = joined.join(labels, "node", "left_anti")
        labels = cut(_relabel(labels, joined.toDF("label", "to")).unionByName(fresh.select("node", "label")))
    labelled = cut(groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    leads = labelled.groupBy("label").agg(F.min("own").alias("lead"), F.count("*").alias("sets"))
    named = join_groups(labelled.select("high", "low", "copies", "label"), leads.where("sets > 1"), ["label"], "sets", total)
    named = named.join(labelled.select("high", "low", "own"), ["high", "low"]).select("high", "low", "copies", F.coalesce("lead", "own").alias("lead"))
    settled = join_groups(filled.select("id", "at", "n", "high", "low"), named, ["high", "low"], "copies", total)
    empty = sketched.where("n = 0").select("id", "at", "n")
    return settled.select("id", "at", "n", "lead").unionByName(empty, allowMissingColumns=True)


def mark_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id, kept.

    A text is lower-cased in A-Z and split at ASCII white space; its set has the distinct
    runs of five words, or the whole sequence if it has fewer. Documents are linked if
    100 * intersection >= 75 * union; those without words are linked with none, and have
    n_shingles 0 and themselves as component. component_id is the smallest id that links
    reach, and kept says whether it is the row's own. Rows are linked by their texts, so
    rows that repeat an id are marked apart if their texts differ. Rows without an id are
    linked as any others; their component is null if none in it has an id, and they are
    then kept. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = _settled(docs).withColumn("component", F.when(F.col("n") > 0, F.col("lead.id")).otherwise(F.col("id")))
    return marked.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one with the smallest id, whatever ids repeat or are null.

    A null id is larger than all others. Of rows alike in id and text one stays. Texts
    that are null, empty or without words are linked with nothing, and all such rows
    stay. Ids may have any type; the columns keep theirs, whatever their names. An empty
    table gives an empty result.
    """
    rows = cut(_settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    leads = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("at") == F.col("lead.at"))
    lost = rows.where((F.col("n") > 0) & ~leads).select("id", "at").distinct()
    # Names of their own, as those of ``docs`` may be any.
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own_id, own_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    same = F.col(own_id).eqNullSafe(F.col("id")) & (F.xxhash64(own_text) == F.col("at"))
    kept = plain.join(lost, same, "left_anti")
    # Rows alike in id and text, of which the join above keeps all or none.
    alike = cut(rows.where((F.col("n") > 0) & leads).groupBy("id", "at").count().where("count > 1").select("id", "at"))
    if not alike.isEmpty():
        kept = kept.join(alike, same, "left_anti").unionByName(kept.join(alike, same, "left_semi").dropDuplicates([own_id, own_text]))
    return kept.toDF(*names)
