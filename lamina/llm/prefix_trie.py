"""The trie of conversation prefixes, by chained digests.

A node is a distinct sequence of first turns. Its name is a SHA-256 over the name of the
node above and the digest of its last turn, so equal prefixes have equal names wherever
they are made, and only digests and sizes move: a text never leaves the scan.

Every prefix of every conversation is exploded and counted by (depth, digest). Of a
node, the smallest member is also the smallest of all nodes below it on that member's
path, so the nodes of one smallest member are a chain. Sums over subtrees come from
running sums within each chain, and from exploding each chain, its nodes summed up
first, to all ancestors above it. A long conversation that shares only its first turns
costs its length, not the square of it.

A row holds the digests of one conversation, 32 bytes a turn; nothing larger is put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, join_groups

ROOT = hashlib.sha256(b"").digest()
#: Identifiers that one row of text holds while the identifiers of a node are put in a line.
PIECE = 4096
#: Turns after which a task hands on what it has; a conversation is never split.
TURNS = 1 << 16


def conversations_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each turn's digest and the UTF-8 bytes of its text, in order of ``turn``.

    A null turn comes first; turns alike are ordered by their digests, and repeated rows
    are turns of their own. Null roles and texts count as empty. Rows without a
    conversation are left out. Other columns are ignored.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # The length of the role keeps ("ab", "c") and ("a", "bc") apart.
    digest = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(what).cast("long").alias("bytes")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "bytes")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t.digest, t.bytes)).alias("turns"))


def share_first_turns(conversations: DataFrame) -> DataFrame:
    """Each conversation c after the first h turns of conversation c - c % 5, with its own turns from the h-th on; h is crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    first = conversations.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("lent"))
    rows = conversations.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.cast("int").alias("h"))
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.join(first, "base", "left").select("conv_id", F.concat(lent, own).alias("turns"))


def _paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, bytes): the name of the node at every depth, the root's first, and the bytes of its last text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, kinds = hashlib.sha256, [("conv_id", pa.int64()), ("path", pa.list_(pa.binary())), ("bytes", pa.list_(pa.int64()))]
        for batch in batches:
            out, held = [], 0
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name, path, size = ROOT, [ROOT], [0]
                for t in turns.as_py():
                    name = sha(name + t["digest"]).digest()
                    path.append(name)
                    size.append(t["bytes"])
                out.append((conv, path, size))
                held += len(path)
                if held > TURNS:
                    yield _batch(out, kinds)
                    out, held = [], 0
            yield _batch(out, kinds)

    return conversations.select("conv_id", "turns").mapInArrow(run, "conv_id long, path array<binary>, bytes array<long>")


def joined_members(members: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members_sha256) of the rows (key, member): SHA-256 of the members in ascending order, as decimals with commas between.

    A key may have any share of the rows. They are sorted over all tasks, by key and
    member; each task puts up to ``PIECE`` in a row of text, and the rows of a key then
    pass one after another through its digest, so that no task holds a key's members.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def row() -> tuple:
            return held, ids[0], ",".join(map(str, ids))

        for batch in batches:
            out = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != held or len(ids) == PIECE):
                    out.append(row())
                    ids = []
                held = k
                ids.append(m)
            yield _batch(out, [("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        if ids:
            yield _batch([row()], [("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        kinds = [("key", pa.binary()), ("members_sha256", pa.string())]
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == held:
                    state.update(b"," + ids.encode())
                    continue
                if held is not None:
                    out.append((held, state.hexdigest()))
                held, state = k, hashlib.sha256(ids.encode())
            yield _batch(out, kinds)
        if held is not None:
            yield _batch([(held, state.hexdigest())], kinds)

    rows = members.select(F.col(key).alias("key"), F.col(member).alias("member"))
    lined = rows.repartitionByRange("key", "member").sortWithinPartitions("key", "member").mapInArrow(pieces, "key binary, first long, ids string")
    dealt = lined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, members_sha256 string")
    return dealt.select(F.col("key").alias(key), "members_sha256")


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, turns), see :func:`conversations_of`.

    digest names the node; conv_id is its smallest member and parent_conv_id its parent's
    (null at the root); n_convs counts the members, n_children the children, n_leaves
    the nodes without children in the subtree, itself included; saved_tokens sums, over the subtree,
    each node's (n_convs - 1) times the bytes of its last text; ends_sha256 is the digest
    of the decimal ids of those members that end here. Conversations without turns are
    members of the root. An empty table gives no node.
    """
    paths = cut(_paths(conversations))
    prefixes = paths.select("conv_id", F.size("path").alias("n"), F.posexplode(F.arrays_zip("path", "bytes")).alias("depth", "at"))
    counted = prefixes.groupBy("depth", F.col("at.path").alias("digest")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("at.bytes").alias("bytes"),
        F.sum((F.col("depth") + 1 < F.col("n")).cast("long")).alias("onward"),
    )
    chain = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    below = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = cut(
        counted.select(
            "depth", "digest", "conv_id", "n_convs",
            F.sum(own).over(below).alias("saved"),
            F.sum((F.col("onward") == 0).cast("long")).over(below).alias("leaves"),
            F.lag("depth").over(chain).isNotNull().cast("long").alias("children"),
            F.lead("depth").over(chain).isNull().alias("top"),
        )
    )
    # Above a chain stand nodes of other chains; each gets the sums of the whole chain.
    tops = cut(nodes.where("top AND depth > 0").select("conv_id", "depth", "saved", "leaves").join(paths.select("conv_id", "path"), "conv_id"))
    given = tops.select(F.col("depth").alias("top"), "saved", "leaves", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("depth", "digest"))
    given = given.groupBy("depth", "digest").agg(
        F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.sum((F.col("depth") + 1 == F.col("top")).cast("long")).alias("more_children")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    whole = cut(
        nodes.join(given, ["depth", "digest"], "left").select(
            "depth", "digest", "conv_id", "n_convs", "top", (F.col("children") + zero("more_children")).alias("n_children"),
            (F.col("leaves") + zero("more_leaves")).alias("n_leaves"), (F.col("saved") + zero("more_saved")).alias("saved_tokens"),
        )
    )
    # A node within a chain has its parent there; a top may share its parent with any number of others.
    asked = tops.select("conv_id", "depth", (F.col("depth") - 1).alias("above"), F.element_at("path", F.col("depth")).alias("over"))
    parents = whole.where("n_children > 0").select(F.col("depth").alias("above"), F.col("digest").alias("over"), F.col("conv_id").alias("parent"), "n_children")
    found = join_groups(asked, parents, ["above", "over"], "n_children", whole.count()).select("conv_id", "depth", "parent")
    ends = joined_members(paths.select("conv_id", F.element_at("path", -1).alias("digest")), "digest", "conv_id")
    named = whole.join(found, ["conv_id", "depth"], "left").join(ends, "digest", "left")
    return named.select(
        "digest", "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("members_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )
