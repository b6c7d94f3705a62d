"""WARC bundles of independent Zstandard frames with a seek table.

A bundle is a run of frames, each holding a few whole WARC records, and then a seek
table: a skippable frame that lists the compressed and uncompressed size of every
frame, as the seekable format of Zstandard has it. Any Zstandard reader can decompress
a bundle; one that knows the table can decompress a single frame. An index, stored as a
table beside the bundles, maps each record identifier to its bundle, its frame and its
offset in that frame, and records are read by it.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import cut, join_groups, slices
from lamina.llm.exact_dedup import filter_bits, repeat_filter, tested

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Uncompressed bytes after which a frame, and compressed bytes after which a bundle, ends.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20

INDEX = "bundle string, frame int, frame_start long, frame_size long, offset long, size long"


@dataclass(frozen=True)
class Store:
    """Where bundles are written; any place that pyarrow's file systems reach."""

    folder: str

    def open(self):
        from pyarrow import fs

        where = self.folder.replace("s3a://", "s3://", 1)
        if "://" not in where:
            where = where.removeprefix("file:")
            return fs.LocalFileSystem(), where
        return fs.FileSystem.from_uri(where)


def record(identifier: str, kind: str, url: str | None, digest: str, refers_to: str | None, length: int, payload: bytes, date: str) -> bytes:
    """One WARC record; a revisit has no block, but says how long the payload was."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{identifier}>", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"X-Payload-Length: {length}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    lines = data[at : body - 4].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    end = body + int(headers["Content-Length"])
    return headers, data[body:end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", packed, plain) for packed, plain in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, by the table at the end."""
    n, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, start = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, len(bundle) - 9 - width * (n - k))
        out.append((start, packed, plain))
        start += packed
    return out


class _Writer:
    """Bundles of one task. Names carry the attempt, so a task that runs again never writes over another."""

    def __init__(self, store: Store):
        self.fs, self.folder = store.open()
        self.fs.create_dir(self.folder, recursive=True)
        self.level = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.name = ""
        self._reset()

    def _reset(self) -> None:
        self.packed, self.frames = io.BytesIO(), []
        self.open_frame, self.waiting = io.BytesIO(), []

    def add(self, row: int, data: bytes) -> list[tuple]:
        """The index entries of the rows that this ends up placing."""
        if not self.name:
            self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        self.waiting.append((row, self.open_frame.tell(), len(data)))
        self.open_frame.write(data)
        return self.end_frame() if self.open_frame.tell() >= FRAME_BYTES else []

    def end_frame(self) -> list[tuple]:
        if not self.waiting:
            return []
        packed = self.level.compress(self.open_frame.getvalue())
        start, number = self.packed.tell(), len(self.frames)
        self.packed.write(packed)
        self.frames.append((len(packed), self.open_frame.tell()))
        placed = [(row, self.name, number, start, len(packed), at, size) for row, at, size in self.waiting]
        self.open_frame, self.waiting = io.BytesIO(), []
        if self.packed.tell() >= BUNDLE_BYTES:
            self.end_bundle()
        return placed

    def end_bundle(self) -> None:
        if self.frames:
            self.packed.write(seek_table(self.frames))
            # The name must not lead pyarrow to compress once more.
            with self.fs.open_output_stream(posixpath.join(self.folder, self.name), compression=None) as out:
                out.write(self.packed.getvalue())
        self.name = ""
        self._reset()


def plan_records(
    pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", revisit_bytes: int = 1000
) -> DataFrame:
    """The three columns named, and payload_bytes, payload_digest, record_type and refers_to.

    The payload is the text in UTF-8; null is empty. Of equal payloads of at least
    ``revisit_bytes`` bytes the largest id is the response, and the others revisit it.
    Rows that repeat the id of a response are responses too; a null id never wins over
    another, and rows whose group has null ids only are responses. Other columns of
    ``pages`` are ignored, whatever their names; an empty table gives an empty result.

    Only pages whose digest may occur twice are shuffled; the others pass straight through.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    marked = pages.select(
        F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(payload_col).alias("__payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"),
    )
    long = cut(marked.where(F.col("payload_bytes") >= revisit_bytes).select("__id", "payload_digest"))
    total = long.count()
    bits = filter_bits(total)
    seen = cut(repeat_filter(long, "payload_digest", bits))
    groups = cut(long.groupBy("payload_digest").agg(F.max("__id").alias("__first"), F.count("*").alias("__n")).where("__n > 1"))
    found = tested(marked, seen, bits, "payload_digest").withColumn("__maybe", F.col("__maybe") & (F.col("payload_bytes") >= revisit_bytes))
    joined = join_groups(found.where("__maybe").drop("__maybe"), groups, ["payload_digest"], "__n", max(total, 1))
    alone = found.where("not __maybe").drop("__maybe")
    both = joined.unionByName(alone, allowMissingColumns=True)
    revisit = F.coalesce(~F.col("__id").eqNullSafe(F.col("__first")) & F.col("__n").isNotNull(), F.lit(False))
    return both.select(
        F.col("__id").alias(id_col), F.col("__url").alias(url_col), F.col("__payload").alias(payload_col), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to"),
    )


def write_bundles(
    records: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Writes the rows of :func:`plan_records`; gives the index, with one row per record, as it stands in ``folder``/index.

    Only bundles that the index names belong to the archive: a task that was lost may
    have left others. All records have the time of this call as their date.
    """
    kind = records.schema[id_col].dataType.simpleString()
    store = Store(folder)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, ids = _Writer(store), []
        fields = [x.split() for x in INDEX.split(", ")]
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}

        def index(placed: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*placed, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r in columns[0]], id_type)]
                + [pa.array(c, types[t]) for c, (_, t) in zip(columns[1:], fields, strict=True)],
                names=[id_col, *[n for n, _ in fields]],
            )

        placed: list[tuple] = []
        id_type = pa.int64()
        for part in slices(batches, "payload"):
            id_type = part.schema.field("id").type
            for row in part.to_pylist():
                ids.append(row["id"])
                data = record(
                    "" if row["id"] is None else str(row["id"]), row["kind"], row["url"], row["digest"],
                    None if row["refers_to"] is None else str(row["refers_to"]), row["length"], row["payload"] or b"", date,
                )
                placed += writer.add(len(ids) - 1, data)
            if placed and not writer.waiting:
                yield index(placed)
                placed, ids = [], []
        placed += writer.end_frame()
        writer.end_bundle()
        if placed:
            yield index(placed)

    rows = records.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col("record_type").alias("kind"),
        F.col("payload_digest").alias("digest"), "refers_to", F.col("payload_bytes").alias("length"),
        F.when(F.col("record_type") == "response", F.col(payload_col).cast("binary")).alias("payload"),
    )
    rows.mapInArrow(run, f"`{id_col}` {kind}, {INDEX}").write.parquet(posixpath.join(folder, "index"))
    return read_index(records.sparkSession, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(folder, "index"))


#: Columns of a record that was read.
RECORD = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read_bundles(folder: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` names: record_id, record_type, url, payload_digest, payload_bytes, refers_to, payload.

    Each is read at its offset; rows of the index that follow each other in a frame share
    one read of it. The id of a null id is null; the block of a revisit is empty. An index
    without rows gives no records.
    """
    store = Store(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = store.open()
        plain = zstandard.ZstdDecompressor()
        out_type = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in RECORD.split(", ")]
        bare = lambda x: x[len("<urn:page:") : -1] if x else None
        at, file, data = None, None, b""
        rows, held = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, out_type.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names
            )

        for batch in batches:
            for bundle, start, size, offset in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame_start", "frame_size", "offset")], strict=True):
                if (bundle, start) != at:
                    if at is None or bundle != at[0]:
                        file = fs.open_input_file(posixpath.join(where, bundle))
                    file.seek(start)
                    data, at = plain.decompressobj().decompress(file.read(size)), (bundle, start)
                headers, block, _ = parse(data, offset)
                rows.append((
                    bare(headers["WARC-Record-ID"]) or None, headers["WARC-Type"], headers.get("WARC-Target-URI"),
                    headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"]), bare(headers.get("WARC-Refers-To")), block,
                ))
                held += len(block) + 200
                if held > 1 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return index.select("bundle", "frame_start", "frame_size", "offset").mapInArrow(run, RECORD)


def read_record(store: Store, entry: dict) -> tuple[dict[str, str], bytes]:
    """Headers and block of one index entry; reads a single frame of its bundle."""
    fs, folder = store.open()
    with fs.open_input_file(posixpath.join(folder, entry["bundle"])) as file:
        file.seek(entry["frame_start"])
        data = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(entry["frame_size"]))
    headers, block, _ = parse(data, entry["offset"])
    return headers, block
