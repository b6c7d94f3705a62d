"""Document JSON as a format of Spark: batches, streams and a writer.

    spark.dataSource.register(DocumentFormat)
    spark.read.format("layered_documents").load(folder)                                # file, symbols
    spark.read.format("layered_documents").option("layers", "tokens,rows").load(folder)  # their annotations
    spark.readStream.format("layered_documents").load(folder)
    docs.select("file", "json").write.format("layered_documents").mode("append").save(folder)

A folder has one file for each document, and is one that all executors see. A task reads a range of
files, so what is in memory at once is one document. Options: ``layers`` (a list with commas, or
``*`` for all) and ``filesPerTask``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lamina.sources.documents import BOX, RESERVED

DOCUMENTS = "file string, symbols string"
ANNOTATIONS = f"file string, field string, pos bigint, id int, type string, text string, spans array<struct<start:int,end:int,box:{BOX}>>, boxes array<{BOX}>"


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


def _box(box: dict | None) -> tuple | None:
    return None if box is None else (*(float(box[c]) for c in ("left", "top", "width", "height")), int(box["page"]))


def _annotation(group: dict) -> tuple:
    """id, type, text, spans and boxes; type and text of older documents are in the group itself."""
    metadata = group.get("metadata")
    held = group if metadata is None else metadata
    boxes = (group.get("box_group") or {}).get("boxes")
    return (
        group.get("id"), held.get("type"), held.get("text"), [(s["start"], s["end"], _box(s.get("box"))) for s in group.get("spans") or []],
        None if boxes is None else [_box(b) for b in boxes],
    )


class _Reading:
    def __init__(self, options: dict):
        self.folder, self.layers, self.per_task = options["path"], options.get("layers"), int(options.get("filespertask", 100))

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(".json") and not n.startswith("."))

    def tasks(self, names: list[str]) -> list[Files]:
        return [Files(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                document = json.load(f)
            if self.layers is None:
                yield name, document.get("symbols")
                continue
            wanted = [k for k in document if k not in RESERVED] if self.layers == "*" else self.layers.split(",")
            for field in wanted:
                for pos, group in enumerate(document.get(field) or []):
                    yield name, field, pos, *_annotation(group)


class Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.tasks(self.names()) or [Files([])]


class Stream(_Reading, DataSourceStreamReader):
    """Files in the order of their names: a later one must have a later name, as with a time in front."""

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        return {"upto": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.tasks([n for n in self.names() if start["upto"] < n <= end["upto"]])


class Writer(DataSourceWriter):
    """Each task writes under names of its own; a commit gives the files theirs, so a task that runs again leaves no second file."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("documents are added to a folder: use mode append")
        self.folder = options["path"]

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        names = []
        for row in rows:
            if os.path.basename(row["file"]) != row["file"] or not row["file"].endswith(".json"):
                raise ValueError(f"no name for a document: {row['file']}")
            own = f".{uuid.uuid4().hex}"
            with open(os.path.join(self.folder, own), "w", encoding="utf-8") as f:
                f.write(row["json"])
            names.append((own, row["file"]))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        for own, name in (n for m in messages if m for n in m.names):
            os.replace(os.path.join(self.folder, own), os.path.join(self.folder, name))

    def abort(self, messages: list[Written | None]) -> None:
        for own, _ in (n for m in messages if m for n in m.names):
            os.remove(os.path.join(self.folder, own))


class DocumentFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layered_documents"

    def schema(self) -> str:
        return DOCUMENTS if self.options.get("layers") is None else ANNOTATIONS

    def reader(self, schema) -> DataSourceReader:
        return Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Stream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, overwrite)
