"""Helpers shared by the training-data operators.

Everything here keeps the same three promises: no text is ever gathered on the
driver, nothing is broadcast whose size is not bounded by a stated constant, and
lineage is cut only in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many groups can each hold a thousandth of the rows.
HOT_GROUPS = 1000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for files that other executors must see, named by ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine (a local master, as in tests) gets a
    temporary folder; on a cluster that would lose files, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the folder of :func:`shared_folder` and reads it from there.

    The files go when the result is no longer referenced and
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text):
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a row is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 16)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per key of ``groups``, hot keys apart.

    ``size`` is a column of ``groups`` with the rows of each key, ``total`` the rows in
    all. Keys with more than a thousandth of the rows are at most ``HOT_GROUPS``; that
    bound makes their broadcast safe, and takes them out of the shuffle of the rest, in
    which no key then holds more than a thousandth of the rows.
    """
    extra = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * HOT_GROUPS > F.lit(total)).select(
        *keys, *[F.col(c).alias(f"__hot_{c}") for c in extra], F.lit(True).alias("__hot")
    )
    # Zero, as no size is less, but no constant: Catalyst would fold a constant into a
    # condition on ``rows`` alone and leave it out of the keys of the shuffle.
    none = F.least(F.col(size), F.lit(0)).cast("long")
    rest = groups.where(F.col(size) * HOT_GROUPS <= F.lit(total)).withColumn("__apart", none)
    # Rows of hot keys are settled by the broadcast. They meet nothing in the shuffle, and
    # a part of the key of their own spreads them over it.
    own = F.when(F.col("__hot"), F.xxhash64(*rows.columns).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("__apart", own)
    joined = marked.join(rest, [*keys, "__apart"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{c}", c).alias(c) for c in extra])


def meet_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key of ``groups``, hot keys apart as in :func:`join_groups`.

    Hot keys, ``HOT_GROUPS`` at most, go to the driver. ``rows`` are read twice if there
    are any, so their lineage should be cut.
    """
    hot = groups.where(F.col(size) * HOT_GROUPS > F.lit(total))
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return rows.join(groups, key)
    inside = F.col(key).isin(keys)
    return rows.where(inside).join(F.broadcast(hot), key).unionByName(rows.where(~inside).join(groups.where(~inside), key))
