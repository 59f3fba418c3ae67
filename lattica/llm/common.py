"""Shared plumbing of the training-data operators: lineage cuts and Arrow slices.

Nothing here knows about a particular operator.  Intermediate tables are
written as Parquet below ``spark.checkpoint.dir`` (shared by driver and
executors), so a lost executor costs a re-read and never a re-computation of
the whole chain.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lattica.session import shared_dir, ship

__all__ = ["Scratch", "exists", "freed", "fresh_path", "materialize", "ragged_index", "remove", "shared_dir", "ship", "text_slices"]

def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lattica/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables through Hadoop's own file system classes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), keep: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: a cut of lineage that survives executors.

    Within a ``Scratch`` block the table goes when the block ends, unless it is to be kept.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if _blocks and not keep:
        _blocks[-1].paths.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a write go when it ends, not when the driver's garbage is next collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class Scratch:
    """A block whose intermediate tables go when it ends; what outlives it is written with ``keep``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        _blocks.append(self)
        return self

    def __exit__(self, *_) -> None:
        _blocks.remove(self)
        remove(self.spark, *self.paths)

    def table(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label)[0]


_blocks: list[Scratch] = []


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice holds much more than ``most_bytes`` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start_i, start_i + 1, ... of all rows, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n, e = starts[keep], lengths[keep], ends[keep]
    out[0] = s[0]
    if len(s) > 1:
        out[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
