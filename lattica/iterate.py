"""Cuts of lineage for loops, and numbers for rows in order: both in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint, in the shared folder unless the context names another."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for loops of many rounds.

    A checkpoint hands the optimizer what it knew of its rows; over rounds of joins that knowledge
    doubles, and planning with it.  A table starts anew.
    """
    path = f"{shared_dir(df.sparkSession)}/lattica/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``table`` wrote; nothing may read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lattica/round-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, *by: Column | str, name: str = "n", start: int = 1) -> DataFrame:
    """``df`` with the place of each row in the order ``by``, from ``start`` on.

    Rows are sorted over range partitions; only the partitions' sizes, one row each,
    meet in one task to become offsets.
    """
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut(sorted_.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + start).drop("_part", "_place", "_before")
