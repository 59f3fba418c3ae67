"""Time: timelines, cursors, watched folders, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.schema import Graph, given


def timeline(graph: Graph) -> DataFrame:
    """(date, nodes, edges): what is valid at each date that is named anywhere.

    Starts and ends are steps of a running sum over distinct dates; nothing is joined by range.
    """
    parts = []
    for kind, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        item = df.select(given("valid_from").alias("a"), given("valid_to").alias("b"))
        parts.append(item.select(F.lit(kind).alias("kind"), F.coalesce("a", F.lit("")).alias("date"), F.lit(0).alias("late"), F.lit(1).alias("step")))
        parts.append(item.where("b is not null").select(F.lit(kind).alias("kind"), F.col("b").alias("date"), F.lit(1).alias("late"), F.lit(-1).alias("step")))
    steps = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # an end counts after its own day: it is taken off at the next date
    daily = steps.groupBy("date").agg(*[F.sum(F.when((F.col("kind") == k) & (F.col("late") == late), F.col("step")).otherwise(0)).alias(f"{k}_{late}") for k in ("nodes", "edges") for late in (0, 1)])
    upto = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    total = lambda k: (F.sum(f"{k}_0").over(upto) + F.coalesce(F.sum(f"{k}_1").over(before), F.lit(0))).alias(k)
    return daily.select("date", total("nodes"), total("edges")).where("date <> ''")


def after_cursor(rows: DataFrame, cursor: str | None, column: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(rows not strictly older than the cursor, one row with the new cursor)."""
    kept = rows if cursor is None else rows.where(F.col(column) >= cursor)
    return kept, kept.agg(F.max(column).alias("cursor"))


def listing_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, stamp): added, changed or removed."""
    both = old.withColumnRenamed("stamp", "a").join(new.withColumnRenamed("stamp", "b"), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, stamp) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.concat_ws(":", F.col("modificationTime").cast("long"), "length").alias("stamp"))


def watch(spark: SparkSession, path: str, rebuild, checkpoint: str, glob: str = "*.md", once: bool = True):
    """A file stream that calls ``rebuild(batch, id)`` for new files; deletions need ``listing_delta``."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).load(path)
    writer = stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """``ts`` as an event time, which a watermark needs with a zone; the session's zone is UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by event-time window, tumbling or sliding; works on tables and on streams."""
    timed = _timed(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = timed.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = _timed(events, late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; on a stream within the watermark."""
    if events.isStreaming:
        return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
