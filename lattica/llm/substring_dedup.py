"""Substring dedup (operator 7): content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes has
``MASK_BITS`` zero bits, so cuts depend on the content around them alone and
come back in step after an insertion.  From one cut the next is the first such
place at least ``LEAST`` bytes on, or the one ``MOST`` bytes on where none comes before.
Chunks are known by 128-bit digests; of equal chunks in different documents the
first in the order of (id, text hash) is the original, all others are copies, in whatever
order the table holds its rows.  A run
of neighbouring repeated chunks of at least ``RUN_BYTES`` is a repeated passage.

Texts are sorted over range partitions first, so that a row's number tells its place in that
order; chunks are made once and written to the shared folder; the count of digests is an
aggregate that combines before the shuffle, and the join back is one that adaptive
execution splits where a chunk is very frequent.  No group is collected.

Defined results: null or empty texts have no chunks and no passages; a row is
known by its place in the order of (id, null first, text hash), so equal or null ids keep rows of
their own; rows equal in both are alike, so it is no matter which of them comes first;
chunks that repeat only within one row are left alone; in ``remove_repeats`` rows
equal in id and text are one document; an empty table gives no
rows; other columns are ignored by ``repeated_spans`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, materialize, ship, text_slices

SPAN = 32
MASK_BITS = 5
LEAST, MOST = 16, 512
RUN_BYTES = 200


def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 32-bit values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, lengths: np.ndarray, gear: np.ndarray, mask_bits: int = MASK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the chunks of all texts, one after the other in ``data``; chunks never cross texts."""
    h = gear[data]
    reach = 1
    while reach < SPAN:  # doubling: the hash of the last 2 * reach bytes from two of reach bytes
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    at = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1  # a cut stands after the byte
    owner = np.searchsorted(ends, at, side="left")
    at = np.append(at[at - starts[owner] >= SPAN], np.iinfo(np.int64).max)
    here, stop = starts[lengths > 0], ends[lengths > 0]
    begins = [here]
    while len(here):  # the next cut of all texts at once
        there = np.minimum(np.minimum(at[np.searchsorted(at, here + LEAST)], here + MOST), stop)
        here, stop = there[there < stop], stop[there < stop]
        begins.append(here)
    begin = np.sort(np.concatenate(begins))
    return begin, np.diff(np.append(begin, len(data)))


def chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, doc_id, th, start, size, a, b): chunks with their digests; rows are numbered in the order of (key, text hash)."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        row = TaskContext.get().partitionId() << 33
        digest = xxhash.xxh3_128_intdigest
        low = (1 << 64) - 1
        for b in text_slices(batches, "text"):
            texts = pc.fill_null(b.column("text"), "").cast(pa.binary())
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = b"".join(texts.to_pylist())
            begin, size = cuts(np.frombuffer(raw, np.uint8), lengths, gear)
            ends = np.cumsum(lengths)
            owner = np.searchsorted(ends, begin, side="right")
            view = memoryview(raw)
            marks = [digest(view[a:e]) for a, e in zip(begin.tolist(), (begin + size).tolist())]
            place = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + owner), b.column("doc_id").take(place), b.column("th").take(place), pa.array((begin - (ends - lengths)[owner]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.fromiter((m & low for m in marks), np.uint64, len(marks)).view(np.int64)), pa.array(np.fromiter((m >> 64 for m in marks), np.uint64, len(marks)).view(np.int64))],
                ["row", "doc_id", "th", "start", "size", "a", "b"],
            )
            row += b.num_rows

    named = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("at"), F.col(text).alias("text"))
    order = ["doc_id", "th", "at"]  # the last spreads rows that are equal in both
    return named.repartitionByRange(*order).sortWithinPartitions(*order).drop("at").mapInArrow(rows, f"row long, doc_id {kind}, th long, start int, size int, a long, b long")


def _marked(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, th) of rows with chunks, and (row, start, size, copy) of chunks that stand in several rows."""
    ship(docs.sparkSession)
    table, _ = materialize(chunks(docs, text, key), "chunks")
    often = table.groupBy("a", "b").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("a", "b", "first")
    hits = table.select("row", "start", "size", "a", "b").join(often.hint("shuffle_hash"), ["a", "b"])
    marked, _ = materialize(hits.select("row", "start", "size", (F.col("row") > F.col("first")).alias("copy")), "marked")
    return table.where("start = 0").select("row", "doc_id", "th"), marked


def _runs(marked: DataFrame, run_bytes: int) -> DataFrame:
    """(row, start, end, copied): runs of neighbouring chunks."""
    in_order = W.partitionBy("row").orderBy("start")
    fresh = F.when(F.lag(F.col("start") + F.col("size")).over(in_order) == F.col("start"), 0).otherwise(1)
    runs = marked.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum(F.when(F.col("copy"), F.col("size")).otherwise(0)).alias("copied"))
    return spans.where(F.col("end") - F.col("start") >= run_bytes).drop("run")


def _later(names: DataFrame, marked: DataFrame) -> DataFrame:
    """Later copies alone, in the first of rows equal in id and text."""
    firsts = names.groupBy("doc_id", "th").agg(F.min("row").alias("row")).select("row")
    return marked.where("copy").join(firsts, "row", "left_semi")


def repeated_spans(docs: DataFrame, run_bytes: int = RUN_BYTES, text: str = "text", key: str = "doc_id", once: bool = False) -> DataFrame:
    """(row, doc_id, th, start, end, copied): maximal runs of repeated chunks, in bytes; ``copied`` of them are later copies.

    With ``once``, rows equal in id and text are one document, known by the first of them, and runs are of later copies alone.
    """
    names, marked = _marked(docs, text, key)
    return names.join(_runs(_later(names, marked) if once else marked, run_bytes).hint("shuffle_hash"), "row")


def repeats(docs: DataFrame, run_bytes: int = RUN_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_spans, span_bytes, copied_bytes): one row for each row that shares a passage with another."""
    with Scratch(docs.sparkSession):
        spans, _ = materialize(repeated_spans(docs, run_bytes, text, key), "spans", keep=True)
    return _counted(spans).select(F.col("doc_id").alias(key), "n_spans", "span_bytes", "copied_bytes")


def _counted(spans: DataFrame) -> DataFrame:
    return spans.groupBy("row", "doc_id", "th").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end") - F.col("start")).cast("long").alias("span_bytes"), F.sum("copied").cast("long").alias("copied_bytes"))


def _by_doc(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def digests(docs: DataFrame, run_bytes: int = RUN_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``repeats`` with (left_bytes, text_md5) of what ``remove_repeats`` leaves of each row."""
    with Scratch(docs.sparkSession):
        names, marked = _marked(docs, text, key)
        spans, _ = materialize(names.join(_runs(marked, run_bytes).hint("shuffle_hash"), "row"), "spans", keep=True)
        copies, _ = materialize(_by_doc(names.join(_runs(_later(names, marked), run_bytes).hint("shuffle_hash"), "row")), "copies", keep=True)
    found = _counted(spans)
    wanted = found.select("doc_id", "th").distinct().join(copies.toDF("_id", "_th", "spans"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("doc_id", "th", "spans")
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    left = _without(texts, wanted, "text", "doc_id", "inner").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.octet_length("text").cast("long").alias("left_bytes"), F.md5("text").alias("text_md5")).distinct()
    out = found.join(left, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return out.select(F.col("doc_id").alias(key), "n_spans", "span_bytes", "copied_bytes", "left_bytes", "text_md5")


def remove_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, without its runs of later copies.

    Rows equal in id and text are one document and are cut alike.  Only whole characters go: one that a
    passage's edge would split stays.
    """
    with Scratch(docs.sparkSession):
        by_doc, _ = materialize(_by_doc(repeated_spans(docs, run_bytes, text, key, once=True)), "spans", keep=True)
    return _without(docs, by_doc, text, key, "left")


def _without(docs: DataFrame, by_doc: DataFrame, text: str, key: str, how: str) -> DataFrame:
    """Rows of ``docs`` without their spans (doc_id, th, spans)."""
    columns = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for t, spans in zip(b.column("_whole").to_pylist(), b.column("_spans").to_pylist()):
                if t is None or not spans:
                    left.append(t)
                    continue
                raw, at, parts = t.encode(), 0, []
                for s in spans:
                    start, end = s["start"], s["end"]
                    while start < end and raw[start] & 0xC0 == 0x80:  # the rest of a character that began before
                        start += 1
                    while start < end < len(raw) and raw[end] & 0xC0 == 0x80:  # a character that goes on behind
                        end -= 1
                    parts.append(raw[at : max(at, start)])
                    at = max(at, end)
                left.append(b"".join([*parts, raw[at:]]).decode())
            row = b.column("_row")
            out = [pa.array(left, pa.string()) if c == text else row.field(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(out, names=columns)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(text).alias("_whole"), F.col(key).alias("_id"), F.xxhash64(text).alias("_th"))
    joined = packed.join(by_doc.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")), how)
    return joined.select("_row", "_whole", F.col("spans").alias("_spans")).mapInArrow(rows, docs.schema)
