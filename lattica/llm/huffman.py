"""Token ids in canonical length-limited Huffman code (operator 6).

File format, a folder with two Parquet tables:

* ``codes`` (id, length): the code lengths; canonical codes follow from them, by
  length and then by id.
* ``blocks``, in folders ``shard=k`` of ascending document order: independent
  blocks of whole documents with ``first`` (number of ids before the block), the
  documents' keys and token counts, ``checkpoints`` (bit offset of every
  ``CHECKPOINT``-th token, from the block's start) and ``payload``.  Within a
  shard, ``first`` gives the order.

Decoding is driven by one table of 2**MAX_LENGTH entries; every checkpoint is a
lane of its own, and all lanes of a block advance together.

Sizes on the driver and in broadcasts are bounded by the vocabulary (code
lengths) and by the number of partitions (shard totals), never by the documents.

Defined results: a null text counts as empty and has the end id alone; repeated
keys keep one row each, in order of their texts' hashes; null keys come first;
empty input writes empty tables and decodes to no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .common import fresh_path, materialize, ragged_index, remove, ship, text_slices

MAX_LENGTH = 18
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 18


def code_lengths(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols need codes of more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    merged: list[np.ndarray] = []  # at each level: whether an entry is a symbol (in order of weight)
    packages = np.zeros(0, np.int64)
    for _ in range(most):
        level = np.concatenate([weight, packages])
        by = np.argsort(level, kind="stable")
        merged.append(by < n)
        level = level[by]
        packages = level[0 : len(level) // 2 * 2 : 2] + level[1::2]
    take = 2 * n - 2
    for is_symbol in reversed(merged):
        chosen = is_symbol[:take]
        symbols = int(chosen.sum())
        out[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, at = 0, 0
    for i in order:
        code <<= int(lengths[i]) - at
        at = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Entry by the next ``most`` bits: id * 32 + length."""
    table = np.zeros(1 << most, np.uint32)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        a = int(codes[i]) << (most - n)
        table[a : a + (1 << (most - n))] = (int(i) << 5) | n
    return table


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of every CHECKPOINT-th token)."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)  # within the 64 bits from this word on
    words = np.zeros(int(ends[-1] >> 5) + 3 if len(ids) else 2, np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        at_word = word[heads]
        words[at_word] += np.add.reduceat(value >> np.uint64(32), heads)
        words[at_word + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
    return words.astype(">u4").tobytes(), at[::CHECKPOINT]


def decode_block(payload: bytes, checkpoints: np.ndarray, total: int, table: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    lanes = len(checkpoints)
    out = np.zeros((CHECKPOINT, lanes), np.int32)
    at = checkpoints.astype(np.int64)
    tail = total - (lanes - 1) * CHECKPOINT if lanes else 0
    for k in range(CHECKPOINT):
        if k == tail:
            at = at[:-1]  # the last lane may be short
        if not len(at):
            break
        window = (pairs[at >> 5] >> (64 - most - (at & 31)).astype(np.uint64)) & np.uint64((1 << most) - 1)
        entry = table[window]
        out[k, : len(at)] = entry >> 5
        at = at + (entry & 31)
    return out.T.reshape(-1)[:total]


@dataclass
class HuffmanFiles:
    path: str

    def codes(self, spark: SparkSession) -> np.ndarray:
        """Lengths by id; as many rows as the vocabulary at most."""
        rows = spark.read.schema("id int, length int").parquet(f"{self.path}/codes").collect()
        out = np.zeros(max((r.id for r in rows), default=0) + 1, np.uint8)
        for r in rows:
            out[r.id] = r.length
        return out

    def blocks(self, spark: SparkSession, key_type: str = "bigint") -> DataFrame:
        return spark.read.schema(block_schema(key_type) + ", shard int").parquet(f"{self.path}/blocks")


def block_schema(key_type: str) -> str:
    return f"first long, keys array<{key_type}>, sizes array<int>, checkpoints array<int>, payload binary"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, shard, before, ids): ids of each text with the end id as little-endian uint16 or uint32; before: ids of the shard before it."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytebpe.shared(tokenizer)
        before = 0
        for b in text_slices(batches, text, 12_000_000):
            lengths, values = coder.encode(b.column(text))
            ends = np.cumsum(lengths + 1)
            ids = np.full(len(values) + len(lengths), end_id, np.uint32)
            ids[ragged_index(ends - lengths - 1, lengths)] = values
            data = pa.py_buffer(ids.tobytes())
            offsets = pa.py_buffer(np.append(0, ends * 4).astype(np.int32).tobytes())
            payload = pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, data])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(before + ends - lengths - 1), payload], [key, "before", "ids"])
            before += int(ends[-1])

    return docs.select(key, text).mapInArrow(rows, f"{key} {kind}, before long, ids binary").withColumn("shard", F.spark_partition_id())


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): counts over all tokens; each task hands on one row for each id at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint32)
            here = np.bincount(ids, minlength=len(total))
            here[: len(total)] += total
            total = here
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(rows, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> HuffmanFiles:
    """Encode all texts, in ascending order of ``key``, into the file format at ``path``."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ship(spark)
    # equal keys, null ones above all, are dealt by the hash of their texts
    named = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    ordered = named.repartitionByRange(parts, F.col("_key"), F.col("_hash")).sortWithinPartitions("_key", "_hash").select("_key", "_text")
    tokens, tokens_path = materialize(tokenize(ordered, tokenizer, end_id, "_text", "_key"), "tokens")

    counts = id_counts(tokens).collect()  # bounded by the vocabulary
    total = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    lengths = code_lengths(total)
    codes = canonical_codes(lengths)
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    sizes = tokens.groupBy("shard").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n")).collect()  # bounded by partitions
    start, base = {}, 0
    for r in sorted(sizes, key=lambda r: r.shard):
        start[r.shard] = base
        base += r.n

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, bytes]] = []
        head: tuple[int, int] | None = None  # shard and ids before the block
        amount = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), np.uint32)
            payload, marks = encode_block(ids, lengths, codes)
            values = [[head[1]], [[k for k, _ in held]], [[len(x) // 4 for _, x in held]], [marks.astype(np.int32)], [payload], [head[0]]]
            return pa.RecordBatch.from_pylist([dict(zip(names, (v[0] for v in values)))], schema=schema)

        names = ["first", "keys", "sizes", "checkpoints", "payload", "shard"]
        schema = pa.schema([("first", pa.int64()), ("keys", pa.list_(key_arrow)), ("sizes", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int32())), ("payload", pa.binary()), ("shard", pa.int32())])
        for b in batches:
            for k, shard, before, ids in zip(b.column("_key").to_pylist(), b.column("shard").to_pylist(), b.column("before").to_pylist(), b.column("ids").to_pylist()):
                at = start[shard] + before
                if held and (head[0] != shard or head[1] + amount != at or amount >= BLOCK_TOKENS):
                    yield block()
                    held.clear()
                    amount = 0
                if not held:
                    head = (shard, at)
                held.append((k, ids))
                amount += len(ids) // 4
        if held:
            yield block()

    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(docs.schema[key].dataType)
    packed = tokens.select("_key", "shard", "before", "ids").mapInArrow(pack, block_schema(kind) + ", shard int")
    packed.write.option("compression", "none").partitionBy("shard").parquet(f"{path}/blocks")
    remove(spark, tokens_path)
    return HuffmanFiles(path)


def read(spark: SparkSession, files: HuffmanFiles, key: str = "doc_id", key_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files.

    Where ``key`` is called like one of the other columns, it has an underscore in front.
    """
    ship(spark)
    key = f"_{key}" if key in ("start", "n_tokens", "ids_crc32", "ids") else key
    lengths = files.codes(spark)
    schema = f"{key} {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths, canonical_codes(lengths))
        for b in batches:
            for i in range(b.num_rows):
                first, keys, sizes, marks, payload = (b.column(c)[i] for c in ("first", "keys", "sizes", "checkpoints", "payload"))
                n = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = decode_block(payload.as_py(), marks.values.to_numpy(zero_copy_only=False), int(n.sum()), table).astype("<u4")
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                columns = [keys.values, pa.array(first.as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return files.blocks(spark, key_type).drop("shard").mapInArrow(rows, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back."""
    spark = docs.sparkSession
    files = write(docs, fresh_path(spark, "huffman"), tokenizer, end_id, text, key)
    return read(spark, files, key, docs.schema[key].dataType.simpleString(), with_ids=False)
