"""N-gram Jaccard join by vertical partitioning (operator 8).

The global order of shingles (frequency, then hash) is cut into fragments.  Each set
falls into one segment for each fragment, the overlap of two sets is counted in
each fragment apart, and a pair's partial overlaps are summed.

1.  Equal sets become one class (128-bit digest); a class is one node, and a node
    takes part once however many copies it has.
2.  A set whose similarity to another is at least t has at least k of the first
    n - ceil(t n) + k of its shingles, in order of hash, among the same ones of the
    other.  These are counted by fragments of the hash range; sets with fewer have
    no partner and leave.  Counting knows shingles by 48 bits, which can only keep
    a set too many.
3.  For the rest, frequencies are counted by fragment.  The histogram of the order
    gives cuts of even mass, and each set its segments, its prefix (one of the first
    n - ceil(t n) + 1 shingles must be shared) and a signature: the parity of
    its shared shingles in each of 256 classes.
4.  Sets that meet in a prefix shingle are a candidate pair if, with this shingle as
    their first common one, the places in both sets leave enough shingles; if sizes
    and shared shingles allow the overlap; and if the signatures, whose distance
    never exceeds the symmetric difference, allow it.  Pairs come in rounds: one
    leader for each prefix shingle, then a few, and last every member outside
    its shingle's largest component against all, the nearest of each component before
    the others.  Pairs within one component are never tried and one link between two
    components counts, so a group of near copies costs a few pairs a member, while
    no pair that could join two components is left out.
5.  A candidate's partial overlaps are counted by fragment and summed.

The output gives each document its class's component: the pairs within a group of
copies are never listed, and no link between different components is lost.

Defined results: null or white-space-only text has the empty set and is linked
with nothing; a row with a null id takes part but cannot name a component; rows
with equal ids keep a row each in ``components``, and are told apart by their text in ``keep_one``; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, ragged_index, ship, text_slices
from .components import connected_components
from .shingles import mix, set_digests, shingle_sets

WIDTH, SIMILAR = 5, 80
#: Bytes of shingles in a counting fragment, held by one task at a time.
FRAGMENT_BYTES = 24 << 20
#: Fragments of the global order, in which overlaps are counted.
FRAGMENTS = 8
SIGNATURE_WORDS = 4
FIRST_LEADERS, MORE_LEADERS = 4, 8
#: Pairs of one leading set in a task, and comparisons of one prefix shingle in a task.
PAIRS_A_SALT, TRIES_A_SALT = 128, 4_000_000
SALTS = 32


def _part_of(n: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles to send of a set of n, how many of them must be shared)."""
    least = -(-similar * n // 100)
    k = np.maximum(1, n // 5)
    return np.minimum(n, n - least + k), np.maximum(1, least // 5)


def _set_rows(docs: DataFrame, width: int, similar: int) -> DataFrame:
    """(doc_id, th, n, sid, low, top): digest of each row's set, and the part that is sent, as 32 and 16 bits of each hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            n, hashes = shingle_sets(b.column("text"), width)
            sent, _ = _part_of(n, similar)
            part = mix(hashes[ragged_index(np.cumsum(n) - n, sent)])
            ends = np.append(0, np.cumsum(sent)).tolist()
            low, top = part.astype(np.uint32).tobytes(), (part >> np.uint64(48)).astype(np.uint16).tobytes()
            columns = [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(set_digests(n, hashes), pa.binary())]
            columns += [pa.array([raw[size * x : size * y] for x, y in zip(ends, ends[1:])], pa.binary()) for raw, size in ((low, 4), (top, 2))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "sid", "low", "top"])

    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n long, sid binary, low binary, top binary")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values per row, all values) of a column of packed numbers."""
    raw = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.fromiter((len(x) // size for x in raw), np.int64, len(raw)), np.frombuffer(b"".join(raw), kind)


def _segments(sets: DataFrame, frags: int, kind: str) -> DataFrame:
    """(frag, block): segments of sets (node, n, low, top), packed by fragment; ``kind`` is the type of ``low``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, values = _flat(b.column("low"), kind)
            top = _flat(b.column("top"), "u2")[1] if "top" in b.schema.names else values >> np.uint64(48)
            where = (top.astype(np.int64) * frags) >> 16
            owner = np.repeat(np.arange(len(count)), count)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(frags + 1))
            node, n = b.column("node").to_numpy(), b.column("n").to_numpy()
            named, blocks = [], []
            for f in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[f] : cuts[f + 1]]
                who, length = np.unique(owner[part], return_counts=True)
                named.append(int(f))
                blocks.append(b"".join([np.int64(len(who)).tobytes(), node[who].tobytes(), n[who].astype(np.int32).tobytes(), length.astype(np.int32).tobytes(), values[part].tobytes()]))
            if named:
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array(blocks, pa.binary())], ["frag", "block"])

    return sets.mapInArrow(rows, "frag int, block binary").repartitionById(frags, F.col("frag"))


def _counted(segments: DataFrame, kind: str, with_hashes: bool) -> DataFrame:
    """(node, n, shared): how many of a fragment's shingles of a set a second set has; with them, their frequencies (to 255)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sizes, lengths, values = [], [], [], []
        for b in batches:
            for x in b.column("block").to_pylist():
                k = int(np.frombuffer(x, np.int64, 1)[0])
                nodes.append(np.frombuffer(x, np.int64, k, 8))
                sizes.append(np.frombuffer(x, np.int32, k, 8 + 8 * k))
                lengths.append(np.frombuffer(x, np.int32, k, 8 + 12 * k))
                values.append(np.frombuffer(x, kind, -1, 8 + 16 * k))
        if not nodes:
            return
        node, size, length, h = (np.concatenate(x) for x in (nodes, sizes, lengths, values))
        by = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(h[by]) != 0))
        df = np.diff(np.append(heads, len(h)))
        often = np.empty(len(h), np.uint8)
        often[by] = np.repeat(np.minimum(df, 255), df)
        shared = often > 1
        count = np.bincount(np.repeat(np.arange(len(node)), length)[shared], minlength=len(node))
        has = np.flatnonzero(count)
        columns = [pa.array(node[has]), pa.array(size[has].astype(np.int64)), pa.array(count[has])]
        if with_hashes:
            ends = np.append(0, np.cumsum(count[has])).tolist()
            hb, fb = h[shared].tobytes(), often[shared].tobytes()
            columns += [pa.array([hb[8 * x : 8 * y] for x, y in zip(ends, ends[1:])], pa.binary()), pa.array([fb[x:y] for x, y in zip(ends, ends[1:])], pa.binary())]
        for a in range(0, len(has), 20_000):
            yield pa.RecordBatch.from_arrays([c.slice(a, 20_000) for c in columns], ["node", "n", "shared", "hashes", "often"][: len(columns)])

    schema = "node long, n long, shared long" + ", hashes binary, often binary" * with_hashes
    return segments.mapInArrow(rows, schema)


def _cell(often: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place in the global order, coarsened to 65,536 cells."""
    return often.astype(np.int64) << 8 | (hashes >> np.uint64(56)).astype(np.int64)


def _cuts(parts: DataFrame) -> np.ndarray:
    """Cells at which the fragments of the global order begin, by even mass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(_cell(_flat(b.column("often"), "u1")[1], _flat(b.column("hashes"), "u8")[1]), minlength=1 << 16)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "mass"])

    mass = np.zeros(1 << 16, np.int64)
    # at most 65,536 rows, whatever the corpus
    for cell, m in parts.select("hashes", "often").mapInArrow(rows, "cell long, mass long").groupBy("cell").agg(F.sum("mass")).collect():
        mass[cell] = m
    upto = np.cumsum(mass)
    return np.searchsorted(upto, upto[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS, side="left") + 1


def _ordered(parts: DataFrame, cuts: np.ndarray, similar: int) -> DataFrame:
    """(node, n, s, prefix, segments, g0 ..): the s shared shingles of each set that can have a partner, in the global order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, bytes]] = []

        def ordered() -> pa.RecordBatch | None:
            node, n = held[0][:2]
            h = np.frombuffer(b"".join(x for _, _, x, _ in held), np.uint64)
            often = np.frombuffer(b"".join(x for _, _, _, x in held), np.uint8)
            take = len(h) - -(-similar * n // 100) + 1  # shingles of its own come first
            if take <= 0:
                return None
            order = np.lexsort((h, often))
            h, often = h[order], often[order]
            parts = np.split(h.view(np.int64), np.searchsorted(_cell(often, h), cuts))
            odd = np.bincount((h >> np.uint64(4)).astype(np.int64) & (64 * SIGNATURE_WORDS - 1), minlength=64 * SIGNATURE_WORDS) & 1
            words = np.packbits(odd.astype(np.uint8)).view(np.int64)
            kind = pa.list_(pa.int64())
            columns = [pa.array([node]), pa.array([n]), pa.array([len(h)]), pa.array([h[:take].view(np.int64)], kind), pa.array([parts], pa.list_(kind)), *(pa.array([w]) for w in words)]
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["node", "n", "s", "prefix", "segments", *(f"g{i}" for i in range(SIGNATURE_WORDS))]
        ready: list[pa.RecordBatch] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("node", "n", "hashes", "often"))):
                if held and held[0][0] != row[0]:
                    if (out := ordered()) is not None:
                        ready.append(out)
                    held.clear()
                held.append(row)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready.clear()
        if held and (out := ordered()) is not None:
            yield out

    by_node = parts.select("node", "n", "hashes", "often").repartition("node").sortWithinPartitions("node")
    return by_node.mapInArrow(rows, "node long, n long, s long, prefix array<long>, segments array<array<long>>, " + ", ".join(f"g{i} long" for i in range(SIGNATURE_WORDS)))


def _apart() -> Column:
    """Shingles that are surely in one of x and y only."""
    apart = F.col("x.n") - F.col("x.s") + F.col("y.n") - F.col("y.s")
    for i in range(SIGNATURE_WORDS):
        apart = apart + F.bit_count(F.col(f"x.g{i}").bitwiseXOR(F.col(f"y.g{i}")))
    return apart


def _possible(similar: int) -> Column:
    """Whether x and y can be similar if the shingle at which they meet is their first common one."""
    c = F.col
    both = c("x.n") + c("y.n")
    return (
        (100 * F.least("x.n", "y.n") >= similar * F.greatest("x.n", "y.n"))
        & ((100 + similar) * F.least("x.left", "y.left") >= similar * both)
        & ((100 + similar) * F.least("x.s", "y.s") >= similar * both)
        & ((100 + similar) * _apart() <= (100 - similar) * both)
    )


def _similar_pairs(met: DataFrame, sets: DataFrame, similar: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, na, b, nb) those that are similar: overlaps are counted by fragment and summed.

    A set that leads many pairs is dealt over several tasks, as many as its pairs need.
    """
    pairs = scratch.table(met, "candidates")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_SALT).cast("int").alias("salts"))
    leading = salts.join(sets.withColumnRenamed("node", "a"), "a").select("a", "salts", "segments")
    leading = leading.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "segments").select("a", "salt", F.posexplode("segments").alias("frag", "sa")).where(F.size("sa") > 0)
    other = sets.withColumnRenamed("node", "b").join(pairs.select("b").distinct(), "b", "left_semi").select("b", F.posexplode("segments").alias("frag", "sb")).where(F.size("sb") > 0)
    dealt = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    partial = dealt.join(leading, ["a", "salt"]).join(other, ["b", "frag"]).select("a", "na", "b", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))
    summed = partial.groupBy("a", "na", "b", "nb").agg(F.sum("o").alias("o"))
    return summed.where(100 * F.col("o") >= similar * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _merged(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) after more links (a, b): of the links between two components one counts."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = scratch.table(comps.join(ends, "node", "full").select("node", F.coalesce("comp", "node").alias("comp")), "known")
    between = links.join(known.toDF("a", "ca"), "a").join(known.toDF("b", "cb"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    joined = connected_components(between).toDF("comp", "whole")
    return scratch.table(known.join(joined, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp")), "comps")


def _links(sets: DataFrame, similar: int, scratch: Scratch) -> DataFrame:
    """(node, comp) over the sets that have a link."""
    signature = [f"g{i}" for i in range(SIGNATURE_WORDS)]
    entries = sets.select("node", "n", "s", *signature, F.posexplode("prefix").alias("i", "h")).select("h", "node", "n", "s", (F.col("s") - F.col("i")).alias("left"), *signature)
    first = entries.groupBy("h").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", "n", "s", "left", *signature)).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    first = scratch.table(first, "leads")
    several = scratch.table(entries.join(first.select("h", "size"), "h"), "prefixes")
    named = [F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb")]

    def tried(x: DataFrame, y: DataFrame, on: list[str], also: Column, nearest: bool = False) -> DataFrame:
        met = x.alias("x").join(y.alias("y"), on).where(also & _possible(similar))
        if nearest:  # one pair of each set and component
            far = F.struct((_apart() / (F.col("x.n") + F.col("y.n"))).alias("far"), F.col("y.node").alias("b"))
            met = met.groupBy(*named[:2], F.col("y.comp").alias("comp")).agg(F.min_by(F.struct(*named[2:]), far).alias("y")).select("a", "na", "y.*")
        else:
            met = met.select(*named).distinct()
        return scratch.table(_similar_pairs(met, sets, similar, scratch), "pairs")

    links = tried(first.select("h", "lead.*"), several, ["h"], F.col("x.node") != F.col("y.node"))
    comps = connected_components(links)
    leaders, nearest = FIRST_LEADERS, True
    while True:
        placed = several.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        by_comp = placed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
        open_ = scratch.table(by_comp.groupBy("h").agg(F.max_by("comp", "c").alias("largest"), F.max("c").alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps"), "open")
        members = scratch.table(placed.join(open_, "h"), "members")
        widest = members.agg(F.max("size")).first()[0]
        if widest is None:
            return comps
        apart = F.col("x.comp") != F.col("y.comp")
        last = leaders * leaders >= widest
        if not last:
            # a set's turn to lead depends on itself, not on the shingle: shingles of one frequency have the same leaders
            turn = members.withColumn("leads", F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("size") < (leaders << 30))
            more = tried(turn.where("leads"), turn, ["h"], apart & (~F.col("y.leads") | (F.col("x.node") < F.col("y.node"))))
            leaders *= MORE_LEADERS
        else:
            # first each set with the nearest of each component; what that joins is not tried again
            # both sides go over a grid whose cells hold at most TRIES_A_SALT comparisons
            cell = math.isqrt(TRIES_A_SALT)
            dealt = members.withColumns({"down": F.ceil((F.col("size") - F.col("most")) / cell).cast("int"), "across": F.ceil(F.col("size") / cell).cast("int")})
            place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            rest = dealt.where("comp <> largest").withColumn("row", place("down", 1)).withColumn("column", every("across"))
            whole = dealt.withColumn("column", place("across", 2)).withColumn("row", every("down"))
            more = tried(rest, whole, ["h", "row", "column"], apart & ((F.col("y.comp") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))), nearest)
        if not more.isEmpty():
            comps = _merged(comps, more, scratch)
        if last and not nearest:
            return comps
        nearest = nearest and not last


def _placed(docs: DataFrame, width: int, similar: int, text: str, key: str) -> DataFrame:
    """(doc_id, th, n, component, whole) for every row; ``whole`` tells components apart and is null for empty sets."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    named, _ = materialize(_set_rows(rows, width, similar).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int")), "sets")
    with Scratch(docs.sparkSession) as scratch:
        final = _classes(rows, named, width, similar, scratch)
    # copies go by digest and salt, so no task holds a large group
    by_group = named.select("sid", "salt").distinct().join(final, "sid")
    return named.select("doc_id", "th", "n", "sid", "salt").join(by_group, ["sid", "salt"], "left")


def components(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    out = _placed(docs, width, similar, text, key)
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _classes(rows: DataFrame, named: DataFrame, width: int, similar: int, scratch: Scratch) -> DataFrame:
    """(sid, component, whole) of every set that is not empty: the least id, and a number of the component."""
    gathered = [F.min("rep").alias("rep"), F.min("one").alias("one"), *(F.first(c).alias(c) for c in ("n", "low", "top"))]
    groups = named.select("sid", "salt", F.col("doc_id").alias("rep"), F.struct("doc_id", "th").alias("one"), "n", "low", "top").groupBy("sid", "salt").agg(*gathered)
    classes = scratch.table(groups.groupBy("sid").agg(*gathered).where("n > 0").withColumn("node", F.monotonically_increasing_id()), "classes")

    def segments(sets: DataFrame, kind: str) -> DataFrame:
        size = sets.agg(F.sum(F.length("low"))).first()[0] or 0
        return _segments(sets, min(1 << 16, max(16, math.ceil(size / FRAGMENT_BYTES))), kind)

    counted = _counted(segments(classes.select("node", "n", "low", "top"), "u4"), "u4", False)
    least = F.greatest(F.lit(1), F.floor(F.ceil(similar * F.col("n") / 100) / 5))
    active = counted.groupBy("node", "n").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= least).select("node")
    wanted = classes.join(active, "node", "left_semi").select(F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th"), "node")
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("node", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            n, hashes = shingle_sets(b.column("text"), width)
            raw, ends = hashes.tobytes(), np.append(0, np.cumsum(n) * 8).tolist()
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n, pa.int64()), pa.array([raw[x:y] for x, y in zip(ends, ends[1:])], pa.binary())], ["node", "n", "low"])

    full = scratch.table(texts.mapInArrow(hashed, "node long, n long, low binary").dropDuplicates(["node"]), "active")
    parts = scratch.table(_counted(segments(full, "u8"), "u8", True), "frequencies")
    sets = scratch.table(_ordered(parts, _cuts(parts), similar), "ordered")
    linked = classes.select("sid", "node", "rep").join(_links(sets, similar, scratch), "node")
    by_comp = linked.groupBy("comp").agg(F.min("rep").alias("least"))
    by_class = linked.join(by_comp, "comp").select("sid", "comp", "least")
    final, _ = materialize(classes.select("sid", "rep", "node").join(by_class, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component"), F.coalesce("comp", "node").alias("whole")), "components", keep=True)
    return final


def keep_one(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each component one row stays, with all columns: of the least id, and of the least text hash among that id's texts.

    Texts are told apart by (id, hash), so a text that resembles nothing stays whatever rows share its
    id.  Rows equal in id and text are copies like others: one stays, the least by a hash of all columns.
    Rows with a null id stay, and stand for no others.
    """
    c = F.col
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.table(_placed(docs, width, similar, text, key).where("doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "placed")
        texts = scratch.table(found.groupBy("doc_id", "th").agg(F.first("whole").alias("whole"), F.first("salt").alias("salt"), F.count(F.lit(1)).alias("times")), "texts")
        # large components go by number and salt, so no task holds one
        first = texts.where("whole is not null").groupBy("whole").agg(F.min(F.struct("doc_id", "th")).alias("one"))
        stays = texts.select("whole", "salt").distinct().join(first, "whole")
        judged = texts.join(stays, ["whole", "salt"], "left").select("doc_id", "th", "times", (c("one").isNull() | ((c("one.doc_id") == c("doc_id")) & (c("one.th") == c("th")))).alias("stays"))
        out, _ = materialize(judged.where("not stays or times > 1").select(c("doc_id").alias("_id"), c("th").alias("_th"), "stays"), "doubles", keep=True)
    same = (c(f"_row.{key}") == c("_id")) & (F.xxhash64(c(f"_row.{text}")) == c("_th"))
    packed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"))
    left = packed.join(out, same, "left_anti")
    repeated = out.where("stays")
    if not repeated.isEmpty():
        again = packed.join(repeated, same).groupBy("_id", "_th").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        left = left.unionByName(again.select("_row"))
    return left.select("_row.*")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), often AS (
  SELECT g FROM shingles GROUP BY g HAVING count(*) > 1
), shared AS (
  SELECT doc_id, g FROM shingles JOIN often USING (g)
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * o >= 80 * (len(x.s) + len(y.s) - o)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least.b, doc_id)) AS component_id
FROM sets LEFT JOIN least ON least.a = doc_id
"""
