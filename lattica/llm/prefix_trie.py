"""Prefix trie of conversations with subtree sums by heavy-path decomposition (operator 11).

A conversation is a sequence of turns (role, text); each distinct sequence of its
first d turns is a node of depth d.  Texts are replaced by digests before anything is
shuffled.

1.  Turns are put in order over range partitions (``scans``), with the rolling hash of
    all turns up to each.  A conversation that begins with turns of another is
    rebuilt by arithmetic on such hashes: what its own first turns gave is replaced by
    what the other's gave.  A hash names a node, and with the turn's digest its parent.
2.  Nodes are aggregates of entries (conversation, depth), combined before the shuffle.
3.  Each node's heavy child is the one with most members (then with the least
    conversation).  A light child has at most half of its parent's members, so no way to the
    root has more light nodes than the logarithm of the number of conversations.
    A scan along each conversation counts the light nodes on the way (the level) and
    sums their hashes, which names the heavy path.
4.  From the highest level down, suffix sums along the path arrays (``scans``) give
    the subtree sums of all nodes of a level; the sums at the tops of its paths are added to
    their parents, one level lower.  There are as many rounds as levels.

No conversation, node or path has to fit a task: scans carry values over partitions.
The digest of a node's ends is made of blocks of ids in order, with one block for each node and
range partition; the last step hashes a node's blocks as a stream.

Defined results: a null role or text is empty; turns are in order of ``turn``, nulls
first, and equal ones by digests of role and text; repeated rows are turns of their own;
rows without a conversation id belong to none and are left out; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, ship
from .scans import BASES, powers, scan
from .shingles import mix

WORD = r"[^\x20\x09-\x0D]+"
#: A conversation takes its first turns from the first of its block of ids, and fewer than so many of them.
BLOCK, MOST_HEAD = 20, 4
#: Inverses of the bases modulo 2 ** 64, to step back from a node to its parent.
_BACK = [np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES]


def head_length(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % MOST_HEAD


def turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, t1, t2, r1, r2, words): turns in order, digests t, rolling hashes r of all turns up to each."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.xxhash64(r, t).alias("t1"),
        F.xxhash64(t, r, F.lit(7)).alias("t2"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),  # equal rows can then be dealt over partitions
    )
    small, _ = materialize(rows.withColumns({"r1": F.col("t1"), "r2": F.col("t2")}), "turns")
    return scan(small, ["conv"], [F.asc_nulls_first("turn"), "t1", "t2", "row"], rolls=("r1", "r2"), label="turns").drop("turn", "row")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, conversations) after each has its block's first turns: (conv, depth, k1, k2, p1, p2, words), (conv, length).

    k is the hash of the turns up to the entry, p that of the turns before it.
    """
    c = F.col
    length = ordered.groupBy("conv").agg(F.max("place").alias("length"))
    few = ordered.where(c("place") < MOST_HEAD).groupBy("conv").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("r1", "r2", "t1", "t2", "words")))).alias("first"))
    # decimal digits are all that the crc reads, so Spark's own function gives the same
    head = F.pmod(F.crc32(c("conv").cast("string").cast("binary")), F.lit(MOST_HEAD)).alias("h")
    convs = length.join(few, "conv").select("conv", "length", "first", head, (c("conv") - c("conv") % BLOCK).alias("base"))
    base = few.select(c("conv").alias("base"), c("first").alias("given"))
    convs, _ = materialize(convs.join(base, "base", "left"), "conversations")
    taken = F.when(c("given").isNull(), F.lit(0)).otherwise(F.least(c("h"), F.size("given"))).cast("long")
    own = F.greatest(c("length") - c("h"), F.lit(0))
    # hashes of what goes (the own first h turns) and of what comes instead
    lane = lambda m, at, i: F.coalesce(F.try_element_at(m, at)[f"r{i}"], F.lit(0))
    shifts = convs.select("conv", "length", c("h").cast("long").alias("h"), taken.alias("taken"), own.alias("own"), *[lane("first", c("h").cast("long"), i).alias(f"old{i}") for i in (1, 2)], *[lane("given", taken, i).alias(f"new{i}") for i in (1, 2)], "given")
    names = ["conv", "depth", "k1", "k2", "p1", "p2", "words"]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda n, b=b: b.column(n).to_numpy().astype(np.int64)
            lanes = lambda n: get(n).view(np.uint64)
            beyond = get("place") - get("h")
            cols = {"conv": get("conv"), "depth": beyond + get("taken"), "words": get("words")}
            with np.errstate(over="ignore"):
                for i in (1, 2):
                    k = lanes(f"r{i}") + (lanes(f"new{i}") - lanes(f"old{i}")) * powers(BASES[i - 1], beyond)
                    cols[f"k{i}"] = k.view(np.int64)
                    cols[f"p{i}"] = ((k - lanes(f"t{i}")) * _BACK[i - 1]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[n]) for n in names], names)

    rest = ordered.join(shifts.drop("given", "length", "own"), "conv").where(c("place") > c("h")).mapInArrow(moved, ", ".join(f"{n} long" for n in names))
    at = shifts.where("taken > 0").select("conv", "given", F.explode(F.sequence(F.lit(1).cast("long"), c("taken"))).alias("depth"))
    here, before = F.element_at("given", c("depth")), F.try_element_at("given", c("depth") - 1)
    heads = at.select("conv", "depth", *[here[f"r{i}"].alias(f"k{i}") for i in (1, 2)], *[F.coalesce(before[f"r{i}"], F.lit(0)).alias(f"p{i}") for i in (1, 2)], here["words"].alias("words"))
    return rest.select(*names).unionByName(heads.select(*names)), shifts.select("conv", (c("taken") + c("own")).alias("length"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which conversations (conv) end."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, depth, conv = (b.column(n).to_numpy() for n in ("conv_id", "depth", "conv"))
            cuts = [0, *(np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1).tolist(), len(node)]
            parts = [(node[x], depth[x], conv[x], ",".join(map(str, conv[x:y].tolist()))) for x, y in zip(cuts, cuts[1:]) if y > x]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            done = []
            for node, depth, ids in zip(*(b.column(n).to_pylist() for n in ("conv_id", "depth", "ids"))):
                if (node, depth) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (node, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digests(done)
        if now is not None:
            yield _digests([(*now, digest.hexdigest())])

    ordered = ends.repartitionByRange("conv_id", "depth", "conv").sortWithinPartitions("conv_id", "depth", "conv")
    packed = ordered.mapInArrow(blocks, "conv_id long, depth long, least long, ids string")
    by_node = packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least")
    return by_node.mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "depth", "ends_sha256"])


def _mixed(df: DataFrame) -> DataFrame:
    """``df`` with (f1, f2): hashes of light nodes, 0 for others."""
    names = [*df.columns, "f1", "f2"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            light = b.column("light").to_numpy().astype(bool)
            depth = b.column("depth").to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                fs = [np.where(light, mix(b.column(k).to_numpy().view(np.uint64) + depth * BASES[i]), np.uint64(0)).view(np.int64) for i, k in enumerate(("k1", "k2"))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, fs)], names)

    return df.mapInArrow(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", f1 long, f2 long")


def nodes(entries: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of entries with a root: nodes with parents, members, children, level and path; (conv_id, depth, conv) of ends."""
    c = F.col
    root = lengths.select("conv", *[F.lit(0).cast("long").alias(n) for n in ("depth", "k1", "k2", "p1", "p2", "words")])
    every, _ = materialize(entries.unionByName(root), "entries")
    at = ["depth", "k1", "k2"]
    plain = every.groupBy(*at).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.first(n).alias(n) for n in ("p1", "p2", "words")])
    plain, _ = materialize(plain, "nodes")
    up = [(c("depth") - 1).alias("depth"), c("p1").alias("k1"), c("p2").alias("k2")]
    children = plain.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", (-c("conv_id")).alias("least"))).alias("heavy"))
    full = plain.join(children, at, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "heavy": -c("heavy.least")})
    full, _ = materialize(full, "nodes")
    parents = full.where("n_children > 0").select((c("depth") + 1).alias("depth"), c("k1").alias("p1"), c("k2").alias("p2"), c("conv_id").alias("parent_conv_id"), "heavy")
    placed = full.drop("heavy").join(parents, ["depth", "p1", "p2"], "left").withColumn("light", F.when(c("heavy") == c("conv_id"), 0).otherwise(1).cast("long")).drop("heavy")
    placed, _ = materialize(placed, "nodes")
    named = every.select("conv", *at).join(placed.select(*at, "conv_id", "light"), at)
    along = scan(_mixed(named).select("conv", "depth", "conv_id", "light", "f1", "f2"), ["conv"], ["depth"], sums=("light", "f1", "f2"), label="paths")
    level = along.where("conv = conv_id").select("conv_id", "depth", c("light").alias("level"), c("f1").alias("path1"), c("f2").alias("path2"))
    ends = along.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"]).select("conv_id", "depth", "conv")
    return placed.join(level, ["conv_id", "depth"]), ends


def subtree_sums(placed: DataFrame, values: list[str]) -> DataFrame:
    """``placed`` with each of ``values`` summed over subtrees, level by level along the heavy paths."""
    c = F.col
    highest = placed.agg(F.max("level")).first()[0] or 0  # at most the logarithm of the conversations, and one
    done, received = [], None
    for level in range(highest, 0, -1):
        here = placed.where(c("level") == level)
        if received is not None:
            here = here.join(received, ["depth", "k1", "k2"], "left").select(*[c(n) if n not in values else (c(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in placed.columns])
        summed = scan(here.withColumn("below", -c("depth")), ["path1", "path2"], ["below"], sums=tuple(values), label="sums").drop("below", "place")
        tops = summed.where("light = 1 and depth > 0")
        received = tops.groupBy((c("depth") - 1).alias("depth"), c("p1").alias("k1"), c("p2").alias("k2")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        done.append(summed)
    out = done[0] if done else placed
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    spark = conversations.sparkSession
    ship(spark)
    c = F.col
    with Scratch(spark):
        entries, lengths = rebuilt(turns(conversations, key, turn, role, text))
        lengths, _ = materialize(lengths, "lengths")
        found, ends = nodes(entries, lengths)
        own = found.withColumns({"n_leaves": F.when(c("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (c("n_convs") - 1) * c("words")})
        summed = subtree_sums(materialize(own, "placed")[0], ["n_leaves", "saved_tokens"])
        out = summed.join(_ends_digest(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
        result = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        return materialize(result, "trie", keep=True)[0]


ORACLE_SQL = r"""
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id FROM ordered
), heads AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: CASE WHEN xor(a, e) & 1 = 1 THEN xor(xor(a, e) >> 1, 3988292384) ELSE xor(a, e) >> 1 END)) % 4 AS h FROM ids
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, b.i, b.role, b.text FROM heads c JOIN ordered b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.i <= c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM heads c JOIN ordered o ON o.conv_id = c.conv_id AND o.i > c.h
), entries AS (
  SELECT conv_id, row_number() OVER w AS depth, list(role || chr(0) || text) OVER (w ROWS UNBOUNDED PRECEDING) AS way, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL SELECT conv_id, 0, [], 0 FROM ids
), longest AS (
  SELECT conv_id, max(depth) AS depth FROM entries GROUP BY conv_id
), nodes AS (
  SELECT way, e.depth, min(e.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(CAST(e.conv_id AS VARCHAR), ',' ORDER BY e.conv_id) FILTER (e.depth = l.depth) AS ends
  FROM entries e JOIN longest l USING (conv_id) GROUP BY way, e.depth
), children AS (
  SELECT way[1:depth - 1] AS way, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), above AS (
  SELECT n.conv_id, n.depth, n.n_convs, n.words, c.n_children, unnest(range(0, n.depth + 1)) AS d, n.way FROM nodes n LEFT JOIN children c USING (way, depth)
), sums AS (
  SELECT way[1:d] AS way, d AS depth, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM above GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (way, depth) LEFT JOIN children c USING (way, depth) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.way = n.way[1:n.depth - 1] AND n.depth > 0
"""
