"""Merge of extraction tiers: first writer wins, enrichment, retraction, pruning, degree, validation.

First-writer choices are ``min_by`` aggregates on the ordinal, which combine before
the shuffle, so a node that every document mentions costs a row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.iterate import cut, numbered, table
from lattica.schema import TIERS, Graph, given


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the first writer, enriched by later writers of the same type."""
    first = nodes.groupBy("id").agg(F.min_by("type", "ord").alias("type"), F.min("ord").alias("ord"))
    same = nodes.withColumnRenamed("ord", "_at").join(first, ["id", "type"])
    pick = lambda c: F.min_by(given(c), F.when(given(c).isNotNull(), F.col("_at"))).alias(c)
    plain = same.groupBy("id", "type", "ord").agg(
        F.min_by("label", "_at").alias("label"),
        *[pick(c) for c in ("url", "valid_from", "valid_to", "visibility")],
    )
    # map entries: of each key the first writer's value; aliases: spellings in the order of their first writer
    entries = [
        same.select("id", "_at", F.posexplode_outer(F.map_entries(c)).alias("place", "e")).where("e is not null").select("id", F.lit(c).alias("kind"), F.col("e.key").alias("k"), F.col("e.value").alias("v"), "_at", F.col("place").alias("place"))
        for c in ("meta", "urls")
    ]
    spellings = same.select("id", F.lit("aliases").alias("kind"), "_at", F.posexplode("aliases").alias("place", "k")).select("id", "kind", "k", F.lit(None).cast("string").alias("v"), "_at", "place")
    rows = entries[0].unionByName(entries[1]).unionByName(spellings)
    firsts = rows.groupBy("id", "kind", "k").agg(F.min(F.struct("_at", "place")).alias("at"), F.min_by("v", F.struct("_at", "place")).alias("v"))
    packed = firsts.groupBy("id").pivot("kind", ["meta", "urls", "aliases"]).agg(F.sort_array(F.collect_list(F.struct("at", "k", "v"))))
    as_map = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["k"], x["v"])))
    extras = packed.select("id", as_map("meta").alias("meta"), as_map("urls").alias("urls"), F.transform("aliases", lambda x: x["k"]).alias("aliases"))
    extras = extras.select("id", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("meta", "urls", "aliases")])
    out = plain.join(extras, "id", "left")
    return out.select("id", "label", "type", "url", "meta", "aliases", "urls", "valid_from", "valid_to", "visibility", "ord")


def first_edges(edges: DataFrame, with_scope: bool = True) -> DataFrame:
    """The first writer of each (src, rel, dst, scope); without scope, of each (src, rel, dst)."""
    key = ["src", "rel", "dst"] + ["_scope"] * with_scope
    keyed = edges.withColumn("_scope", F.coalesce("scope", F.lit("")))
    rest = [c for c in edges.columns if c not in key]
    picked = keyed.groupBy(*key).agg(F.min_by(F.struct(*rest), "ord").alias("_row"))
    return picked.select("src", "rel", "dst", *[F.col(f"_row.{c}") for c in rest]).select(*edges.columns)


#: Documents of more edges than this are looked up by a broadcast; there are at most edges / HOT of them.
HOT = 1_000_000


def retract(edges: DataFrame, live: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges whose document is among ``live`` (id), or that name none; no task holds the edges of a document of very many."""
    ids = live.select(F.col("id").alias("doc")).distinct()
    often = edges.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("doc")
    known = table(often.join(ids.withColumn("_live", F.lit(True)), "doc", "left").select("doc", F.coalesce("_live", F.lit(False)).alias("_live")))
    marked = edges.join(F.broadcast(known), "doc", "left")
    cold = marked.where(F.col("doc").isNotNull() & F.col("_live").isNull()).join(ids, "doc", "left_semi")
    return cold.select(*edges.columns).unionByName(marked.where(F.col("doc").isNull() | F.col("_live")).select(*edges.columns))


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst"))


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges).distinct(), "id", "left_semi").select(*nodes.columns)


def merge(nodes: DataFrame, edges: DataFrame, live: DataFrame | None = None) -> Graph:
    """The published graph of all tiers' nodes and edges."""
    if live is not None:
        edges = retract(edges, live)
    unique = merge_nodes(nodes)
    kept = drop_dangling(first_edges(edges), unique)
    return Graph(drop_isolated(unique, kept), kept)


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of edge ends at each node; a loop counts twice."""
    count = endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    base = nodes.drop("degree") if "degree" in nodes.columns else nodes
    return base.join(count, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def problems(nodes: DataFrame, edges: DataFrame, types: list[str], context_types: list[str] = (), context_relations: list[str] = ()) -> DataFrame:
    """(problem, subject): everything that a published graph must not hold."""
    subject = F.concat_ws(" ", "src", "rel", "dst").alias("subject")
    # one pass over nodes and ends of edges; what is found wrong is kept
    seen = nodes.select("id", "type", F.lit(1).alias("n"), F.lit(0).alias("end")).unionByName(endpoints(edges).where("id is not null").select("id", F.lit(None).cast("string").alias("type"), F.lit(0).alias("n"), F.lit(1).alias("end")))
    kinds = seen.groupBy("id").agg(F.sum("n").alias("n"), F.min("type").alias("type"), F.max("end").alias("end"))
    kinds = table(kinds.where((F.col("n") != 1) | (F.col("end") == 0) | F.col("type").isNull() | ~F.col("type").isin(*types)))
    if context_types:
        known = nodes.groupBy("id").agg(F.min("type").alias("type"))
        named = edges.select(subject, "src", "rel", "dst", "doc", "tier")
        ends = named.join(known.select(F.col("id").alias("src"), F.col("type").alias("s")), "src", "left").join(known.select(F.col("id").alias("dst"), F.col("type").alias("d")), "dst", "left")
    else:
        # of the ends only those are looked up that no node of a type has: mostly none, and a table so small is broadcast
        missing = table(kinds.where((F.col("end") == 1) & F.col("type").isNull()).select("id"))
        lost = lambda end, kind: missing.select(F.col("id").alias(end), F.lit(True).alias(kind))
        both = edges.select("src", "rel", "dst", "doc", "tier").join(lost("src", "s"), "src", "left").join(lost("dst", "d"), "dst", "left")
        there = lambda end, kind: F.when(F.col(end).isNotNull() & F.col(kind).isNull(), F.lit(""))
        ends = both.select(subject, "rel", "doc", "tier", there("src", "s").alias("s"), there("dst", "d").alias("d"))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    of_edges = ends.select(
        "subject",
        F.explode(
            F.array_compact(
                F.array(
                    flag(F.col("s").isNull() | F.col("d").isNull(), "dangling edge"),
                    flag(F.col("doc").isNull(), "no document"),
                    flag(~F.coalesce("tier", F.lit("")).isin(*TIERS), "unknown tier"),
                    flag((F.col("s").isin(*context_types) | F.col("d").isin(*context_types)) & ~F.col("rel").isin(*context_relations), "semantic edge at context node") if context_types else F.lit(None).cast("string"),
                )
            )
        ).alias("problem"),
    )
    kinds = kinds.where("n > 0")
    of_nodes = kinds.select(F.col("id").alias("subject"), F.explode(F.array_compact(F.array(flag(F.col("n") > 1, "duplicate id"), flag(~F.col("type").isin(*types), "unknown type")))).alias("problem"))
    alone = kinds.where(F.col("end") == 0).select(F.col("id").alias("subject"), F.lit("isolated node").alias("problem"))
    return of_edges.unionByName(of_nodes).unionByName(alone).select("problem", "subject")


def reusable(docs: DataFrame, cache: DataFrame, tier: str) -> DataFrame:
    """Claims of a tier from the cache, if every document is unchanged; else none (all or nothing)."""
    hashed = docs.select(F.col("id").alias("doc"), F.sha2(F.to_json(F.struct(*sorted(docs.columns))), 256).alias("doc_hash"))
    missing = hashed.join(cache.where(F.col("tier") == tier).select("doc", "doc_hash").distinct(), ["doc", "doc_hash"], "left_anti")
    whole = missing.agg((F.count(F.lit(1)) == 0).alias("_whole"))
    return cache.where(F.col("tier") == tier).join(hashed, ["doc", "doc_hash"], "left_semi").join(F.broadcast(whole), F.col("_whole")).drop("_whole")


MERKLE_BLOCK = 10


def merkle_root(leaves: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row ``root``: leaf digests in order of key, paired level by level, an odd one with itself; null without leaves.

    Leaves are numbered over range partitions and folded ``MERKLE_BLOCK`` levels at a time, in
    blocks of as many leaves as that many levels join; no task holds more than a block.
    """
    hashed = leaves.select(F.col(key).alias("k"), F.sha2(F.concat_ws(":", key, value), 256).alias("h"))
    rows = numbered(hashed, "k", "h", name="n", start=0).select("n", "h")

    def up(hs):
        pairs = F.sequence(F.lit(0), F.floor((F.size(hs) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(hs, 2 * i), F.coalesce(F.get(hs, 2 * i + 1), F.get(hs, 2 * i))), 256))

    def folded(blocks: DataFrame, step) -> DataFrame:
        held = blocks.agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]).alias("hs"))
        return held.withColumn("h", F.get(F.aggregate(F.sequence(F.lit(1), F.lit(MERKLE_BLOCK)), F.col("hs"), lambda hs, _: step(hs)), F.lit(0)))

    while rows.count() > 1 << MERKLE_BLOCK:
        rows = cut(folded(rows.groupBy(F.shiftright("n", MERKLE_BLOCK).alias("_n")), up).select(F.col("_n").alias("n"), "h"))
    return folded(rows.groupBy(), lambda hs: F.when(F.size(hs) > 1, up(hs)).otherwise(hs)).select(F.col("h").alias("root"))


def ordered(df: DataFrame, *by: str, start: int = 0) -> DataFrame:
    """``ord`` by explicit keys; over one window, for registries and other small tables."""
    return df.withColumn("ord", (F.row_number().over(W.orderBy(*by)) + (start - 1)).cast("bigint"))
