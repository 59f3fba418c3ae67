"""Graph views over the driver's tables, and the same views as SQL common table expressions.

``star`` and ``star_small`` read the order tables as a graph, ``corpus`` documents
and their topics, ``dialog`` conversations as chains of turns, ``activity`` events.
Ordinals come from keys, so a view is the same whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.schema import EDGE, NODE, Graph, conform
from lattica.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))


def _nodes(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return conform(out, NODE)


def _edges(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return conform(out, EDGE)


def star_small(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers and suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, kind, key, label, extra=(): df.select(_id(kind.lower(), key).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("type"), F.col(key).cast("bigint").alias("ord"), *extra)
    segment = F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("meta")
    visible = F.when(F.col("c_acctbal") < 0, "restricted").when(F.col("c_acctbal") < 5000, "internal").otherwise("public").alias("visibility")
    nodes = _nodes(
        [
            node(t("region"), "Region", "r_regionkey", "r_name"),
            node(t("nation"), "Nation", "n_nationkey", "n_name"),
            node(t("customer"), "Customer", "c_custkey", "c_name", (segment, visible)),
            node(t("supplier"), "Supplier", "s_suppkey", "s_name"),
        ]
    )
    edge = lambda df, s, rel, d, o: df.select(s.alias("src"), F.lit(rel).alias("rel"), d.alias("dst"), F.lit(1.0).alias("confidence"), F.lit("deterministic").alias("tier"), F.lit("tables").alias("doc"), F.col(o).cast("bigint").alias("ord"))
    edges = _edges(
        [
            edge(t("nation"), _id("nation", "n_nationkey"), "IN_REGION", _id("region", "n_regionkey"), "n_nationkey"),
            edge(t("customer"), _id("customer", "c_custkey"), "IN_NATION", _id("nation", "c_nationkey"), "c_custkey"),
            edge(t("supplier"), _id("supplier", "s_suppkey"), "IN_NATION", _id("nation", "s_nationkey"), "s_suppkey"),
        ]
    )
    return Graph(nodes, edges)


def star(spark: SparkSession, sf_dir: str) -> Graph:
    """The small star with orders and parts; PLACED, CONTAINS (confidence 1 - discount) and SUPPLIED_BY."""
    small = star_small(spark, sf_dir)
    t = lambda n: table(spark, sf_dir, n)
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    nodes = _nodes(
        [
            small.nodes,
            t("part").select(_id("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("Part").alias("type"), F.col("p_partkey").alias("ord")),
            t("orders").select(_id("order", "o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("label"), F.lit("Order").alias("type"), date.alias("valid_from"), F.col("o_orderkey").alias("ord")),
        ]
    )
    li = t("lineitem")
    contains = li.groupBy("l_orderkey", "l_partkey").agg(F.max(1 - F.col("l_discount")).alias("confidence"))
    supplied = li.select("l_partkey", "l_suppkey").distinct()
    edges = _edges(
        [
            small.edges,
            t("orders").select(_id("customer", "o_custkey").alias("src"), F.lit("PLACED").alias("rel"), _id("order", "o_orderkey").alias("dst"), F.lit(1.0).alias("confidence"), date.alias("valid_from"), _id("order", "o_orderkey").alias("doc"), F.lit("deterministic").alias("tier"), F.col("o_orderkey").alias("ord")),
            contains.select(_id("order", "l_orderkey").alias("src"), F.lit("CONTAINS").alias("rel"), _id("part", "l_partkey").alias("dst"), "confidence", _id("order", "l_orderkey").alias("doc"), F.lit("extracted").alias("tier"), F.col("l_orderkey").alias("ord")),
            supplied.select(_id("part", "l_partkey").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), _id("supplier", "l_suppkey").alias("dst"), F.lit(1.0).alias("confidence"), F.lit("tables").alias("doc"), F.lit("curated").alias("tier"), F.col("l_partkey").alias("ord")),
        ]
    )
    return Graph(nodes, edges)


def dialog(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations; each replies to the turn before it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turns = c.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    nodes = conform(turns.select(name(F.col("turn")).alias("id"), F.col("role").alias("label"), F.lit("Turn").alias("type"), (F.col("conv_id") * 100000 + F.col("turn")).alias("ord")), NODE)
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"))
    replies = turns.join(before, ["conv_id", "turn"])
    edges = conform(replies.select(name(F.col("turn")).alias("src"), F.lit("REPLIES_TO").alias("rel"), name(F.col("turn") - 1).alias("dst"), F.lit(0.9).alias("confidence"), F.concat(F.lit("conv:"), F.col("conv_id")).alias("doc"), F.lit("deterministic").alias("tier"), (F.col("conv_id") * 100000 + F.col("turn")).alias("ord")), EDGE)
    return Graph(nodes, edges)


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as the engine's Document rows: language and source are tags, the next document of a source is a link."""
    from pyspark.sql.window import Window as W

    d = table(spark, sf_dir, "documents")
    # texts stay out of the window's shuffle
    ids = d.select("doc_id", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("next"))
    link = F.when(F.col("next").isNotNull(), F.array(F.concat(F.lit("doc:"), F.col("next").cast("string")))).otherwise(F.array().cast("array<string>"))
    return d.join(ids.where("next is not null").groupBy("doc_id").agg(F.min("next").alias("next")), "doc_id", "left").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("article").alias("kind"),
        "text",
        F.array("lang", "source").alias("tags"),
        link.alias("links"),
        F.col("doc_id").alias("ord"),
    )


STAR_SMALL_SQL = """
nodes(id, label, type, segment, visibility, ord) AS (
  SELECT 'region:' || r_regionkey, r_name, 'Region', NULL, NULL, CAST(r_regionkey AS BIGINT) FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Nation', NULL, NULL, n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Customer', c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'restricted' WHEN c_acctbal < 5000 THEN 'internal' ELSE 'public' END, c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Supplier', NULL, NULL, s_suppkey FROM supplier
), edges(src, rel, dst, confidence, ord) AS (
  SELECT 'nation:' || n_nationkey, 'IN_REGION', 'region:' || n_regionkey, 1.0, CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey, 1.0, c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey, 1.0, s_suppkey FROM supplier
)"""

STAR_SQL = """
nodes(id, label, type, valid_from) AS (
  SELECT 'region:' || r_regionkey, r_name, 'Region', NULL FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Nation', NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Customer', NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Supplier', NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'Part', NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'Order', strftime(o_orderdate, '%Y-%m-%d') FROM orders
), edges(src, rel, dst, confidence, valid_from, tier) AS (
  SELECT 'nation:' || n_nationkey, 'IN_REGION', 'region:' || n_regionkey, CAST(1.0 AS DOUBLE), NULL, 'deterministic' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey, 1.0, NULL, 'deterministic' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey, 1.0, NULL, 'deterministic' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'PLACED', 'order:' || o_orderkey, 1.0, strftime(o_orderdate, '%Y-%m-%d'), 'deterministic' FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey, max(1 - l_discount), NULL, 'extracted' FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'SUPPLIED_BY', 'supplier:' || l_suppkey, CAST(1.0 AS DOUBLE), CAST(NULL AS VARCHAR), 'curated' FROM lineitem
)"""

DIALOG_SQL = """
turns AS (SELECT conv_id, turn, min(role) AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
nodes(id, label, type) AS (SELECT 'turn:' || conv_id || ':' || turn, role, 'Turn' FROM turns),
edges(src, rel, dst, confidence) AS (
  SELECT 'turn:' || a.conv_id || ':' || a.turn, 'REPLIES_TO', 'turn:' || b.conv_id || ':' || b.turn, CAST(0.9 AS DOUBLE)
  FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
)"""
