"""Near-duplicate classes of nodes: MinHash bands, leaders of buckets, and an exact way for what leaders leave apart.

Nodes with one signature are one from the start.  Signatures that agree in a band share a
bucket; two that share a bucket and are similar enough are linked, and a class is what links
join.  In each turn one member of a bucket is compared with the members of other classes, so
a bucket of near copies closes after a turn or two for as many comparisons as it has members; the first
turns look at one band and at four, so that most nodes have their class before all bands are compared.
Buckets that still hold several classes after ``TURNS`` are compared in full, but for pairs within their
largest class, over a grid of cells.  No bucket is gathered, and no link between different classes is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.iterate import table
from lattica.operators.analytics import components
from lattica.operators.search import signature_similarity
from lattica.schema import Graph

TURNS = 4
#: Texts that a task signs.
SIGNED = 25_000
CELL_PAIRS = 4_000_000
BUCKET = ["band", "h"]


def _buckets(reps: DataFrame, bands: int, count: int) -> DataFrame:
    """(band, h, node, size) of the buckets that hold several signatures."""
    rows = count // bands
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("sig", i * rows + 1, F.lit(rows))).alias("h"))))
    keyed = table(reps.select("node", band.alias("x")).select("node", "x.band", "x.h"))
    return table(keyed.join(keyed.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), BUCKET))


def _linked(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose signatures are similar."""
    sides = pairs.distinct().join(reps.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return table(sides.where(signature_similarity(F.col("sa"), F.col("sb")) >= threshold).select("a", "b"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after more links (a, b): links are first drawn between classes, once for each two."""
    c = F.col
    between = links.join(labels.toDF("a", "src"), "a").join(labels.toDF("b", "dst"), "b").where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    between = table(between)
    ends = between.select(c("src").alias("id")).union(between.select("dst")).distinct()
    joined = components(Graph(ends, between)).toDF("comp", "whole")
    return table(labels.join(joined, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp")))


def duplicate_classes(nodes: DataFrame, threshold: float = 0.6, bands: int = 16, count: int = 64) -> DataFrame:
    """(id, class_id, class_size) of every node, by label and aliases; ``class_id`` is the least id of the class.

    Nulls count as empty texts, and empty texts are alike; a node without a near copy is a class of its own.
    """
    c = F.col
    text = F.concat_ws(" ", "label", F.array_join("aliases", " "))
    said = nodes.select("id", text.alias("text"))
    # few large files would be few tasks
    signed = table(said.repartition(-(-said.count() // SIGNED) or 1).select("id", T.minhash(c("text"), count=count).cast("array<int>").alias("sig")))
    reps = table(signed.groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("held")).withColumn("node", F.monotonically_increasing_id()))
    buckets = _buckets(reps, bands, count)
    labels = table(reps.select("node", c("node").alias("comp")))
    for turn in range(TURNS + 1):
        looked = min(bands, 4**turn) if turn < TURNS else bands  # most near copies meet in a few bands
        placed = buckets.where(c("band") < looked).join(labels, "node")
        by_comp = placed.groupBy(*BUCKET, "comp").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("lead"))
        lead_order = F.xxhash64("lead", F.lit(turn))
        open_ = by_comp.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", "n").alias("largest"), F.max("n").alias("most"), F.min_by("lead", lead_order).alias("leader"), F.min_by("comp", lead_order).alias("leads")).where("comps > 1")
        open_ = table(open_.drop("comps"))
        if open_.isEmpty():
            if looked == bands:
                break
            continue
        members = placed.join(open_, BUCKET)
        if turn < TURNS:
            pairs = members.where("comp <> leads").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        else:
            cell = math.isqrt(CELL_PAIRS)
            dealt = table(members.withColumns({"down": F.ceil((c("size") - c("most")) / cell).cast("int"), "across": F.ceil(c("size") / cell).cast("int")}))
            place = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), c(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
            rest = dealt.where("comp <> largest").withColumn("row", place("down", -1)).withColumn("column", every("across"))
            whole = dealt.withColumn("column", place("across", -2)).withColumn("row", every("down"))
            met = rest.alias("x").join(whole.alias("y"), [*BUCKET, "row", "column"]).where("x.comp <> y.comp and (y.comp = y.largest or x.node < y.node)")
            pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        links = _linked(pairs, reps, threshold)
        if not links.isEmpty():
            labels = _merged(labels, links)
    known = reps.join(labels, "node")
    classes = known.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("held").alias("class_size"))
    by_sig = known.select("sig", "comp").join(classes, "comp").select("sig", "class_id", "class_size")
    return signed.join(by_sig, "sig").select("id", "class_id", "class_size")
