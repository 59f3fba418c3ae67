"""Connected components of a link table, by least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of links (a, b), whole numbers; comp is the least node that can be reached.

    In each round a node moves to its least neighbour's least neighbour (an aggregate that
    combines before the shuffle), and links go on between the places that their ends moved to,
    once for each two places.  "Least" is by a hash of the node, so that rounds are few however
    nodes are numbered, such as along a path; the 64-bit hash of one 64-bit number maps
    no two of them to one value.  A link within one place goes, so rounds have fewer and
    fewer links, however many there are between the members of a group.  Lineage is cut
    with tables in each round; an empty link table gives no rows.
    """
    spark = links.sparkSession
    c = F.col
    name = lambda end: F.xxhash64(c(end).cast("long"))
    both = links.select(name("a").alias("u"), name("b").alias("v")).union(links.select(name("b"), name("a")))
    left, path = materialize(both.distinct(), "links")
    ends = links.select(c("a").alias("node")).union(links.select("b")).distinct()
    labels, label_path = materialize(ends.select("node", name("node").alias("comp")), "labels")
    paths = [path, label_path]
    while not left.isEmpty():
        low = left.groupBy("u").agg(F.least(F.min("v"), c("u")).alias("low"))
        moved, moved_path = materialize(low.join(low.select(c("u").alias("low"), c("low").alias("to")), "low").select("u", "to"), "moved")
        labels, label_path = materialize(labels.join(moved.withColumnRenamed("u", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        ends = left.join(moved, "u").select("v", c("to").alias("u")).join(moved.withColumnRenamed("u", "v"), "v").select("u", c("to").alias("v"))
        left, path = materialize(ends.where("u <> v").distinct(), "links")
        paths += [moved_path, label_path, path]
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    out, _ = materialize(labels.join(least, "comp").select("node", c("least").alias("comp")), "labels")
    remove(spark, *paths)
    return out
