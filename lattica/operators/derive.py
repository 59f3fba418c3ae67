"""Derivation: rules to a fixpoint, co-occurrence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.iterate import numbered, table
from lattica.schema import given


@dataclass(frozen=True)
class Rule:
    """``kind``: transitive, inverse, symmetric or composition; ``damping`` weakens each derivation."""

    kind: str
    rel: str
    target: str | None = None
    second: str | None = None
    damping: float = 0.9

    @property
    def head(self) -> str:
        return self.target or (f"inv_{self.rel}" if self.kind == "inverse" else self.rel)


def infer(edges: DataFrame, rules: list[Rule], rounds: int = 10) -> DataFrame:
    """(src, rel, dst, confidence, round): facts derived until a round adds nothing.

    Semi-naive: a round joins the facts of the round before with all that are known at its start.  Of several derivations of a fact the
    first in the order of rule, first edge and second edge counts; edges are ordered by
    round, then by key.
    """
    c = F.col
    key = ["src", "rel", "dst"]
    base = edges.groupBy(*key).agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence")).withColumn("round", F.lit(0))
    found = [table(base)]  # a table for each round: what is known is never written again

    def side(facts: DataFrame, rel: str, ends: tuple[str, str], n: str) -> DataFrame:
        return facts.where(c("rel") == rel).select(c("src").alias(ends[0]), c("dst").alias(ends[1]), c("confidence").alias(f"c{n}"), F.struct("round", "src", "dst").alias(f"o{n}"))

    for n in range(1, rounds + 1):
        fresh, known = found[-1], reduce(DataFrame.unionByName, found)
        made = []
        for i, r in enumerate(rules):
            if r.kind in ("transitive", "composition"):
                # a new fact is in every new derivation: new with all, and what was known before with new
                second = r.second or r.rel
                pairs = [(fresh, known)] + ([(reduce(DataFrame.unionByName, found[:-1]), fresh)] if n > 1 else [])
                for x, y in pairs:
                    j = side(x, r.rel, ("s", "m"), "1").join(side(y, second, ("m", "d"), "2"), "m").where("s <> d")
                    made.append(j.select(c("s").alias("src"), F.lit(r.head).alias("rel"), c("d").alias("dst"), F.round(c("c1") * c("c2") * r.damping, 4).alias("confidence"), F.struct(F.lit(i).alias("i"), "o1", "o2").alias("at")))
            else:
                a = side(fresh, r.rel, ("s", "m"), "1")
                made.append(a.select(c("m").alias("src"), F.lit(r.head).alias("rel"), c("s").alias("dst"), F.round(c("c1") * r.damping, 4).alias("confidence"), F.struct(F.lit(i).alias("i"), "o1", c("o1").alias("o2")).alias("at")))
        if not made:
            break
        # of the derivations of a fact one goes on before it meets what is known
        best = reduce(DataFrame.unionByName, made).groupBy(*key).agg(F.min_by("confidence", "at").alias("confidence"))
        new = table(best.join(known.select(*key), key, "left_anti").select(*key, "confidence", F.lit(n).alias("round")))
        if new.isEmpty():
            break
        found.append(new)
    return reduce(DataFrame.unionByName, found)


#: A document of at most so many entities makes all pairs of them.
LIGHT = 128


def cooccurrence(mentions: DataFrame, edges: DataFrame | None = None, threshold: float = 0.5, least: int = 2, light: int = LIGHT) -> DataFrame:
    """(a, b, shared, confidence): entities by the Jaccard of their documents; ``mentions`` has (entity, doc).

    Documents of at most ``light`` entities are counted as stripes: for each entity the list of those that come after it, fewest
    documents first, so what an entity of very many documents meets is counted at the others.  Only documents of more entities go by a
    prefix filter: an entity's documents stand in the order of how many entities they hold, and two entities
    that share enough share one of their first documents.  So such documents make no pairs where rarer ones
    do; what the pairs share in them is then looked up.  Connected pairs are left out, and so are null entities.
    """
    c = F.col
    m = table(mentions.where(given("doc").isNotNull() & c("entity").isNotNull()).select("entity", "doc").distinct())
    held = m.groupBy("doc").agg(F.count(F.lit(1)).alias("entities"))
    many = held.where(c("entities") > light)
    some = not many.isEmpty()
    heavy = table(m.join(many, "doc")) if some else m.limit(0).withColumn("entities", F.lit(0).cast("long"))
    weight = heavy.groupBy("entity").agg(F.count(F.lit(1)).alias("h"))
    size = m.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).join(weight, "entity", "left").select("entity", "n", F.coalesce("h", F.lit(0)).alias("h"))
    ids = numbered(size, "n", "entity", name="e")
    kind = "int" if ids.count() < 2**31 else "bigint"
    ids = table(ids.select("entity", c("e").cast(kind).alias("e"), "n", "h"))
    of = lambda end: ids.select(c("e").alias(end), c("entity").alias(f"name_{end}"), c("n").alias(f"n{end}"), c("h").alias(f"h{end}"))
    required = lambda n: F.greatest(F.lit(least), F.ceil(n - 1e-9))
    enough = required(threshold / (1 + threshold) * (c("na") + c("nb")))
    # light documents: stripes, kept together by their first entity
    few = m.join(held.where(c("entities").between(2, light)).select("doc"), "doc", "left_semi") if some else m
    docs = few.join(ids, "entity").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("e", "n", "h"))).alias("es")).where(F.size("es") > 1)
    after = lambda x, i: F.filter(F.slice("es", i + 2, F.size("es")), lambda y: x["n"] >= threshold * y["n"] - 1e-9)
    stripe = F.transform("es", lambda x, i: F.struct(x["e"].alias("a"), x["n"].alias("na"), x["h"].alias("ha"), F.transform(after(x, i), lambda y: y["e"]).alias("bs")))
    stripes = docs.select(F.inline(stripe)).where(F.size("bs") > 0).repartition("a")
    met = stripes.select("a", "na", "ha", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("ha").alias("ha"), F.count(F.lit(1)).alias("shared"))
    # b has no fewer documents than a
    met = met.where(c("shared") + c("ha") >= required(2 * threshold / (1 + threshold) * c("na"))).select("a", "b", "shared")
    if some:
        placed = numbered(heavy.join(ids, "entity"), "e", "entities", "doc", name="at")
        starts = placed.groupBy("e").agg(F.min("at").alias("start"))
        # light documents come first
        early = placed.join(starts, "e").select("e", "doc", "n", (c("at") - c("start") + c("n") - c("h")).alias("i")).where(c("i") <= c("n") - required(threshold * c("n")))
        early = table(early)
        left, right = (early.select(c("e").alias(e), "doc", c("n").alias(f"n{e}"), c("i").alias(f"i{e}")) for e in ("a", "b"))
        close = left.join(right, "doc").where((c("a") < c("b")) & (c("na") >= threshold * c("nb") - 1e-9) & (F.least(c("na") - c("ia"), c("nb") - c("ib")) >= enough))
        found = met.unionByName(close.select("a", "b", F.lit(0).cast("long").alias("shared")).distinct()).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        pairs = table(found.join(of("a"), "a").join(of("b"), "b").where(c("shared") + F.least("ha", "hb") >= enough).select("a", "b", "ha", "hb", "shared"))
        # the documents of the entity with fewer of them are looked up in the other's
        fewer = c("ha") <= c("hb")
        looked = pairs.where("ha > 0 and hb > 0").select("a", "b", F.when(fewer, c("a")).otherwise(c("b")).alias("few"), F.when(fewer, c("b")).otherwise(c("a")).alias("many"))
        at = heavy.join(ids, "entity").select("e", "doc")
        both = looked.join(at.toDF("few", "doc"), "few").join(at.toDF("many", "doc"), ["many", "doc"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("more"))
        met = pairs.join(both, ["a", "b"], "left").select("a", "b", (c("shared") + F.coalesce("more", F.lit(0))).alias("shared"))
    j = met.where(c("shared") >= least).join(of("a"), "a").join(of("b"), "b")
    value = c("shared") / (c("na") + c("nb") - c("shared"))
    out = j.withColumn("value", value).where(c("value") >= threshold).select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b"), "shared", F.round("value", 2).alias("confidence"))
    if edges is not None:
        out = out.join(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), ["a", "b"], "left_anti")
    return out
