"""Extraction tiers: explicit structure, curated packs, vocabulary mentions; and the registry they resolve names in.

The registry (id, name, type, aliases, options, tags, radar, mention_forms,
case_sensitive, wikipedia_url, canonical_url, notes, ord) is a lookup table.  It is
joined, and Spark broadcasts it only while it is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.ontology import DEFAULT, Ontology
from lattica.iterate import cut
from lattica.operators.filters import canonical_inverse, canonical_symmetric
from lattica.schema import DOCUMENT, EDGE, NODE, conform

REGISTRY = "id string, name string, type string, aliases array<string>, options array<string>, tags array<string>, radar array<string>, mention_forms array<string>, case_sensitive boolean, wikipedia_url string, canonical_url string, notes string, ord bigint"
KIND_TYPE = {"article": "Document", "assessment": "Assessment", "radar": "RadarEntry"}


class RegistryError(ValueError):
    pass


class PackError(ValueError):
    pass


def check_registry(registry: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    """(id, problem): duplicate ids and unknown types."""
    twice = registry.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return twice.unionByName(registry.where(~F.col("type").isin(*ontology.entity_types)).select("id", F.lit("unknown type").alias("problem")))


def lookups(registry: DataFrame) -> DataFrame:
    """(kind, key, entity): names by slug (first owner), options (all owners), radar and tag keys."""
    r = registry
    names = r.select("ord", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"))
    first = names.select(T.slug(F.col("raw")).alias("key"), "ord", "id").where("key <> ''").groupBy("key").agg(F.min_by("id", "ord").alias("entity"))
    many = lambda kind, c: r.select(F.lit(kind).alias("kind"), F.explode(c).alias("key"), F.col("id").alias("entity")).distinct()
    return first.select(F.lit("name").alias("kind"), "key", "entity").unionByName(many("option", "options")).unionByName(many("radar", "radar")).unionByName(many("tag", "tags"))


def resolve(raw: DataFrame, registry: DataFrame, kind: str, column: str = "raw") -> DataFrame:
    """``raw`` rows with ``entity``: registered ids, or ``entity:`` and the slug for names and options that are not."""
    table = lookups(registry)
    if kind in ("radar", "tag"):
        return raw.join(table.where(F.col("kind") == kind).select(F.col("key").alias(column), "entity"), column)
    by_option = table.where("kind = 'option'").select(F.col("key").alias(column), F.col("entity").alias("_o"))
    by_name = table.where("kind = 'name'").select(F.col("key").alias("_slug"), F.col("entity").alias("_n"))
    out = raw.withColumn("_slug", T.slug(F.col(column)))
    if kind == "option":
        out = out.join(by_option, column, "left")
    else:
        out = out.withColumn("_o", F.lit(None).cast("string"))
    return out.where("_slug <> ''").join(by_name, "_slug", "left").withColumn("entity", F.coalesce("_o", "_n", F.concat(F.lit("entity:"), "_slug"))).drop("_slug", "_o", "_n")


def registry_nodes(registry: DataFrame) -> DataFrame:
    links = F.map_filter(F.create_map(F.lit("wikipedia"), F.col("wikipedia_url"), F.lit("canonical"), F.col("canonical_url")), lambda _, v: v.isNotNull())
    notes = F.map_filter(F.create_map(F.lit("notes"), F.col("notes")), lambda _, v: v.isNotNull())
    return conform(registry.select("id", F.col("name").alias("label"), "type", "aliases", links.alias("urls"), notes.alias("meta"), "ord"), NODE)


TIER_STEP = 1 << 50


def deterministic(docs: DataFrame, registry: DataFrame, ontology: Ontology = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that documents state by their structure; edges that the ontology does not allow are dropped."""
    own, edges = stated_claims(docs, registry, ontology)
    nodes = cut(registry_nodes(registry).unionByName(conform(own, NODE)))
    # a node that several documents mention has one type: the first writer's
    firsts = nodes.groupBy("id").agg(F.min_by("type", "ord").alias("type"))
    return nodes, ontology.typecheck(edges, firsts)


def stated_claims(docs: DataFrame, registry: DataFrame, ontology: Ontology = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``doc``, edges) of each document by itself; what holds between documents is not judged."""
    node = f"{NODE}, doc string"
    docs = conform(docs, DOCUMENT).where("kind <> 'entity-pack'")
    kinds = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_TYPE.items() for x in kv]), F.col("kind")), F.lit("Document"))
    after = lambda k: F.col("ord") + k * (1 << 40)
    own = conform(docs.select("id", F.col("title").alias("label"), kinds.alias("type"), "url", F.col("date").alias("valid_from"), after(1).alias("ord"), F.col("id").alias("doc")), node)
    tags = docs.select("id", "ord", F.explode("tags").alias("raw"))
    topics = conform(tags.select(F.concat(F.lit("topic:"), "raw").alias("id"), F.regexp_replace("raw", "-", " ").alias("label"), F.lit("Topic").alias("type"), after(2).alias("ord"), F.col("id").alias("doc")), node)
    options = resolve(docs.select("id", "kind", "ord", F.posexplode(F.coalesce("platforms", "options", F.array().cast("array<string>"))).alias("place", "raw")), registry, "option")
    unregistered = options.join(registry.select(F.col("id").alias("entity")), "entity", "left_anti")
    met = conform(unregistered.select(F.col("entity").alias("id"), F.col("raw").alias("label"), F.lit("Technology").alias("type"), after(3).alias("ord"), F.col("id").alias("doc")), node)

    edge = lambda df, s, rel, t, why="explicit": df.select(F.col(s).alias("src"), F.lit(rel).alias("rel"), F.col(t).alias("dst"), F.lit(1.0).alias("confidence"), F.col("doc"), F.lit("deterministic").alias("tier"), (F.lit(why) if isinstance(why, str) else why).alias("explanation"), "ord")
    links = edge(docs.select("id", "ord", F.explode("links").alias("to"), F.col("id").alias("doc")), "id", "REFERENCES", "to")
    about = edge(tags.select("id", "ord", F.concat(F.lit("topic:"), "raw").alias("topic"), F.col("id").alias("doc")), "id", "ABOUT", "topic")
    covered = edge(resolve(tags.withColumn("doc", F.col("id")), registry, "tag"), "id", "COVERS", "entity")
    opts = options.withColumn("doc", F.col("id"))
    assessed = edge(opts.where("kind = 'assessment'"), "id", "ASSESSES", "entity")
    # pairs of different options of one scorecard; the parts of a split option are not paired
    left = opts.where("kind = 'assessment'").select("id", "doc", "ord", F.col("place").alias("pa"), F.col("entity").alias("a"))
    right = opts.where("kind = 'assessment'").select("id", F.col("place").alias("pb"), F.col("entity").alias("b"))
    pairs = left.join(right, "id").where("pa < pb and a <> b").select("doc", "ord", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    compared = edge(pairs, "x", "COMPARES_TO", "y", "scored on the same axes")
    radar_doc = docs.where("kind = 'radar'")
    by_option = opts.where("kind = 'radar'")
    by_entry = resolve(radar_doc.where("coalesce(size(options), 0) <= 0").select("id", "ord", F.col("id").alias("doc"), F.col("entry").alias("raw")).where("raw is not null"), registry, "radar")
    radar = edge(by_option, "entity", "HAS_RADAR_ENTRY", "id", "radar-scorecard-option").unionByName(edge(by_entry, "entity", "HAS_RADAR_ENTRY", "id", "radar-registry"))
    assessed_in = edge(radar_doc.where("assessment is not null").select("id", "ord", F.col("id").alias("doc"), "assessment"), "id", "ASSESSED_IN", "assessment")
    documented = edge(radar_doc.where("documented_in is not null").select("id", "ord", F.col("id").alias("doc"), "documented_in"), "id", "DOCUMENTED_IN", "documented_in")
    edges = conform(reduce(DataFrame.unionByName, [links, about, covered, assessed, compared, radar, assessed_in, documented]), EDGE)
    return reduce(DataFrame.unionByName, [own, topics, met]), edges


PACK_RELATION = "doc string, source_id string, relationship string, target_id string, confidence double, explanation string, scope string, sources array<string>, ord bigint"


def curated(entities: DataFrame, relations: DataFrame, registry: DataFrame, ontology: Ontology = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of curated packs; any relation that does not hold raises ``PackError``.

    ``entities`` has (doc, id, name, type, description, aliases, ord), ``relations`` ``PACK_RELATION``.
    """
    nodes = conform(entities.select("id", F.col("name").alias("label"), "type", "aliases", F.map_filter(F.create_map(F.lit("description"), F.col("description")), lambda _, v: v.isNotNull()).alias("meta"), (F.col("ord") + TIER_STEP).alias("ord")), NODE)
    edges = relations.select(F.col("source_id").alias("src"), F.col("relationship").alias("rel"), F.col("target_id").alias("dst"), "scope", "confidence", "explanation", "doc", F.lit("curated").alias("tier"), (F.col("ord") + TIER_STEP).alias("ord"))
    edges = canonical_inverse(edges, ontology.inverse)
    known = entities.select("id", "type", "ord").unionByName(registry.select("id", "type", "ord")).groupBy("id").agg(F.min_by("type", "ord").alias("type"))
    semantic = [r for rels in ontology.groups.values() for r in rels]
    bad = ontology.edge_problems(edges, known)
    missing = edges.where(~F.col("rel").isin(*semantic) | F.col("confidence").isNull() | (F.coalesce("explanation", F.lit("")) == "")).select("src", "rel", "dst", F.lit("not semantic, or without confidence or explanation").alias("problem"))
    first = bad.unionByName(missing).limit(20).collect()
    if first:
        raise PackError("; ".join(f"{r.src} {r.rel} {r.dst}: {r.problem}" for r in first))
    edges = canonical_symmetric(edges, ontology.symmetric)
    rest = [c for c in edges.columns if c not in ("doc", "src", "rel", "dst")]
    unique = edges.groupBy("doc", "src", "rel", "dst").agg(F.min_by(F.struct(*rest), "ord").alias("x")).select("doc", "src", "rel", "dst", *[F.col(f"x.{c}") for c in rest])
    return nodes, conform(unique, EDGE)


def vocabulary(nodes: DataFrame, registry: DataFrame, ontology: Ontology = DEFAULT) -> DataFrame:
    """(form, entity, exact): trusted surface forms of entities but companies; exact forms are told apart by case."""
    forms = F.filter(T.surface_forms(F.col("label")), T.trusted_form)
    r = registry.select("id", "mention_forms", F.coalesce("case_sensitive", F.lit(False)).alias("exact"))
    n = nodes.where(F.col("type").isin(*[t for t in ontology.entity_types if t != "Company"])).select("id", "label").distinct()
    own = n.join(r, "id", "left").select(F.col("id").alias("entity"), F.coalesce("exact", F.lit(False)).alias("exact"), F.explode(F.coalesce("mention_forms", forms)).alias("form"))
    return own.where("form <> ''").select(F.when(F.col("exact"), F.col("form")).otherwise(F.lower("form")).alias("form"), "entity", "exact").distinct()


MOST_FORMS = 2_000_000


def mentions(docs: DataFrame, vocab: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, entity): entities named in articles: a form of 10 characters once, a shorter one twice.

    Hits may not touch a letter, digit, ``_`` or ``-``, and hits of one entity may not
    overlap.  The automaton is built once in each Python worker, from a vocabulary whose
    size is checked; a larger one is scanned in shards.
    """
    import ahocorasick

    spark = docs.sparkSession
    vocab = cut(vocab)
    shards = max(1, -(-vocab.count() // MOST_FORMS))
    kind = docs.schema[key].dataType.simpleString()
    found = []
    for shard in range(shards):
        rows = [tuple(r) for r in vocab.where(F.pmod(F.xxhash64("entity"), F.lit(shards)) == shard).select("form", "entity", "exact").collect()]
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machines = {}
            for exact in (True, False):
                a = ahocorasick.Automaton()
                by: dict[str, list[str]] = {}
                for form, entity, e in shared.value:
                    if e == exact:
                        by.setdefault(form, []).append(entity)
                for form, entities in by.items():
                    a.add_word(form, (len(form), tuple(entities)))
                if by:
                    a.make_automaton()
                    machines[exact] = a
            inside = lambda ch: ch.isalnum() or ch in "_-"
            for b in batches:
                rows, entities = [], []
                for k, t in enumerate(b.column(text).to_pylist()):
                    hits: dict[str, list[tuple[int, int]]] = {}
                    for exact, a in machines.items():
                        s = t if exact else t.lower()
                        for end, (n, owners) in a.iter(s):
                            start = end - n + 1
                            if (start and inside(s[start - 1])) or (end + 1 < len(s) and inside(s[end + 1])):
                                continue
                            for o in owners:
                                hits.setdefault(o, []).append((end + 1, start))
                    for o, spans in hits.items():
                        n, last = 0, 0
                        for end, start in sorted(spans):
                            if start >= last:
                                n, last = n + 1, end
                        if n >= 2 or any(e - s >= 10 for e, s in spans):
                            rows.append(k)
                            entities.append(o)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(entities, pa.string())], [key, "entity"])

        found.append(docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(scan, f"{key} {kind}, entity string"))
    return reduce(DataFrame.unionByName, found)


def mention_edges(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    hits = mentions(docs.where("kind = 'article'").select("id", "text"), vocab)
    return conform(hits.select(F.col("id").alias("src"), F.lit("COVERS").alias("rel"), F.col("entity").alias("dst"), F.lit("extracted").alias("tier"), F.col("id").alias("doc"), (F.lit(2 * TIER_STEP) + F.pmod(F.xxhash64("id", "entity"), F.lit(1 << 40))).alias("ord")), EDGE)


def build(docs: DataFrame, registry: DataFrame, ontology: Ontology = DEFAULT, packs: tuple[DataFrame, DataFrame] | None = None, cited: DataFrame | None = None):
    """Documents to the published graph: three tiers, merged, retracted and pruned; ``cited`` are pages that packs name."""
    from lattica.operators.merge import merge

    nodes, edges = deterministic(docs, registry, ontology)
    if packs is not None:
        n, e = curated(*packs, registry, ontology)
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    if cited is not None:
        edges = edges.unionByName(cited)
    edges = cut(edges.unionByName(mention_edges(docs, vocabulary(nodes, registry, ontology))))
    return merge(nodes, edges, docs.select("id"))
