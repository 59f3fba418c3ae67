"""A graph from a config file: sources, registry, vocabulary and packs to the published file.

Every path in a config is relative to the config file.  Sources are read by Spark in
the config's order, which is the order of precedence among documents.
"""

from __future__ import annotations

import re
import tomllib
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.ontology import DEFAULT, Ontology
from lattica.operators import extract
from lattica.schema import DOCUMENT, EDGE, Graph, conform, fields, given
from lattica.sources import files

#: Ordinals of one source's documents stay below this.
SOURCE_STEP = 1 << 34


def load_config(path: str | Path) -> dict:
    """The config with its paths made absolute."""
    at = Path(path).resolve()
    config = tomllib.loads(at.read_text(encoding="utf-8"))
    places = [(s, k) for s in config.get("sources", []) for k in ("path", "index", "url_list_file") if k in s]
    places += [(config["ontology"], k) for k in ("entities", "schema") if k in config.get("ontology", {})]
    for table, key in places:
        if not re.match(r"[a-z0-9]+:", str(table[key])):  # a path with a scheme stays
            table[key] = str((at.parent / table[key]).resolve())
    return config


def registry_table(spark: SparkSession, path: str | None, ontology: Ontology = DEFAULT) -> DataFrame:
    """Entities of a registry file; a duplicate id or an unknown type raises ``RegistryError``."""
    entries = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("entity", []) if path else []
    names = [n for n, _ in fields(extract.REGISTRY)]
    rows = []
    for i, e in enumerate(entries):
        e = e | {"id": e["id"] if e["id"].startswith("entity:") else f"entity:{e['id']}", "ord": i}
        rows.append(tuple(e.get(n) for n in names))
    out = spark.createDataFrame(rows, extract.REGISTRY)
    bad = extract.check_registry(out, ontology).limit(20).collect()
    if bad:
        raise extract.RegistryError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    return out


def cited_document(url: Column, prefix: str, site_url: str | None = None, id_prefix: str = "") -> Column:
    """The document that a URL below ``prefix`` (of the site, or without one) names; null for any other URL."""
    site = f"(?:{re.escape(site_url.rstrip('/'))})?" if site_url else ""
    slug = F.regexp_extract(url, rf"^{site}{re.escape(prefix)}([a-z0-9-]+)/?$", 1)
    return F.when(given(slug).isNotNull(), F.concat(F.lit(id_prefix), slug))


def citations(entities: DataFrame, packs: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, unmatched): pages that packs cite for their entities, and (doc, id, field, url) of URLs below no prefix."""
    p = packs or {}
    site = p.get("site_url")
    blog = (p.get("blog_prefix", "/blog/"), site, "")
    scored = (p.get("assessment_prefix", "/architecture-radar/"), site, p.get("assessment_id_prefix", "assessment:"))
    cites = [("blog_url", "PRIMARY_TOPIC_OF", blog, 0), ("related_blog_urls", "DISCUSSED_IN", blog, 1), ("architecture_radar_url", "DISCUSSED_IN", scored, 2)]
    parts = []
    for field, rel, (prefix, at, id_prefix), k in cites:
        if field in entities.columns:
            urls = F.col(field) if field.endswith("s") else F.array(field)
            rows = entities.select("doc", "id", "ord", F.posexplode(urls).alias("place", "url")).where(given("url").isNotNull())
            parts.append(rows.select("doc", "id", F.lit(field).alias("field"), F.lit(rel).alias("rel"), "url", cited_document(F.col("url"), prefix, at, id_prefix).alias("dst"), (F.col("ord") * 64 + k * 16 + F.least("place", F.lit(15)) + extract.TIER_STEP).alias("ord")))
    if not parts:
        return conform(entities.limit(0).select("doc"), EDGE), entities.limit(0).select("doc", "id", F.lit("").alias("field"), F.lit("").alias("url"))
    all_ = reduce(DataFrame.unionByName, parts)
    edges = all_.where("dst is not null").select(F.col("id").alias("src"), "rel", "dst", F.lit(1.0).alias("confidence"), F.lit("cited page").alias("explanation"), "doc", F.lit("curated").alias("tier"), "ord")
    return conform(edges, EDGE), all_.where("dst is null").select("doc", "id", "field", "url")


def documents(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None, list[str]]:
    """(documents of all sources, pack entities and relations, names of the sources)."""
    docs, packs, names = [], [], []
    for i, spec in enumerate(sources):
        options = {k: v for k, v in spec.items() if k not in ("type", "path")}
        got = files.open_source(spark, spec["type"], spec.get("path", ""), **options)
        if isinstance(got, tuple):
            if len(got) == 3:
                packs.append(got[1:])
            got = got[0]
        docs.append(conform(got, DOCUMENT).withColumn("ord", F.col("ord") + i * SOURCE_STEP))
        names.append(spec["type"])
    if not docs:
        return spark.createDataFrame([], DOCUMENT), None, names
    both = tuple(reduce(DataFrame.unionByName, x) for x in zip(*packs)) if packs else None
    return reduce(DataFrame.unionByName, docs), both, names


def build(spark: SparkSession, config: dict) -> tuple[Graph, dict]:
    """The graph of a config and its head: schema version, sources, types."""
    onto = config.get("ontology", {})
    ontology = Ontology.from_toml(onto["schema"], DEFAULT) if onto.get("schema") else DEFAULT
    docs, packs, names = documents(spark, config.get("sources", []))
    registry = registry_table(spark, onto.get("entities"), ontology)
    cited = citations(packs[0], config.get("packs"))[0] if packs else None
    graph = extract.build(docs, registry, ontology, packs, cited)
    return graph, {"schema_version": 1, "sources": names, "entity_types": list(ontology.entity_types), "context_types": list(ontology.context_types)}
