"""The closed vocabulary of a graph: entity and context types, relations with their signatures."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OntologyError(ValueError):
    pass


@dataclass(frozen=True)
class Ontology:
    entity_types: tuple[str, ...]
    context_types: tuple[str, ...] = ()
    relations: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    context_relations: tuple[str, ...] = ()
    inverse: dict[str, str] = field(default_factory=dict)
    symmetric: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        bad = self.problems()
        if bad:
            raise OntologyError("; ".join(bad))

    def problems(self) -> list[str]:
        out = [f"type {t} is both entity and context" for t in sorted(set(self.entity_types) & set(self.context_types))]
        known = set(self.entity_types) | set(self.context_types)
        grouped = [r for rels in self.groups.values() for r in rels]
        for rel, (sources, targets) in self.relations.items():
            places = grouped.count(rel) + self.context_relations.count(rel)
            if places != 1:
                out.append(f"relation {rel} stands in {places} groups or contexts")
            out += [f"relation {rel} names the unknown type {t}" for t in sorted({*sources, *targets} - known)]
        out += [f"{r} is listed but not declared" for r in sorted({*grouped, *self.context_relations, *self.symmetric} - set(self.relations))]
        out += [f"{name} is the inverse of the unknown {r}" for name, r in self.inverse.items() if r not in self.relations]
        return out

    @classmethod
    def from_toml(cls, path: str | Path, base: "Ontology | None" = None) -> "Ontology":
        doc = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        out = base.as_dict() if base and doc.get("extends") else {"entity_types": (), "context_types": (), "relations": {}, "groups": {}, "context_relations": (), "inverse": {}, "symmetric": ()}
        out["entity_types"] = tuple(dict.fromkeys([*out["entity_types"], *doc.get("entity_types", [])]))
        out["context_types"] = tuple(dict.fromkeys([*out["context_types"], *doc.get("context_types", [])]))
        seen: set[str] = set()
        for r in doc.get("relation", []):
            name = r["name"]
            if name in seen:
                raise OntologyError(f"relation {name} is declared twice")
            seen.add(name)
            out["relations"] = out["relations"] | {name: (tuple(r["source"]), tuple(r["target"]))}
            if r.get("context"):
                out["context_relations"] = tuple(dict.fromkeys([*out["context_relations"], name]))
            else:
                group = r.get("group", "Other")
                out["groups"] = out["groups"] | {group: tuple(dict.fromkeys([*out["groups"].get(group, ()), name]))}
            if r.get("symmetric"):
                out["symmetric"] = tuple(dict.fromkeys([*out["symmetric"], name]))
            if r.get("inverse"):
                out["inverse"] = out["inverse"] | {r["inverse"]: name}
        return cls(**out)

    def as_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("entity_types", "context_types", "relations", "groups", "context_relations", "inverse", "symmetric")}

    def signatures(self, spark: SparkSession) -> DataFrame:
        """(rel, src_type, dst_type), one row for each allowed pair; as small as the vocabulary."""
        rows = [(r, s, t) for r, (ss, ts) in self.relations.items() for s in ss for t in ts]
        return spark.createDataFrame(rows, "rel string, src_type string, dst_type string")

    def typecheck(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges whose ends have types that the relation allows."""
        kinds = nodes.select("id", "type")
        typed = edges.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
        return typed.join(F.broadcast(self.signatures(edges.sparkSession)), ["rel", "src_type", "dst_type"], "left_semi").select(*edges.columns)

    def edge_problems(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """(src, rel, dst, problem): unknown relation, wrong signature, confidence out of range."""
        kinds = nodes.select("id", "type")
        typed = edges.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left").join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
        allowed = F.broadcast(self.signatures(edges.sparkSession).withColumn("fits", F.lit(True)))
        known = F.col("rel").isin(*self.relations)
        checks = F.array(
            F.when(~known, F.lit("unknown relation")),
            F.when(known & F.col("fits").isNull(), F.lit("wrong signature")),
            F.when(~F.col("confidence").between(0, 1), F.lit("confidence out of range")),
        )
        return typed.join(allowed, ["rel", "src_type", "dst_type"], "left").select("src", "rel", "dst", F.explode(F.array_compact(checks)).alias("problem"))

    def conforming(self, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entities of an entity type with an id; relations of known name (in any case, handed on in lower case) between them."""
        kept = entities.where(F.col("type").isin(*self.entity_types) & (F.coalesce("id", F.lit("")) != ""))
        names = [r.lower() for r in self.relations]
        ids = kept.select("id")
        rels = relations.withColumn("rel", F.lower("rel")).where(F.col("rel").isin(*names))
        rels = rels.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return kept, rels.select(*relations.columns)

    def to_dot(self) -> str:
        """A DOT graph: entity types as boxes, context types as ellipses, an arrow for each allowed pair, dashed for context relations."""
        types = [f'  "{t}" [shape=box];' for t in sorted(self.entity_types)] + [f'  "{t}" [shape=ellipse];' for t in sorted(self.context_types)]
        arrows = [f'  "{s}" -> "{t}" [label="{r}", style={"dashed" if r in self.context_relations else "solid"}];' for r, (ss, ts) in sorted(self.relations.items()) for s in sorted(ss) for t in sorted(ts)]
        return "\n".join(["digraph ontology {", *types, *arrows, "}", ""])


# The default vocabulary.
_TECH = ("Technology", "Component", "Product", "CloudService", "Language", "API", "Protocol", "Standard", "FileFormat", "TableFormat")
_ENTITY = ("Concept", "ArchitecturePattern", "Technology", "Component", "Language", "API", "Protocol", "Standard", "FileFormat", "TableFormat", "Product", "CloudService", "Company", "UseCase")
_COMPARABLE = (*_TECH, "Concept", "ArchitecturePattern")
_STORES = ("FileFormat", "TableFormat", "Technology", "Component", "CloudService")
DEFAULT = Ontology(
    entity_types=_ENTITY,
    context_types=("Document", "Assessment", "RadarEntry", "Topic"),
    relations={
        "IMPLEMENTS": (_TECH, ("Concept", "ArchitecturePattern", "Protocol", "Standard")),
        "SUPPORTS": (_TECH, ("Concept", "Protocol", "Standard", "FileFormat", "TableFormat", "Language", "API")),
        "USES": (_TECH, tuple(t for t in _ENTITY if t not in ("UseCase", "Company"))),
        "HAS_COMPONENT": (_TECH, ("Component", "API")),
        "BASED_ON": (_TECH, (*_TECH, "Concept")),
        "INCLUDED_IN": (("Technology", "Component"), ("Product", "CloudService")),
        "READS": (_TECH, _STORES),
        "WRITES": (_TECH, _STORES),
        "RUNS_ON": (_TECH, ("Technology", "Component", "Product", "CloudService")),
        "INTEGRATES_WITH": (_TECH, _TECH),
        "CONSUMES": (_TECH, _TECH),
        "MANAGED_BY": (("Technology",), ("CloudService", "Product")),
        "PROVIDED_BY": (("Product", "CloudService", "Technology"), ("Company",)),
        "SUPPORTS_USE_CASE": (_COMPARABLE, ("UseCase",)),
        "ALTERNATIVE_TO": (_COMPARABLE, _COMPARABLE),
        "COMPLEMENTS": (_COMPARABLE, _COMPARABLE),
        "COMPARES_TO": (_COMPARABLE, _COMPARABLE),
        "COVERS": (("Document",), _ENTITY),
        "PRIMARY_TOPIC_OF": (_ENTITY, ("Document", "Assessment")),
        "DISCUSSED_IN": (_ENTITY, ("Document", "Assessment")),
        "ASSESSES": (("Assessment",), _COMPARABLE),
        "HAS_RADAR_ENTRY": (_ENTITY, ("RadarEntry",)),
        "ASSESSED_IN": (("RadarEntry",), ("Assessment",)),
        "DOCUMENTED_IN": (("RadarEntry",), ("Document", "Assessment")),
        "ABOUT": (("Document",), ("Topic",)),
        "REFERENCES": (("Document",), ("Document",)),
    },
    groups={
        "Structure": ("HAS_COMPONENT", "BASED_ON", "INCLUDED_IN"),
        "Concepts": ("IMPLEMENTS", "SUPPORTS", "USES", "SUPPORTS_USE_CASE"),
        "Data flow": ("READS", "WRITES", "RUNS_ON", "INTEGRATES_WITH", "CONSUMES"),
        "Commercial": ("MANAGED_BY", "PROVIDED_BY"),
        "Alternatives": ("ALTERNATIVE_TO", "COMPLEMENTS", "COMPARES_TO"),
    },
    context_relations=("COVERS", "PRIMARY_TOPIC_OF", "DISCUSSED_IN", "ASSESSES", "HAS_RADAR_ENTRY", "ASSESSED_IN", "DOCUMENTED_IN", "ABOUT", "REFERENCES"),
    inverse={"IMPLEMENTED_BY": "IMPLEMENTS", "COMPONENT_OF": "HAS_COMPONENT"},
    symmetric=("COMPARES_TO", "INTEGRATES_WITH", "ALTERNATIVE_TO", "COMPLEMENTS"),
)
