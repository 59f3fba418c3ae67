"""Data model: documents, nodes and edges as DataFrames, and the graph that holds two of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT = (
    "id string, title string, url string, kind string, date string, text string, tags array<string>, links array<string>, "
    "platforms array<string>, options array<string>, entry string, assessment string, documented_in string, ord bigint"
)
NODE = (
    "id string, label string, type string, url string, meta map<string,string>, aliases array<string>, urls map<string,string>, "
    "valid_from string, valid_to string, visibility string, ord bigint"
)
EDGE = (
    "src string, rel string, dst string, scope string, confidence double, explanation string, doc string, tier string, "
    "valid_from string, valid_to string, visibility string, ord bigint"
)
TIERS = ("deterministic", "curated", "extracted")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def toPandas(self):
        return self.nodes.toPandas(), self.edges.toPandas()

    def toArrow(self):
        return self.nodes.toArrow(), self.edges.toArrow()


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a DDL list; types may hold commas within angle brackets."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append((name, kind))
            part = ""
        else:
            part += ch
    return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """All columns of the schema, absent ones as null; ``source`` and ``target`` are read as ``src`` and ``dst``."""
    for old, new in (("source", "src"), ("target", "dst")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields(ddl)])


def given(c: Column | str) -> Column:
    """Null for the empty string: a missing value may be written either way."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))
