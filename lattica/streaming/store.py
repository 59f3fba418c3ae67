"""A store of claims that is rebuilt where documents changed.

Claims (nodes and edges as extraction states them, each with its document) lie in buckets by a hash
of the document's id.  A change rewrites the buckets of the documents that it touches, as
new Parquet files, and ends with a manifest that names each bucket's files; a reader sees the
manifest's files alone, so a run that fails leaves the graph before it.  A batch that comes
again after it was written changes nothing.

Defined results: documents with a null id are left out; of rows with one id the first by ``ord`` counts; a document
is changed if any of its columns is, ``ord`` included; documents that are no longer there take their claims with them;
a new ``stamp`` (of a vocabulary, a registry, an extractor) makes all documents changed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.iterate import cut
from lattica.ontology import DEFAULT, Ontology
from lattica.operators import extract
from lattica.operators.merge import merge
from lattica.schema import EDGE, NODE, Graph, conform

#: Documents to (nodes with a column ``doc``, edges).
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
SCHEMAS = {"docs": "doc string, hash string", "nodes": f"{NODE}, doc string", "edges": EDGE}
#: A bucket's rows are written by up to this many tasks.
TASKS_A_BUCKET = 4


class ClaimStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """``buckets`` is fixed when the store is first written."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """The newest whole manifest: version, last batch, stamp, and by kind the version of each bucket."""
        fs, p = self._fs(f"{self.path}/manifest")
        versions = sorted((int(s.getPath().getName()) for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        for v in versions:
            fs, done = self._fs(f"{self.path}/manifest/{v}/_SUCCESS")
            if fs.exists(done):
                return json.loads(self.spark.read.text(f"{self.path}/manifest/{v}").first()[0])
        return {"version": 0, "batch": -1, "stamp": "", "buckets": self.buckets, "files": {k: {} for k in SCHEMAS}}

    def read(self, kind: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a kind, of all buckets or of some."""
        files = (manifest or self.manifest())["files"][kind]
        chosen = files if buckets is None else {str(b): files[str(b)] for b in buckets if str(b) in files}
        paths = [f"{self.path}/{kind}/{v}/bucket={b}" for b, v in chosen.items()]
        schema = self.spark.createDataFrame([], SCHEMAS[kind]).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def changes(self, docs: DataFrame, stamp: str = "") -> DataFrame:
        """(doc, hash, change) between the store and ``docs``, all there are now: added, changed or removed."""
        manifest = self.manifest()
        old = self.read("docs", manifest).toDF("doc", "old")
        both = old.join(_hashed(docs), "doc", "full")
        differ = (F.col("old") != F.col("hash")) | F.lit(manifest["stamp"] != stamp)
        change = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(differ, "changed")
        return both.select("doc", "hash", change.alias("change")).where("change is not null")

    def sync(self, docs: DataFrame, extract: Extractor, batch: int | None = None, stamp: str = "") -> list[int]:
        """Bring the store to ``docs``, all there are now; returns the buckets that were rewritten."""
        return self.apply(self.changes(docs, stamp), docs, extract, batch, stamp)

    def apply(self, changes: DataFrame, docs: DataFrame, extract: Extractor, batch: int | None = None, stamp: str = "") -> list[int]:
        """Claims of changed documents replace what is stored of them; ``docs`` holds them, others in it are not read further.

        ``batch`` numbers must grow; one that was written already changes nothing.
        """
        before = self.manifest()
        if batch is not None and batch <= before["batch"]:
            return []
        n = before["buckets"]
        bucket = F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")
        changes = cut(changes.withColumn("bucket", bucket))
        touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())  # as many as there are buckets at most
        after = before | {"version": before["version"] + 1, "batch": before["batch"] if batch is None else batch, "stamp": stamp}
        if touched or stamp != before["stamp"] or batch is not None:
            after["files"] = {k: dict(v) for k, v in before["files"].items()}
            fresh = changes.where("change <> 'removed'")
            nodes, edges = extract(_first(docs).join(fresh.select(F.col("doc").alias("id")), "id", "left_semi").select(*docs.columns))
            new = {"docs": fresh.select("doc", "hash"), "nodes": nodes.select(*conform(nodes, NODE).columns, "doc"), "edges": conform(edges, EDGE)}
            for kind, rows in new.items() if touched else ():
                kept = self.read(kind, before, touched).join(changes.select("doc"), "doc", "left_anti")
                whole = kept.unionByName(rows).withColumn("bucket", bucket)
                spread = F.pmod(F.xxhash64(*SPREAD[kind]), F.lit(TASKS_A_BUCKET))
                at = f"{self.path}/{kind}/{after['version']}"
                whole.repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(at)  # over what a failed run left
                fs, p = self._fs(at)
                written = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(p) if s.isDirectory()}
                for b in map(str, touched):
                    after["files"][kind].pop(b, None)
                    if b in written:
                        after["files"][kind][b] = after["version"]
            self.spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{after['version']}")
        return touched

    def compact(self) -> list[str]:
        """Delete files that the newest manifest does not name; no reader of an older one may be at work."""
        manifest, gone = self.manifest(), []
        for kind, files in manifest["files"].items():
            fs, p = self._fs(f"{self.path}/{kind}")
            live = {(str(v), f"bucket={b}") for b, v in files.items()}
            for version in fs.listStatus(p) if fs.exists(p) else []:
                for s in fs.listStatus(version.getPath()):
                    if s.isDirectory() and (version.getPath().getName(), s.getPath().getName()) not in live:
                        gone.append(s.getPath().toString())
                        fs.delete(s.getPath(), True)
        return gone

    def graph(self, ontology: Ontology = DEFAULT, registry: DataFrame | None = None) -> Graph:
        """The published graph of all claims; what holds between documents (types, first writers, dangling ends) is judged here."""
        manifest = self.manifest()
        nodes = conform(self.read("nodes", manifest), NODE)
        if registry is not None:
            nodes = nodes.unionByName(extract.registry_nodes(registry))
        nodes = cut(nodes)
        firsts = nodes.groupBy("id").agg(F.min_by("type", "ord").alias("type"))
        return merge(nodes, ontology.typecheck(self.read("edges", manifest), firsts), self.read("docs", manifest).select(F.col("doc").alias("id")))


SPREAD = {"docs": ["doc"], "nodes": ["id"], "edges": ["src", "dst"]}


def _first(docs: DataFrame) -> DataFrame:
    """One row for each id that is not null: the first by ``ord``."""
    packed = docs.where("id is not null").select("id", "ord", F.struct(*docs.columns).alias("row"))
    return packed.groupBy("id").agg(F.min_by("row", "ord").alias("row")).select("row.*")


def _hashed(docs: DataFrame) -> DataFrame:
    return _first(docs).select(F.col("id").alias("doc"), F.sha2(F.to_json(F.struct(*sorted(docs.columns))), 256).alias("hash"))


def stated(registry: DataFrame, ontology: Ontology = DEFAULT) -> Extractor:
    """The extractor of what documents state by their structure."""

    def claims(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        return extract.stated_claims(docs, registry, ontology)

    return claims


def follow(spark: SparkSession, read: Callable[[], DataFrame], store: ClaimStore, claims: Extractor, checkpoint: str, every: str = "1 minute", stamp: str = ""):
    """A stream of ticks; at each, ``read()`` gives the documents there are now, and the buckets of changed ones are rewritten."""

    def tick(_, batch: int) -> None:
        store.sync(read(), claims, batch, stamp)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
