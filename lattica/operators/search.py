"""Search and similarity: BM25, rank fusion, hybrid search, MinHash and LSH, vectors, disambiguation, fuzzy search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.functions import text as T
from lattica.iterate import cut, numbered
from lattica.operators.analytics import pagerank
from lattica.operators.merge import drop_dangling
from lattica.schema import Graph
from lattica.session import ship

K1, B = 1.5, 0.75


def bm25(corpus: DataFrame, query: str, limit: int | None = 100, key: str = "id", text: str = "text") -> DataFrame:
    """(key, score): Lucene's idf; a repeated query term counts repeatedly.

    Only the query's terms are exploded; lengths come from a pass without a shuffle of terms.
    """
    import regex

    terms = regex.findall(r"[\p{L}\p{N}_]+", query.lower())
    spark = corpus.sparkSession
    wanted = spark.createDataFrame([(t, terms.count(t)) for t in sorted(set(terms))], "term string, times int")
    tokens = corpus.select(key, T.words(F.col(text)).alias("ws"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ws")).alias("mean"))
    hits = tokens.select(key, F.size("ws").alias("len"), F.explode(F.filter("ws", lambda w: w.isin(*terms) if terms else F.lit(False))).alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = cut(hits)  # read for document frequencies and for scores: one pass over the texts
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df.join(wanted, "term")), "term").join(F.broadcast(stats))  # query terms and one row of totals
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scores = rows.groupBy(key).agg(F.sum(part * F.col("times")).alias("score")).where("score > 0")
    return scores if limit is None else scores.orderBy(F.desc("score"), key).limit(limit)


def ranked(scores: DataFrame, key: str = "id") -> DataFrame:
    """Places by score, ties by key; over range partitions."""
    return numbered(scores, F.desc("score"), F.col(key), name="rank")


def fuse(rankings: list[DataFrame], k: int = 60, key: str = "id") -> DataFrame:
    """Reciprocal rank fusion over (key, rank)."""
    rows = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def graph_text(graph: Graph) -> DataFrame:
    """(id, text): label, aliases, scalar meta and the explanations of edges at a node."""
    said = graph.edges.where("explanation is not null")
    both = said.select(F.col("src").alias("id"), "ord", "explanation").union(said.select("dst", "ord", "explanation"))
    notes = both.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "explanation"))), lambda x: x["explanation"]), " ").alias("notes"))
    parts = F.concat_ws(" ", "label", F.array_join("aliases", " "), F.array_join(F.map_values("meta"), " "), "notes")
    return graph.nodes.join(notes, "id", "left").select("id", parts.alias("text"))


def hybrid(graph: Graph, query: str, k: int = 15, fusion: int = 60) -> tuple[DataFrame, DataFrame]:
    """(ranking, edges): BM25 and PageRank from its three best hits, fused; edges among the results."""
    hits = ranked(bm25(graph_text(graph), query, limit=2 * k))
    seeds = [(r["id"], 1 / r["rank"]) for r in hits.where("rank <= 3").orderBy("rank").collect()]
    rankings = [hits]
    if seeds:
        weight = F.create_map(*[F.lit(x) for s in seeds for x in s])
        near = pagerank(graph, [s for s, _ in seeds]).groupBy("id").agg(F.sum(F.col("score") * F.try_element_at(weight, F.col("seed"))).alias("score"))
        rankings.append(ranked(graph.nodes.select("id").join(near, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))))
    best = fuse(rankings, fusion).orderBy(F.desc("score"), "id").limit(k)
    return best, drop_dangling(graph.edges, best)


def lsh_candidates(signatures: DataFrame, bands: int = 16, key: str = "id", column: str = "sig", count: int = 64) -> DataFrame:
    """Distinct pairs (a, b) that agree in a whole band."""
    rows = count // bands
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(column, i * rows + 1, F.lit(rows))).alias("h"))))
    keyed = signatures.select(F.col(key).alias("id"), column, band.alias("x")).select("id", F.col(column).alias("sig"), F.col("x.band").alias("band"), F.col("x.h").alias("h"))
    other = keyed.select(F.col("id").alias("b"), F.col("sig").alias("sb"), "band", "h")
    met = keyed.withColumnsRenamed({"id": "a", "sig": "sa"}).join(other, ["band", "h"]).where("a < b")
    return met.groupBy("a", "b").agg(F.first("sa").alias("sa"), F.first("sb").alias("sb"))


def signature_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def duplicate_candidates(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, similarity) over label and aliases, most similar first."""
    text = F.concat_ws(" ", "label", F.array_join("aliases", " "))
    sigs = nodes.select("id", T.minhash(text).alias("sig"))
    pairs = lsh_candidates(sigs).select("a", "b", signature_similarity(F.col("sa"), F.col("sb")).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "a", "b")


def merge_duplicates(graph: Graph, pairs: DataFrame) -> Graph:
    """``pairs`` (canonical, duplicate): aliases are kept, edges repointed, loops and repeats dropped."""
    to = pairs.groupBy(F.col("duplicate").alias("id")).agg(F.min("canonical").alias("into"))
    gone = graph.nodes.join(to, "id").groupBy(F.col("into").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("more"))
    kept = graph.nodes.join(to, "id", "left_anti").join(gone, "id", "left")
    nodes = kept.withColumn("aliases", F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array_except("more", F.array("label")))))).drop("more")
    e = graph.edges
    for end in ("src", "dst"):
        e = e.join(to.withColumnsRenamed({"id": end, "into": "_to"}), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    rest = [c for c in e.columns if c not in ("src", "rel", "dst")]
    unique = e.where("src <> dst").groupBy("src", "rel", "dst").agg(F.min_by(F.struct(*rest), "ord").alias("x")).select("src", "rel", "dst", *[F.col(f"x.{c}") for c in rest])
    return Graph(nodes, unique.select(*graph.edges.columns))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` most similar vectors; the query's length must be the vectors'."""
    score = cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, score.alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(k)


#: Vectors in a block; a task holds two blocks, and at most ``SLICE_SCORES`` scores of some rows of one with all of the other.
BLOCK_ROWS = 16_384
SLICE_SCORES = 1 << 20
#: Pairs that are scored to the last digit at a time.
EXACT_PAIRS = 250_000


def _vectors(df: DataFrame, key: str, name: str, column: str, block: str, block_rows: int) -> tuple[DataFrame, int]:
    """(rows (block, name, v) without null vectors, null components as 0; number of blocks); small tables have smaller blocks, so that they spread."""
    kind = "float" if df.schema[column].dataType.elementType.simpleString() == "float" else "double"
    v = F.transform(column, lambda x: F.coalesce(x.cast(kind), F.lit(0.0).cast(kind)))
    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias(name), v.alias("v"))
    count = rows.count()
    n = max(1, -(-count // min(block_rows, max(BLOCK_ROWS // 64, count // 8))))
    return rows.withColumn(block, F.pmod(F.xxhash64(name), F.lit(n)).cast("int")), n


def _block_pairs(left: DataFrame, right: DataFrame, lefts: str, rights: str) -> DataFrame:
    """(i, j, lefts, rights, v): rows of both sides by pair of blocks; of ``lefts`` and ``rights`` one is null."""
    kind = lambda df, n: df.schema[n].dataType.simpleString()
    one = left.select("i", "j", lefts, F.lit(None).cast(kind(right, rights)).alias(rights), "v")
    return one.unionByName(right.select("i", "j", F.lit(None).cast(kind(left, lefts)).alias(lefts), rights, "v"))


def _slice_rows(others: int) -> int:
    """Rows that are scored at a time with ``others`` vectors."""
    return max(1, SLICE_SCORES // max(1, others))


def _held(batches: Iterator[pa.RecordBatch], lefts: str, rights: str) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """(keys, vectors) of both sides of a pair of blocks, in order of key; shorter vectors end in zeros."""
    t = pa.Table.from_batches(list(batches))
    sides = []
    for name, other in ((lefts, rights), (rights, lefts)):
        own = t.filter(pc.is_null(t.column(other))).sort_by(name)
        sides.append((own.column(name).combine_chunks(), own.column("v").combine_chunks()))
    wide = max([0, *(int(pc.max(pc.list_value_length(v)).as_py() or 0) for _, v in sides)])
    out = []
    for keys, v in sides:
        size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        m = np.zeros((len(size), wide))
        m[np.arange(wide) < size[:, None]] = pc.list_flatten(v).to_numpy(zero_copy_only=False)
        out += [keys, m]
    return tuple(out)


def _best(asked: pa.Array, a: np.ndarray, held: pa.Array, b: np.ndarray, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(query_id, _key, score): of each query of ``a`` the ``k`` most similar vectors of ``b``, ties by place."""
    norms = np.linalg.norm(b, axis=1)
    size = _slice_rows(len(b))
    for at in range(0, len(a) if len(b) else 0, size):
        some = a[at : at + size]
        both = np.outer(np.linalg.norm(some, axis=1), norms)
        score = np.divide(some @ b.T, both, out=np.zeros_like(both), where=both > 0)
        shown = np.round(score, 9, out=both)
        least = np.partition(shown, len(b) - min(k, len(b)), axis=1)[:, len(b) - min(k, len(b))]
        rows, cols = np.nonzero(shown >= least[:, None])
        order = np.lexsort((cols, -shown[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        fine = (place < k) & (score[rows, cols] >= threshold)
        rows, cols = rows[fine], cols[fine]
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(rows + at)), held.take(pa.array(cols)), pa.array(score[rows, cols])], ["query_id", "_key", "score"])


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, key: str = "vec_id", column: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, key, rank, score): of each query the ``k`` most similar vectors, ties (to 9 digits) by key.

    Blocks of queries meet blocks of vectors, a pair of blocks in a task, which scores some queries at a time and hands on ``k`` rows of each.  Null
    vectors are left out, null components count as 0, zero vectors are at 0 from all; all vectors have one length.
    """
    c = F.col
    ship(vectors.sparkSession)
    q, nq = _vectors(queries, key, "query_id", column, "i", block_rows)
    v, nv = _vectors(vectors, key, "_key", column, "j", block_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = _block_pairs(q.withColumn("j", every(nv)), v.withColumn("i", every(nq)), "query_id", "_key")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _best(*_held(batches, "query_id", "_key"), k, threshold)

    kinds = [df.schema[n].dataType.simpleString() for df, n in ((q, "query_id"), (v, "_key"))]

    found = met.groupBy("i", "j").applyInArrow(best, f"query_id {kinds[0]}, _key {kinds[1]}, score double").withColumnRenamed("_key", key)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return found.withColumn("rank", rank).where(c("rank") <= k).select("query_id", key, "rank", "score")


def similar_pairs(vectors: DataFrame, threshold: float = 0.85, connected: DataFrame | None = None, key: str = "vec_id", column: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity): exact pairs at or above the threshold.

    Blocks of vectors meet, a pair of blocks in a task.  A product in single precision leaves out what is further below the
    threshold than it can err; the others are scored in double precision, term after term, and handed on some at a time.
    Null vectors are left out, null components count as 0; zero vectors are similar to none.
    """
    ship(vectors.sparkSession)
    rows, n = _vectors(vectors, key, "a", column, "at", block_rows)
    first = rows.withColumns({"i": F.col("at"), "j": F.explode(F.sequence(F.col("at"), F.lit(n - 1)))})
    second = rows.withColumnRenamed("a", "b").withColumns({"j": F.col("at"), "i": F.explode(F.sequence(F.lit(0), F.col("at")))})
    kind = rows.schema["a"].dataType.simpleString()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, x, rights, y = _held(batches, "a", "b")
        norms = []
        for m in (x, y):
            squares = np.zeros(len(m))
            for d in range(m.shape[1]):
                squares += m[:, d] * m[:, d]
            norms.append(np.sqrt(squares))
        with np.errstate(invalid="ignore", divide="ignore"):
            u, v = ((m / s[:, None]).astype(np.float32) for m, s in zip((x, y), norms))
        lowest = threshold - (x.shape[1] + 8) * 2.0**-23
        some = norms[1] != 0
        size = _slice_rows(len(y))
        for at in range(0, len(x), size):
            with np.errstate(invalid="ignore"):
                r, c = np.nonzero(~(u[at : at + size] @ v.T < lowest) & some & (norms[0][at : at + size] != 0)[:, None])
            for part in range(0, len(r), EXACT_PAIRS):
                p, q = r[part : part + EXACT_PAIRS] + at, c[part : part + EXACT_PAIRS]
                dot = np.zeros(len(p))
                with np.errstate(invalid="ignore"):
                    for d in range(x.shape[1]):
                        dot += x[p, d] * y[q, d]
                    value = dot / (norms[0][p] * norms[1][q])
                    fine = ~(value < threshold)
                yield pa.RecordBatch.from_arrays([lefts.take(pa.array(p[fine])), rights.take(pa.array(q[fine])), pa.array(value[fine])], ["a", "b", "similarity"])

    found = _block_pairs(first, second, "a", "b").groupBy("i", "j").applyInArrow(close, f"a {kind}, b {kind}, similarity double")
    # within a block each pair is met from both sides
    inside = F.pmod(F.xxhash64("a"), F.lit(n)) == F.pmod(F.xxhash64("b"), F.lit(n))
    pairs = found.where(F.when(inside, F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    if connected is not None:
        pairs = pairs.join(connected.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), ["a", "b"], "left_anti")
    return pairs.withColumn("similarity", F.round("similarity", 4))


def disambiguate(profiles: DataFrame, mentions: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(mention, id, score): the candidate whose profile has the greatest Jaccard with the mention's text.

    ``profiles`` (id, profile), ``mentions`` (mention, text, candidates array<string>).
    A single candidate scores 1; an empty text takes the first at 0; below the threshold the id is null.
    """
    c = mentions.select("mention", T.context_tokens(F.col("text")).alias("ts"), F.size("candidates").alias("n"), F.posexplode("candidates").alias("place", "id"))
    j = c.join(profiles.select("id", T.context_tokens(F.col("profile")).alias("ps")), "id", "left")
    ps = F.coalesce("ps", F.array().cast("array<string>"))
    union = F.size(F.array_union("ts", ps))
    score = F.when(F.col("n") == 1, 1.0).when(F.size("ts") == 0, 0.0).otherwise(F.coalesce(F.size(F.array_intersect("ts", ps)) / F.nullif(union, F.lit(0)), F.lit(0.0)))
    best = j.withColumn("score", score).groupBy("mention", "n", (F.size("ts") == 0).alias("empty")).agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "id")).alias("x"))
    s = -F.col("x.s")
    return best.select("mention", F.when((F.col("n") == 1) | F.col("empty") | (s >= threshold), F.col("x.id")).alias("id"), s.alias("score"))


def viewer_search(nodes: DataFrame, query: str, limit: int = 8, types: tuple[str, ...] = ()) -> DataFrame:
    """Best of label and 0.95 of an alias, 0.35 if only id, type or url holds the query; above 0.2, best first."""
    q = query.lower().strip()
    alias = F.aggregate(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: 0.95 * T.fuzzy_score(q, a)), F.lit(0.0), lambda m, x: F.greatest(m, x))
    hay = F.when(F.lower(F.concat_ws(" ", "id", "type", "url")).contains(q), 0.35).otherwise(0.0)
    scored = nodes.select("id", "label", "type", F.greatest(T.fuzzy_score(q, F.col("label")), alias, hay).alias("score")).where("score > 0.2")
    if types:
        scored = scored.where(F.col("type").isin(*types))
    return scored.orderBy(F.desc("score"), "label", "id").limit(limit)
