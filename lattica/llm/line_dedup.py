"""Line dedup (operator 1): suffix array over line ids by distributed prefix doubling.

Documents are sequences of line ids, laid end to end in order of (key, text
hash).  A suffix is the rest of a document from one line on.  Prefix doubling
ranks suffixes by their first 1, 2, 4, ... lines: a round pairs the rank of a
suffix with the rank of the suffix ``span`` lines further on, sorts the distinct
pairs over range partitions and numbers them in order.  Suffixes that share a
rank form an LCP interval of the suffix array: all of them agree in at least
``span`` lines.  Intervals of one suffix end the search there, so each round
carries on only what still repeats.

In an interval the suffix that comes first in the corpus is the original; the
``span`` lines at each later one are a copy.  A maximal repeated run is the union
of the intervals found at its lines, so deleting these copies deletes every
later copy of every maximal run of ``min_lines`` lines or more, and nothing else.
With ``min_words``, later copies of single lines of more words than that go too,
from the ranks by one line.

Only DataFrame functions are used.  Groups are never collected: an interval is an
aggregate (count, least position), which combines before the shuffle, and the
join back to positions is one that adaptive execution splits where a line is very
frequent.  Lineage is cut with tables in the shared folder in each round.

Defined results: null text stays null and has no lines; empty text is one empty
line; rows equal in key and text are one document, and all of them get its
result; null keys come first in order; an empty table gives no rows; further
columns are kept untouched by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, materialize

MIN_LINES = 2


def _identity(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _wide(line: Column, min_words: int) -> Column:
    return (F.length(line) > 2 * min_words) & (F.size(F.split(F.trim(line), r"\s+")) > min_words)


def line_positions(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, documents): (seq, base, rest, a, b) by line, with two hashes of it, and (key, th, base) by document.

    ``seq`` numbers lines in corpus order, consecutive within a document; ``base``
    is the number of the document's first line; ``rest`` lines follow in it.  With
    ``min_words``, ``wide`` tells whether the line has more words.
    """
    wide = (lambda x: [_wide(x, min_words).alias("wide")]) if min_words is not None else (lambda x: [])
    hashed = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("_key"),
        _identity(text).alias("th"),
        F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b"), *wide(x))).alias("ids"),
    )
    ids, _ = materialize(hashed, "lineids")
    # equal rows meet in one range, so making them distinct there needs no further shuffle
    flat = ids.repartitionByRange(F.col("_key"), F.col("th")).dropDuplicates(["_key", "th"]).sortWithinPartitions("_key", "th")
    lines = flat.select("_key", "th", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "id")).withColumn("seq", F.monotonically_increasing_id())
    table = lines.select("_key", "th", "seq", (F.col("seq") - F.col("pos")).alias("base"), (F.col("n") - 1 - F.col("pos")).alias("rest"), F.col("id.a").alias("a"), F.col("id.b").alias("b"), *([F.col("id.wide").alias("wide")] if min_words is not None else []))
    lines, _ = materialize(table, "lines")
    return lines.drop("_key", "th"), lines.where("seq = base").select("_key", "th", "base")


def _refine(suffixes: DataFrame) -> tuple[DataFrame, bool]:
    """Rank suffixes by the pair (a, b), in its order; suffixes with a pair of their own are done."""
    pairs, _ = materialize(suffixes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).where("n > 1").drop("n"), "intervals")
    if pairs.isEmpty():
        return suffixes, False
    ranked = pairs.repartitionByRange(F.col("a"), F.col("b")).sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())
    ranked, _ = materialize(ranked, "ranks")
    kept = suffixes.join(ranked, ["a", "b"]).drop("a", "b")
    kept, _ = materialize(kept, "suffixes")
    return kept, True


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", key: str = "doc_id", min_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, documents): lines ``seq`` up to ``reach`` repeat those from ``first`` on, by position and span."""
    suffixes, documents = line_positions(docs, text, key, min_words)
    span = 1
    found: list[DataFrame] = []
    repeated: DataFrame | None = None
    suffixes, more = _refine(suffixes)
    if more and min_words is not None and span < min_lines:
        found.append(suffixes.where("wide and first < seq").select("seq", "base", (F.col("seq") + span).alias("reach"), "first"))
    while more:
        repeated = suffixes if repeated is None else repeated
        if span >= min_lines:
            found.append(suffixes.where("first < seq").select("seq", "base", (F.col("seq") + span).alias("reach"), "first"))
        step = span if span >= min_lines else min(span, min_lines - span)
        ahead = W.partitionBy("base").orderBy("seq").rangeBetween(step, step)
        paired = suffixes.where(F.col("rest") >= 0).select("seq", "base", "rest", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b"))
        suffixes, more = _refine(paired.where(F.col("b").isNotNull()))
        span += step
    spark = docs.sparkSession
    copies = spark.createDataFrame([], "seq long, base long, reach long, first long")
    for f in found:
        copies = copies.unionByName(f)
    if repeated is not None and found:
        copies = copies.unionByName(repeated.select("seq", "base", F.lit(-1).cast("long").alias("reach"), F.lit(None).cast("long").alias("first")))
    return copies, documents


def dropped_lines(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", key: str = "doc_id", min_words: int | None = None) -> DataFrame:
    """(_key, th, dropped array<int>): numbers of the lines to delete, by document that has any."""
    copies, documents = repeated_runs(docs, min_lines, text, key, min_words)
    reach = F.max("reach").over(W.partitionBy("base").orderBy("seq").rangeBetween(W.unboundedPreceding, W.currentRow))
    lines = copies.select("seq", "base", reach.alias("reach")).where(F.col("reach") > F.col("seq"))
    by_doc = lines.groupBy("base").agg(F.collect_set((F.col("seq") - F.col("base")).cast("int")).alias("dropped"))
    return documents.join(by_doc, "base").select("_key", "th", "dropped")


def drop_copies(docs: DataFrame, min_lines: int = MIN_LINES, text: str = "text", key: str = "doc_id", counts: bool = False, min_words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with later copies of repeated line runs deleted from ``text``.

    With ``min_words``, later copies of single lines of more words than that are deleted as well.
    With ``counts``, a struct ``_lines`` (n_lines, n_dropped) stands beside.
    """
    with Scratch(docs.sparkSession):
        drops, _ = materialize(dropped_lines(docs, min_lines, text, key, min_words), "dropped", keep=True)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_id"), F.col(text).alias("_whole"))
    # by hash at every size: the list of deletions grows with the corpus, so it is not broadcast where it happens to be small
    joined = packed.withColumn("_th", _identity("_whole")).join(drops.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_th") == F.col("th")), "left")
    lines = F.split("_whole", "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    left = F.when(F.col("dropped").isNull(), F.col("_whole")).otherwise(
        F.array_join(F.transform(F.transform(F.array(lines), lambda ls: F.transform(numbers, lambda i: F.get(ls, i)))[0], lambda x: x), "\n")
    )
    out = joined.select("_row", left.alias("_left"), F.when(F.col("_whole").isNotNull(), F.size(lines)).otherwise(0).alias("_n"), F.coalesce(F.size("dropped"), F.lit(0)).alias("_d"))
    columns = [F.col("_left").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    extra = [F.struct(F.col("_n").cast("long").alias("n_lines"), F.greatest(F.col("_d"), F.lit(0)).cast("long").alias("n_dropped")).alias("_lines")] if counts else []
    return out.select(*columns, *extra)


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), pairs AS (
  SELECT doc_id, pos, line, lead(line) OVER d AS line2, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM lines
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), firsts AS (
  SELECT line, line2, min((doc_id, pos)) AS first FROM pairs WHERE line2 IS NOT NULL GROUP BY ALL
), copies AS (
  SELECT p.doc_id, p.pos FROM pairs p JOIN firsts f ON p.line = f.line AND p.line2 = f.line2 WHERE (p.doc_id, p.pos) > f.first
), dropped AS (
  SELECT doc_id, pos FROM copies UNION SELECT doc_id, pos + 1 FROM copies
)
SELECT p.doc_id, max(p.n_lines) AS n_lines, count(d.pos) AS n_dropped,
  md5(coalesce(string_agg(CASE WHEN d.pos IS NULL THEN p.line END, chr(10) ORDER BY p.pos), '')) AS text_md5
FROM pairs p LEFT JOIN dropped d ON p.doc_id = d.doc_id AND p.pos = d.pos
GROUP BY p.doc_id
"""
