"""URL filter (operator 3): blocked Bloom filter, exact hash join, longest-prefix rules.

A page is blocked when its host, or a parent domain of it, is listed as
``domain/``, or when its canonical URL is listed.  Each page offers these keys;
a blocked Bloom filter of the list (one 64-bit word in each of four lanes per
block, so a key is tested in one block) passes possible hits, and an exact hash
join with the list removes false positives.  Rules (host suffix and path prefix)
come first; of those that fit, the longest decides.

Only DataFrame functions are used.  The filter is an array of blocks in one row
of a bounded size (8 MB at most), which is broadcast; the list itself never is by this
module.  Only the few keys that pass the filter are shuffled: first thinned to
distinct keys for the exact join, then with their page, dealt over salts against
hot hosts.

Defined results: null URLs, and URLs without ``://``, have an empty host and path,
fit no rule and are allowed; repeated URLs and repeated or null page ids keep a
row each; an empty list blocks nothing; an empty table gives no rows; further
columns of the input are not handed on, so clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path) of the rules in the order of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Production list of canonical URLs; ``domain/`` lists a domain with all its subdomains.
LISTED = ("ads-track.example.org/", "casino-win.example.org/", "cheap-pills.example.com/", "free-bets.example.com/", "spam-farm.example.org/")

#: A list entry is dealt over this many tasks, so pages of one host are not joined in one.
SALTS = 32
MOST_BLOCKS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; of equal lengths the last in text order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=False):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` and path without a trailing slash; scheme, query and fragment are dropped."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def keys_of(host: Column, path: Column) -> Column:
    """What a page can be listed by: the canonical URL, and ``domain/`` for the host and each parent domain."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")),
    )
    return F.array_distinct(F.concat(F.array(canonical(host, path)), domains))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number, and the word of each of four lanes with one bit set."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    block = F.pmod(h, F.lit(blocks)).cast("int")
    return block, [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(g, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def bloom_filter(listed: DataFrame, blocks: int = 1 << 14, key: str = "url") -> DataFrame:
    """One row with ``words``: four 64-bit words for each of ``blocks`` blocks (512 kB by default)."""
    block, lanes = _bits(F.col(key), blocks)
    words = (
        listed.where(F.col(key).isNotNull())
        .select(block.alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(lanes)])
        .groupBy("block")
        .agg(*[F.expr(f"bit_or(w{k})").alias(f"w{k}") for k in range(4)])
    )
    spark = listed.sparkSession
    # a dense array: each block that is set, in its place, between zeros
    filled = (
        spark.range(0, blocks, 1, 1)
        .select(F.col("id").cast("int").alias("block"))
        .join(words, "block", "left")
        .agg(F.sort_array(F.collect_list(F.struct("block", *[F.coalesce(F.col(f"w{k}"), F.lit(0).cast("bigint")).alias(f"w{k}") for k in range(4)]))).alias("b"))
    )
    return filled.select(*[F.col(f"b.w{k}").alias(f"w{k}") for k in range(4)])


def may_be_listed(key: Column, blocks: int = 1 << 14) -> Column:
    """Whether the filter of one row, joined as w0 .. w3, lets a key pass."""
    block, lanes = _bits(key, blocks)
    out = F.lit(True)
    for k, bit in enumerate(lanes):
        out = out & (F.get(F.col(f"w{k}"), block).bitwiseAND(bit) == bit)
    return out


def blocks_for(entries: int) -> int:
    """A power of two with 32 bits an entry; at most ``MOST_BLOCKS``, beyond which more keys pass on to the exact join."""
    return min(MOST_BLOCKS, 1 << max(10, math.ceil(entries / 8 - 1).bit_length()))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None, url: str = "url", key: str = "page_id", listed_url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, listed) for every page; ``listed`` is the matching entry of the list, else null.

    Where ``key`` is called like one of the other columns, it has an underscore in front.
    """
    entries = listed.select(F.col(listed_url).alias("_entry")).where(F.col("_entry").isNotNull()).distinct()
    entries, _ = materialize(entries, "list")
    blocks = blocks or blocks_for(entries.count())
    read = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    parts = read.select("_key", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    filter_row, _ = materialize(bloom_filter(entries, blocks, "_entry").withColumn("_one", F.lit(1)), "bloom")
    tested = parts.withColumn("_one", F.lit(1)).join(F.broadcast(filter_row), "_one").select(  # one row, of 32 bytes a block
        "_key",
        "host",
        "path",
        rule_of(F.col("host"), F.col("path"), rules).alias("_rule"),
        F.when(F.col("host") != "", F.filter(keys_of(F.col("host"), F.col("path")), lambda k: may_be_listed(k, blocks))).alias("_maybe"),
        F.struct(F.spark_partition_id(), F.monotonically_increasing_id()).alias("_row"),
    )
    tested, _ = materialize(tested, "tested")
    possible = tested.where(F.size("_maybe") > 0).select("_row", F.explode("_maybe").alias("_entry"))
    # the exact join sees each possible key once; what it confirms is part of the list
    hits, _ = materialize(possible.select("_entry").distinct().join(entries, "_entry", "left_semi"), "listed")
    dealt = hits.select("_entry", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    named = possible.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(dealt, ["_entry", "_salt"]).groupBy("_row").agg(F.min("_entry").alias("listed"))
    marked = tested.join(named, "_row", "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    name = f"_{key}" if key in ("host", "path", "rule", "verdict", "listed") else key
    return marked.select(F.col("_key").alias(name), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in LISTED], "url string")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), listed(url) AS (
  VALUES ('ads-track.example.org/'), ('casino-win.example.org/'), ('cheap-pills.example.com/'), ('free-bets.example.com/'), ('spam-farm.example.org/')
), ruled AS (
  SELECT parts.*, (SELECT max(lpad(CAST(length(h || p) AS VARCHAR), 6, '0') || verdict || ' ' || h || p) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
    (SELECT min(url) FROM listed WHERE host <> '' AND (ends_with('.' || host || '/', '.' || url)
      OR url = regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', ''))) AS listed
  FROM parts
)
SELECT page_id, host, path, substr(best, 13) AS rule,
  coalesce(substr(best, 7, 5), CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
FROM ruled
"""
