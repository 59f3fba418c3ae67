"""Prefix trie of conversations: brute force, chains over many partitions, odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import prefix_trie, scans


@pytest.fixture
def uncoalesced(spark):
    """Small tables stay dealt over all partitions, so groups span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_force(rows):
    """The nodes of (conv_id, turn, role, text), turns of one conversation being distinct."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + v[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
        ends[tuple(whole[c])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = [tuple(r) for r in prefix_trie.trie(df).collect()]
    assert len(got) == len(set(got)) and set(got) == by_force(rows)


def test_trie_by_force(uncoalesced):
    rng = random.Random(1)
    rows = []
    for c in rng.sample(range(-45, 400), 150):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["", "a b", "a\tb  c", "ä é\nx"])))
    rows += [(7_000, t, "user", f"t {t}") for t in range(300)]  # one long conversation, and a copy that leaves it late
    rows += [(7_001, t, "user", f"t {t}" if t < 250 else f"other {t}") for t in range(300)]
    rows += [(c, 0, "user", "hello there") for c in range(20_000, 20_200)]
    check(uncoalesced, rows)


def test_trie_odd(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (2, None, "", ""), (2, 0, "user", ""), (None, 0, "user", "x"), (40, 5, "user", "y" * 100_000), (43, 1, "user", "z")]
    check(spark, rows)
    equal = spark.createDataFrame([(20, 1, "a", "x"), (20, 1, "a", "x"), (20, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(equal).count() == 4
    clash = equal.withColumns({"depth": F.lit("?"), "k1": F.lit(0), "place": F.lit(1)})
    assert prefix_trie.trie(clash).count() == 4
    assert prefix_trie.trie(equal.limit(0)).count() == 0
    assert prefix_trie.trie(equal.where("conv_id = 20").limit(1)).count() == 2


def test_scan_over_partitions(uncoalesced):
    rng = random.Random(2)
    rows = [(g, i, rng.randint(-(1 << 62), 1 << 62)) for g, n in ((-3, 1), (1, 500), (2, 2), (9, 300)) for i in range(n)]
    rng.shuffle(rows)
    df = uncoalesced.createDataFrame(rows, "g long, i long, x long").withColumns({"s": F.col("x"), "r1": F.col("x"), "r2": F.col("x")})
    got = {(r.g, r.i): r for r in scans.scan(df, ["g"], ["i"], sums=("s",), rolls=("r1", "r2")).collect()}
    assert len(got) == len(rows)
    wrap = (1 << 64) - 1
    state = {}
    for g, i, x in sorted(rows):
        s, r1, r2, place = state.get(g, (0, 0, 0, 0))
        state[g] = (s + x) & wrap, (r1 * int(scans.BASES[0]) + x) & wrap, (r2 * int(scans.BASES[1]) + x) & wrap, place + 1
        r = got[g, i]
        assert (r.s & wrap, r.r1 & wrap, r.r2 & wrap, r.place) == state[g]
