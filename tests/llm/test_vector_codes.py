"""Codebooks by Yinyang Lloyd: plain Lloyd in Python's integers, ties, bounds, odd inputs."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from lattica.llm import vector_codes
from lattica.llm.common import Scratch


def by_force(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label); ids are distinct."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    starts = sorted(k for k in kept if k[0] is not None)[:entries]
    books = [[cut(v, p) for _, v, _ in starts] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [[] for _ in book]
            for _, v, _ in kept:
                mine[near(cut(v, p), book)].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(m) for c in zip(*m)) if m else e for m, e in zip(mine, book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, lab in kept:
        own = [near(cut(v, p), b) for p, b in enumerate(books)]
        error = sum(far(cut(v, p), b[e]) for p, (b, e) in enumerate(zip(books, own)))
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in own), error, lab))
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return sorted((tuple(r) for r in vector_codes.codes(df, **more).collect()), key=str)


def test_codes_by_force(spark):
    rng = random.Random(3)
    smooth = [(i * 3 + 1, [rng.gauss(rng.choice([-1, 0, 1]), 0.2) for _ in range(24)], rng.choice([None, 1, 2])) for i in range(300)]
    assert found(spark, smooth) == by_force(smooth)
    # few values, so that ties are everywhere, and entries that no part chooses
    tied = [(i, [rng.choice([0.0, 0.0, 1.0, -0.5]) / 4096 for _ in range(16)], 1) for i in range(200)]
    assert found(spark, tied) == by_force(tied)


def test_bounds_save_distances(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(c, 0.05) for c in (rng.choice([(0, 0), (3, 0), (0, 3), (5, 5)]) * 4)], None) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with Scratch(spark):
        kept = vector_codes._kept(df, "vec_id", "embedding", "label")
        _, _, scanned = vector_codes.train(kept)
    assert scanned < 0.6 * 6 * 2000 * 8 * 16


def test_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [0.1 * k for k in range(8)], 1), (3, [1e6 * k for k in range(8)], 1), (4, [-1e6] * 8, None), (None, [0.5] * 8, None), (5, None, 1), (6, [nan] * 8, 1), (7, [inf] * 8, 1), (8, [None] + [0.0] * 7, 1)]
    assert found(spark, rows) == by_force(rows)
    # other lengths, an empty vector and one beyond the range are left out; an error beyond a long is null
    more = [*rows, (1, [], 1), (10, [1.0] * 9, 1), (11, [1e13] * 8, 1)]
    assert found(spark, more) == by_force(rows)
    huge = [(1, [0.0] * 8, 1), (2, [1e12] + [0.0] * 7, 1), (3, [5e11] + [0.0] * 7, 1)]
    assert [r[2] for r in found(spark, huge, entries=1)] == [None, None, 0]  # the mean is the third
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert vector_codes.codes(df.limit(0)).count() == 0 and vector_codes.codes(df.where("vec_id is null")).count() == 0
    twice = df.where("vec_id = 9").union(df.where("vec_id = 9")).withColumns({"code": F.lit("x"), "v": F.lit(1), "own": F.lit(2)})
    assert vector_codes.codes(twice).count() == 2
