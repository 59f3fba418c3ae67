"""Vector code compression: codebooks by Yinyang Lloyd (operator 13).

Vectors become integers and are cut into equal parts; each part position has a codebook,
trained by Lloyd rounds in exact integer arithmetic.  The entries of a codebook are
clustered into groups once.  Of each part the state keeps its entry, an upper bound
of the distance to it and one lower bound for each group of the distances to the
group's other entries.  When entries have moved, bounds change by the drift; only groups
whose bound no longer lies above the upper bound are scanned, and what is scanned is
compared by squared integer distances and then by index, so ties are exact.  Bounds are
floating-point numbers, rounded outwards.

In each round a map over the vectors writes the new state as a table of the shared
folder; sums and counts by entry come from that table, combined within tasks.  Only
codebooks (16 entries for each part position) pass the driver.

Defined results: a vector that is null, or holds null, a non-finite component or one
of 2 ** 41 or more, is left out; so is one of another length than that of the
kept vector with the least id whose length is a multiple of the number of parts.
Of rows with one id the least vector is the codebook's; rows with a null id are coded but
never start a codebook; without any id there are no codebooks and no rows.  With fewer
vectors than entries the codebooks are shorter.  An error beyond a long is null.
Repeated rows keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, ship

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 8, 16, 6, 4, 4096
#: Components below this keep all squared distances within 64 bits (parts of up to 256 components); others take Python's integers.
SMALL = 1 << 26
MOST = float(1 << 41)
STEP = 8192


@dataclass
class Codebooks:
    """``entries``[part] is a list of integer tuples, ``groups``[part] the group of each entry."""

    entries: list[list[tuple[int, ...]]]
    groups: list[np.ndarray]
    drift: list[np.ndarray] | None = None

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def grouped(book: list[tuple[int, ...]], groups: int = GROUPS, sweeps: int = 5) -> np.ndarray:
    """A group for each entry: a few Lloyd sweeps over the entries themselves, from evenly spaced ones."""
    x = np.array(book, np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)].copy()
    for _ in range(sweeps):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(len(centres)):
            if (label == g).any():
                centres[g] = x[label == g].mean(0)
    return label


def _exact(v: np.ndarray, book: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """``v`` and the entries with a type in which squared distances are exact."""
    c = np.array(book, dtype=object)
    most = max(int(np.abs(v).max(initial=0)), max(abs(int(x)) for e in book for x in e))
    return (v.astype(np.int64), c.astype(np.int64)) if most < SMALL else (v.astype(object), c)


def _squared(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = v - entries
    return (d * d).sum(-1)


def _up(x):
    return np.nextafter(np.float32(1) * np.sqrt(np.asarray(x, np.float64)) * (1 + 1e-6), np.float32(np.inf)).astype(np.float32)


def _down(x):
    return (np.sqrt(np.asarray(x, np.float64)) * (1 - 1e-6)).astype(np.float32)


def assign(v: np.ndarray, book: list[tuple[int, ...]], group: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, scanned) of the parts ``v`` at one position; ``state`` is what the last round gave.

    ``lower`` has a column for each group and bounds the distances to its entries other than the part's own;
    ``scanned`` counts distances to entries of groups.
    """
    v, entries = _exact(v, book)
    n, kinds = len(v), int(group.max()) + 1
    scanned = 0
    if state is None:
        own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros((n, kinds), np.float32)
        best = None
        failed = np.ones((n, kinds), bool)
        look = np.arange(n)
    else:
        own, upper, lower = state[0].astype(np.int64), state[1].copy(), state[2].copy()
        move = np.array([drift[group == g].max(initial=0) for g in range(kinds)])
        upper = ((upper.astype(np.float64) + drift[own]) * (1 + 1e-6) + 1e-6).astype(np.float32)
        lower = np.maximum((lower.astype(np.float64) - move[None]) * (1 - 1e-6) - 1e-6, 0).astype(np.float32)
        look = np.flatnonzero((lower <= upper[:, None]).any(1))
        exact = _squared(v[look], entries[own[look]])  # the bound is tightened before groups are looked at
        upper[look] = _up(exact.astype(np.float64))
        failed = lower[look] <= upper[look][:, None]
        keep = failed.any(1)
        look, failed, best = look[keep], failed[keep], exact[keep]
    if len(look):
        first = state is None
        chosen = own[look].copy()
        lowest = lower[look].copy()
        before = chosen.copy()
        second = np.full((len(look), kinds), np.inf)
        if first:
            best = np.full(len(look), -1, dtype=v.dtype)
        at_best = best.copy()
        dists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in range(kinds):
            rows, members = np.flatnonzero(failed[:, g]), np.flatnonzero(group == g)
            if not len(rows) or not len(members):
                continue
            d = _squared(v[look[rows]][:, None], entries[members][None])
            scanned += d.size
            dists[g] = (rows, d)
            for j, m in enumerate(members.tolist()):
                x = d[:, j]
                better = (x < at_best[rows]) | ((x == at_best[rows]) & (m < chosen[rows])) | (at_best[rows] < 0)
                chosen[rows[better]], at_best[rows[better]] = m, x[better]
        for g, (rows, d) in dists.items():  # the nearest of a scanned group other than the part's own entry
            members = np.flatnonzero(group == g)
            far = np.where(members[None] == chosen[rows][:, None], np.inf, d.astype(np.float64))
            second[rows, g] = far.min(1)
            lowest[rows, g] = _down(np.minimum(second[rows, g], 1e60))
        if not first:  # the entry that a part has left bounds its group, which may not have been scanned
            left = np.flatnonzero(chosen != before)
            g = group[before[left]]
            lowest[left, g] = np.minimum(lowest[left, g], _down(best[left].astype(np.float64)))
        own[look], lower[look], upper[look] = chosen, lowest, _up(at_best.astype(np.float64))
    return own, upper, lower, scanned


def _kept(vectors: DataFrame, key: str, column: str, label: str) -> DataFrame:
    x = F.col(column)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < MOST))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    return vectors.where(x.isNotNull() & fine).select(F.col(key).alias("_id"), F.col(label).alias("_label"), v.alias("v"))


def first_entries(kept: DataFrame, parts: int, entries: int) -> list[list[int]]:
    """The vectors of the least ids, of one length."""
    able = kept.where(F.col("_id").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0))
    least = able.select("_id", F.size("v").alias("n"), "v").orderBy("_id", "v").limit(1).collect()
    if not least:
        return []
    same = able.where(F.size("v") == least[0]["n"])
    ids = same.select("_id").distinct().orderBy("_id").limit(entries)
    return [list(r["v"]) for r in same.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("v").alias("v")).orderBy("_id").collect()]


def _pass(books: Codebooks, dim: int, first: bool, last: bool):
    """A map over the state (_row, v, own, upper, lower)."""
    width, parts, kinds = dim // len(books.entries), len(books.entries), [int(g.max()) + 1 for g in books.groups]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                n = b.num_rows
                v = b.column("v").flatten().to_numpy().reshape(n, parts, width)
                if not first:
                    own = np.frombuffer(b"".join(b.column("own").to_pylist()), np.uint8).reshape(n, parts)
                    upper = np.frombuffer(b"".join(b.column("upper").to_pylist()), np.float32).reshape(n, parts)
                    lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float32).reshape(n, sum(kinds))
                found, ends = [], np.append(0, np.cumsum(kinds))
                for p, book in enumerate(books.entries):
                    state = None if first else (own[:, p], upper[:, p], lower[:, ends[p] : ends[p + 1]])
                    found.append(assign(v[:, p], book, books.groups[p], state, None if first else books.drift[p]))
                code = np.stack([f[0] for f in found], 1).astype(np.uint8)
                if last:
                    error = sum(_squared(*_gathered(v[:, p], book, code[:, p])).astype(object) for p, book in enumerate(books.entries))
                    long = [int(e) if e < 1 << 63 else None for e in error]
                    out = [b.column("_id"), b.column("_label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(long, pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, ["_id", "_label", "code", "error"])
                    continue
                packed = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (code, np.stack([f[1] for f in found], 1), np.concatenate([f[2] for f in found], 1))]
                scanned = np.zeros(n, np.int64)
                scanned[0] = sum(f[3] for f in found)
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), b.column("v"), *packed, pa.array(scanned)], ["_id", "_label", "v", "own", "upper", "lower", "scanned"])

    return rows


def _gathered(v: np.ndarray, book: list[tuple[int, ...]], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v, entries = _exact(v, book)
    return v, entries[own]


def _sums(state: DataFrame, parts: int, dim: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(count, sums of components) by (part, entry): 16 rows for each component from a task, and as many in the driver."""
    width = dim // parts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, 256), np.int64), np.zeros((parts, 256, width), object)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column("v").flatten().to_numpy().reshape(n, parts, width)
            own = np.frombuffer(b"".join(b.column("own").to_pylist()), np.uint8).reshape(n, parts)
            for p in range(parts):
                count[p] += np.bincount(own[:, p], minlength=256)
                order = np.argsort(own[:, p], kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(own[order, p].astype(int)) != 0))
                total[p, own[order, p][heads]] += np.add.reduceat(v[order, p], heads, axis=0).astype(object)
        at = np.argwhere(count)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at[:, 0], width)), pa.array(np.repeat(at[:, 1], width)), pa.array(np.tile(np.arange(width), len(at))), pa.array(np.repeat(count[tuple(at.T)], width)), pa.array([str(x) for p, e in at for x in total[p, e]], pa.string())], ["part", "entry", "place", "n", "total"])

    partial = state.select("v", "own").mapInArrow(rows, "part long, entry long, place long, n long, total string")
    summed = partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(summed.collect(), key=lambda r: (r["part"], r["entry"], r["place"])):
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["total"]))
    return out


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[Codebooks, DataFrame, int] | None:
    """(codebooks, last state, distances computed) over ``kept`` (_id, _label, v); None without a vector to start from.

    Intermediate tables belong to the caller's ``Scratch`` block.
    """
    start = first_entries(kept, parts, entries)
    if not start:
        return None
    dim, width = len(start[0]), len(start[0]) // parts
    books = [[tuple(x[p * width : (p + 1) * width]) for x in start] for p in range(parts)]
    found = Codebooks(books, [grouped(b, groups) for b in books])
    state, scanned = kept.where(F.size("v") == dim), 0
    schema = f"_id {kept.schema['_id'].dataType.simpleString()}, _label {kept.schema['_label'].dataType.simpleString()}, v array<long>, own binary, upper binary, lower binary, scanned long"
    for n in range(rounds):
        state, _ = materialize(state.mapInArrow(_pass(found, dim, n == 0, False), schema), "codes")
        scanned += state.agg(F.sum("scanned")).first()[0] or 0
        sums = _sums(state, parts, dim)
        moved = [list(book) for book in found.entries]
        for (p, e), (count, total) in sums.items():
            moved[p][e] = tuple(x // count for x in total)
        drift = [np.array([float(_up(float(sum((a - b) ** 2 for a, b in zip(x, y))))) if x != y else 0.0 for x, y in zip(old, new)]) for old, new in zip(found.entries, moved)]
        found = Codebooks(moved, found.groups, drift)
    return found, state, scanned


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for each kept row."""
    spark = vectors.sparkSession
    ship(spark)
    kept = _kept(vectors, key, column, label)
    kinds = f"_id {kept.schema['_id'].dataType.simpleString()}, _label {kept.schema['_label'].dataType.simpleString()}, code string, error long"
    with Scratch(spark):
        trained = train(kept, parts, entries, rounds)
        if trained is None:
            return spark.createDataFrame([], kinds + ", label_error long, codebooks_sha256 string").select(F.col("_id").alias(key), "code", "error", "label_error", "codebooks_sha256")
        books, state, _ = trained
        final = _pass(books, len(books.entries) * len(books.entries[0][0]), rounds == 0, True)
        coded, _ = materialize(state.mapInArrow(final, kinds), "codes", keep=True)
    by_label = coded.groupBy(F.col("_label").alias("_of")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"cut AS (SELECT r, vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS (SELECT p, e - 1 AS e, x AS y FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM cut) WHERE e <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED (SELECT c.r, c.p, min((list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS best FROM cut c JOIN book{i} b ON b.p = c.p GROUP BY c.r, c.p)")
        if i < rounds:
            steps.append(
                f"""sums{i} AS (SELECT p, e, k, sum(x) AS s, count(*) AS n FROM (SELECT n.p, CAST(n.best[2] AS BIGINT) AS e, unnest(range(len(c.x))) AS k, unnest(c.x) AS x FROM near{i} n JOIN cut c ON c.r = n.r AND c.p = n.p) GROUP BY p, e, k),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM book{i} b LEFT JOIN (SELECT p, e, list(CAST({floor} AS BIGINT) ORDER BY k) AS y FROM sums{i} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
            )
    last = f"near{rounds}"
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
codes AS (SELECT r, string_agg(printf('%02x', CAST(best[2] AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM {last} GROUP BY r)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept k JOIN codes c USING (r), digest"""
    )


ORACLE_SQL = _oracle()
