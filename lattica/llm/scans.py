"""Running values over sorted rows, whatever the length of a group.

Rows are sorted over range partitions, so a group may span any number of tasks.
Each task keeps a place, sums and rolling hashes of the group it is in; what a
group has gathered in earlier partitions is added when the table is read again.
One row for each partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Odd multipliers of the two lanes of rolling hashes.
BASES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def powers(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2 ** 64."""
    out, b, n = np.ones(len(n), np.uint64), np.uint64(base), n.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        while n.any():
            out = np.where(n & 1 == 1, out * b, out)
            b, n = b * b, n >> 1
    return out


def _rolling(values: np.ndarray, place: np.ndarray, starts: np.ndarray, base: np.uint64) -> np.ndarray:
    """h_i = h_{i-1} * base + values_i within each group, by doubling."""
    h, step = values.copy(), 1
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        while step < len(h) and (place - starts >= step).any():
            before = np.zeros(len(h), np.uint64)
            before[step:] = h[:-step]
            h = np.where(place - starts >= step, h + before * b, h)
            b, step = b * b, step * 2
    return h


def scan(df: DataFrame, group: list[str], by: list[Column | str], sums: tuple[str, ...] = (), rolls: tuple[str, ...] = (), label: str = "scan") -> DataFrame:
    """``df`` with ``place`` (from 1) in each group in the order ``by``, ``sums`` as running sums and ``rolls`` as rolling hashes.

    Group, sum and hash columns are longs without nulls; sums and hashes wrap modulo 2 ** 64.
    The result is a table of the shared folder.
    """
    names = df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    values = [*sums, *rolls]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, key, first = TaskContext.get().partitionId(), None, None, None
        held: pa.RecordBatch | None = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            keys = [b.column(c).to_numpy() for c in group]
            fresh = np.zeros(n, bool)
            for k in keys:
                fresh[1:] |= k[1:] != k[:-1]
            now = tuple(int(k[0]) for k in keys)
            first = first or now
            fresh[0] = True
            goes_on = carry is not None and now == key
            heads = np.flatnonzero(fresh)
            index = np.arange(n)
            starts = heads[np.cumsum(fresh) - 1]
            place = index - starts + 1
            cols = {}
            in_first = starts == 0
            with np.errstate(over="ignore"):
                for c in sums:
                    x = b.column(c).to_numpy().astype(np.int64).view(np.uint64)
                    total = np.cumsum(x, dtype=np.uint64)
                    x = total - (total[starts] - x[starts])
                    cols[c] = np.where(in_first, x + np.uint64(carry[c]), x) if goes_on else x
                for i, c in enumerate(rolls):
                    x = _rolling(b.column(c).to_numpy().astype(np.int64).view(np.uint64), index, starts, BASES[i % 2])
                    cols[c] = np.where(in_first, x + np.uint64(carry[c]) * powers(BASES[i % 2], place), x) if goes_on else x
            if goes_on:
                place = np.where(in_first, place + carry["place"], place)
            key = tuple(int(k[-1]) for k in keys)
            carry = {c: int(x[-1]) for c, x in cols.items()} | {"place": int(place[-1])}
            head = np.ones(n, bool)
            for k, f in zip(keys, first):
                head &= k == f
            last = np.zeros(n, bool)
            out = [pa.array(cols[c].view(np.int64)) if c in cols else b.column(c) for c in names]
            held = pa.RecordBatch.from_arrays([*out, pa.array(place), pa.array(np.full(n, part, np.int64)), pa.array(head), pa.array(last)], [*names, "place", "_part", "_head", "_last"])
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield held.set_column(held.num_columns - 1, "_last", pa.array(last))

    ordered = df.repartitionByRange(*group, *by).sortWithinPartitions(*group, *by)
    local, _ = materialize(ordered.mapInArrow(rows, kinds + ", place long, _part long, _head boolean, _last boolean"), label)
    ends = local.where("_last").select("_part", "_head", "place", *group, *values).collect()  # one row for each partition
    before = _carries(sorted(ends, key=lambda r: r["_part"]), group, sums, rolls, local)
    if not before:
        return local.drop("_part", "_head", "_last")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, head = b.column("_part").to_numpy(), b.column("_head").to_numpy(zero_copy_only=False)
            if not any(p in before for p in np.unique(part[head]).tolist()):
                yield b.select([*names, "place"])
                continue
            place, cols = b.column("place").to_numpy().copy(), {c: b.column(c).to_numpy().view(np.uint64).copy() for c in values}
            for p in np.unique(part[head]).tolist():
                if p in before:
                    at = np.flatnonzero(head & (part == p))
                    with np.errstate(over="ignore"):
                        for c in sums:
                            cols[c][at] += np.uint64(before[p][c])
                        for i, c in enumerate(rolls):
                            cols[c][at] += np.uint64(before[p][c]) * powers(BASES[i % 2], place[at])
                    place[at] += before[p]["place"]
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[c].view(np.int64)) if c in cols else b.column(c) for c in names), pa.array(place)], [*names, "place"])

    return materialize(local.mapInArrow(joined, kinds + ", place long"), label)[0]


def _carries(ends: list, group: list[str], sums: tuple[str, ...], rolls: tuple[str, ...], local: DataFrame) -> dict[int, dict[str, int]]:
    """By partition, what its first group has gathered in the partitions before; absent where nothing."""
    wrap = (1 << 64) - 1
    if not ends:
        return {}
    first = {r["_part"]: tuple(r[c] for c in group) for r in local.where("_head and place = 1").select("_part", *group).collect()}
    out: dict[int, dict[str, int]] = {}
    key, held = None, None
    for r in ends:
        p, end = r["_part"], tuple(r[c] for c in group)
        goes_on = held is not None and first[p] == key
        if goes_on:
            out[p] = dict(held)
        now = {"place": r["place"], **{c: r[c] & wrap for c in (*sums, *rolls)}}
        if goes_on and end == key:  # the whole partition is one group
            now |= {c: (now[c] + held[c]) & wrap for c in sums}
            now |= {c: (now[c] + held[c] * pow(int(BASES[i % 2]), r["place"], 1 << 64)) & wrap for i, c in enumerate(rolls)}
            now["place"] = r["place"] + held["place"]
        key, held = end, now
    return out
