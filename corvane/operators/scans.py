"""Searches within scans: the points of whole scans, many scans at a time, against a grid of cells in arrays.

Spark deals rows out by scan once; no point is copied to the cells around it and no pair is shuffled before it is reduced. A task holds the scans of one batch (``SCAN_ROWS``
rows, or one scan where that is longer) and about ``CANDIDATES`` candidate pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SCAN_ROWS = 20_000
CANDIDATES = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _codes(group: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """One number for a scan and its cell; what collides is told apart later."""
    out = group.astype(np.uint64) * _MIX[0]
    for k in range(cells.shape[1]):
        out = (out ^ (out >> np.uint64(29))) * _MIX[1] + cells[:, k].astype(np.uint64) * _MIX[2 + k % 2]
    return out


def close_pairs(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, radius: float, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, squared distance) of points a[i] and b[j] of one group whose squared distance is at most radius², all pairs of an i in one part, i ascending.

    ``once``: both sides are the same points, and of two each pair comes once, with i < j. All axes but the first have cells; along the first, the points of a cell
    are a range. Points that aren't finite are near nothing.
    """
    n, m = len(a), len(b)
    fine_a, fine_b = np.flatnonzero(np.isfinite(a).all(1)), np.flatnonzero(np.isfinite(b).all(1))
    if len(fine_a) < n or len(fine_b) < m:
        for i, j, d2 in close_pairs(ga[fine_a], a[fine_a], gb[fine_b], b[fine_b], radius, once):
            yield fine_a[i], fine_b[j], d2
        return
    if not n or not m:
        return
    size = radius * (1 + 1e-6)  # a little wider than the radius: what rounds to it is in the next cell at most
    cells = lambda p: np.clip(np.floor(p[:, 1:] / size), -(2.0**62), 2.0**62).astype(np.int64)
    ca, cb = cells(a), cells(b)
    known, rank = np.unique(_codes(gb, cb), return_inverse=True)
    order = np.lexsort((b[:, 0], rank))
    xs = np.sort(b[:, 0])
    place = rank[order] * (m + 1) + xs.searchsorted(b[order, 0], "left")
    wide = radius + 1e-12 * (np.abs(a[:, 0]) + radius)
    p, q = xs.searchsorted(a[:, 0] - wide, "left"), xs.searchsorted(a[:, 0] + wide, "right")
    shifts = np.array(list(product((-1, 0, 1), repeat=a.shape[1] - 1)), np.int64).reshape(3 ** (a.shape[1] - 1), -1)
    first, count = np.zeros((n, len(shifts)), np.int64), np.zeros((n, len(shifts)), np.int64)
    for s, shift in enumerate(shifts):
        code = _codes(ga, ca + shift)
        at = np.minimum(known.searchsorted(code), len(known) - 1)
        lo, hi = place.searchsorted(at * (m + 1) + p, "left"), place.searchsorted(at * (m + 1) + q, "left")
        first[:, s], count[:, s] = lo, np.where(known[at] == code, hi - lo, 0)
    upto = count.sum(1).cumsum()
    start = 0
    while start < n:
        stop = max(start + 1, int(upto.searchsorted((upto[start - 1] if start else 0) + CANDIDATES, "right")))
        c = count[start:stop].reshape(-1)
        total = int(c.sum())
        row = np.arange(start, stop).repeat(len(shifts))
        i = row.repeat(c)
        j = order[(first[start:stop].reshape(-1) - (c.cumsum() - c)).repeat(c) + np.arange(total)]
        shift = shifts[np.tile(np.arange(len(shifts)), stop - start).repeat(c)]
        ok = (ga[i] == gb[j]) & (ca[i] + shift == cb[j]).all(1)
        if once:
            ok &= i < j
        i, j = i[ok], j[ok]
        d = a[i] - b[j]
        d2 = d[:, 0] * d[:, 0]
        for k in range(1, d.shape[1]):
            d2 = d2 + d[:, k] * d[:, k]
        near = d2 <= radius * radius
        yield i[near], j[near], d2[near]
        start = stop


def nearest_first(i: np.ndarray, j: np.ndarray, d2: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2, rank) of the ``most`` nearest of each i, ranks from 1, ties to the smaller id."""
    by = np.lexsort((ids[j], d2, i))
    i, j, d2 = i[by], j[by], d2[by]
    new = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) + 1
    kept = rank <= most
    return i[kept], j[kept], d2[kept], rank[kept]


def whole_scans(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole scans with each row's scan as a number; the rows come sorted by their first ``keys`` columns."""

    def scans(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in range(keys):
            now, before = t.column(k).slice(1), t.column(k).slice(0, t.num_rows - 1)
            new[1:] |= np.asarray(pc.fill_null(pc.not_equal(now, before), True)) & ~np.asarray(pc.and_(pc.is_null(now), pc.is_null(before)))  # nulls are a scan
        return new.cumsum()

    held, rows, limit = [], 0, SCAN_ROWS
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < limit:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        scan = scans(t)
        cut = int(scan.searchsorted(scan[-1]))  # the last scan may go on
        if cut:
            yield t.slice(0, cut), scan[:cut]
            held, rows, limit = t.slice(cut).to_batches(), t.num_rows - cut, max(SCAN_ROWS, 2 * (t.num_rows - cut))
        else:
            held, limit = t.to_batches(), 2 * rows
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, scans(t)


Solve = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def search(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...], axes: tuple[str, ...], solve: Solve, schema: T.StructType, once: bool = False) -> DataFrame:
    """What ``solve`` makes of the pairs of a left and a right point of equal keys within the radius: it gets both sides' rows and (i, j, squared distance), all pairs of a
    left row in one call. Rows with a null key or coordinate are near nothing. The same table on both sides is dealt out once."""
    own = left is right
    known = lambda df: df.dropna(subset=[*keys, *axes])
    side = lambda df, s: known(df).select(*[F.col(k) for k in keys], F.lit(s).alias("__left"), *[F.col(c).alias(f"{'a' if s else 'b'}_{c}") for c in df.columns if c not in keys])
    rows = side(left, True) if own else side(left, True).unionByName(side(right, False), allowMissingColumns=True)
    names = [[*keys, *(c for c in df.columns if c not in keys)] for df in (left, right)]
    out, n = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, scan in whole_scans(batches, n):
            is_left = np.asarray(t.column(n))
            sides = []
            for s, (letter, columns) in enumerate(zip("ab", names, strict=True)):
                if own and s:
                    sides.append(sides[0])
                    continue
                mine = np.flatnonzero(is_left if not s else ~is_left)
                part = t.select([*keys, *(f"{letter}_{c}" for c in columns[n:])]).take(pa.array(mine)).rename_columns(columns)
                sides.append((part, scan[mine], np.column_stack([np.asarray(part.column(x), float) for x in axes])))
            (a, ga, pa_), (b, gb, pb) = sides
            for i, j, d2 in close_pairs(ga, pa_, gb, pb, radius, once):
                yield from solve(a, b, i, j, d2).cast(out).to_batches(max_chunksize=1 << 16)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


SolveGraph = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def solve_graphs(nodes: DataFrame, edges: DataFrame, key: str, solve: SolveGraph, schema: T.StructType) -> DataFrame:
    """What ``solve`` makes of the graphs of many whole scans at a time: their nodes (key, point_id, ...) by scan and id, each one's scan as a number, and the places of the
    edges' (key, src, dst) ends among them. Edges whose ends aren't nodes of their scan go."""
    names = [key, "point_id", *(c for c in nodes.columns if c not in (key, "point_id"))]
    left = nodes.select(key, F.lit(False).alias("__edge"), F.col("point_id").cast("long").alias("point_id"), F.lit(None).cast("long").alias("__dst"), *names[2:])
    right = edges.select(key, F.lit(True).alias("__edge"), F.col("src").cast("long").alias("point_id"), F.col("dst").cast("long").alias("__dst"))
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, scan in whole_scans(batches, 1):
            edge = np.asarray(t.column("__edge"))
            n, e = (np.flatnonzero(x) for x in (~edge, edge))
            if not len(n):
                continue
            part, of = t.select(names).take(pa.array(n)), scan[n]
            ids = np.asarray(part.column("point_id"))
            known = np.unique(ids)
            code = of * len(known) + known.searchsorted(ids)
            ends = [np.asarray(t.column(c).take(pa.array(e)), np.int64) for c in ("point_id", "__dst")]
            rank = [np.minimum(known.searchsorted(x), len(known) - 1) for x in ends]
            place = [np.minimum(code.searchsorted(scan[e] * len(known) + r), len(n) - 1) for r in rank]
            met = (of[place[0]] == scan[e]) & (of[place[1]] == scan[e]) & (ids[place[0]] == ends[0]) & (ids[place[1]] == ends[1])
            yield from solve(part, of, place[0][met], place[1][met]).cast(out).to_batches(max_chunksize=1 << 16)

    rows = left.unionByName(right, allowMissingColumns=True)
    return rows.repartition(key).sortWithinPartitions(key, "__edge", "point_id").mapInArrow(run, schema)
