"""Linings along a track, from fit to mask: levelled points, windows, peeled planes, support strips, and a mask that meets each scan's own strips.

Scans are dealt out whole, many to a task: points aren't copied to the windows that hold them, and the mask and the normals it asks for are found where a scan's
points and its strips lie together. What decides about planes and strips are aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import numeric as fn
from . import scans
from .registration import directions, spreads
from .scans import close_pairs, whole_scans
from .spatial import XYZ

KEYS = ("frame",)
PLANE = ("nx", "ny", "nz", "offset")
#: Distances of points from trial planes that are weighed at once.
VOTES = 1 << 20


@dataclass(frozen=True)
class LiningParams:
    window: float  # length of a window; windows begin every half of it
    inlier: float  # a plane's points lie within this
    support: int  # least points of a plane
    planes: int  # planes of a window at most
    forward: float  # most of a normal along the track
    cross: float  # least of it across (wall) or up (ceiling)
    length: float  # least length of a plane's support along the track
    breadth: float  # and across it
    strip: float
    strip_support: int
    strip_span: float
    trials: int = 120
    seed: int = 0


def levelled(points: DataFrame, planes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``points`` turned so that their scan's plane z = a x + b y + c (keys, a, b, c) lies level, and ``height`` above the plane along z as it was.

    The turn is the shortest one. Points of scans without a plane go.
    """
    return turned(points.join(planes.select(*keys, F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("c").alias("__c")), list(keys)))


def turned(points: DataFrame) -> DataFrame:
    """``levelled`` of points that have their scan's plane as ``__a``, ``__b`` and ``__c``."""
    p = points.where("__a is not null and __b is not null and __c is not null")
    size = F.sqrt(1 + F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b"))
    p = p.withColumns({"__x": -F.col("__a") / size, "__y": -F.col("__b") / size, "__z": 1 / size, "height": F.col("z") - F.col("__a") * F.col("x") - F.col("__b") * F.col("y") - F.col("__c")})
    across = (F.col("__x") * F.col("x") + F.col("__y") * F.col("y")) / (1 + F.col("__z"))
    level = {"x": F.col("x") - F.col("__x") * (across + F.col("z")), "y": F.col("y") - F.col("__y") * (across + F.col("z")), "z": F.col("__x") * F.col("x") + F.col("__y") * F.col("y") + F.col("__z") * F.col("z")}
    return p.withColumns(level).drop("__a", "__b", "__c", "__x", "__y", "__z")


def windows(points: DataFrame, size: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``points`` once for the whole scan (window 0) and once for each window [start, start + size] that holds them; windows start at the scan's least x and every
    half window from there, as long as points lie beyond."""
    scan = W.partitionBy(*keys)
    half = size / 2
    p = points.withColumns({"__lo": F.min("x").over(scan), "__hi": F.max("x").over(scan)})
    k = F.floor((F.col("x") - F.col("__lo")) / half).cast("long")
    p = p.withColumn("window", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.sequence(F.greatest(k - 1, F.lit(1)), k + 1))))
    start = F.col("__lo") + (F.col("window") - 1) * half
    inside = (F.col("window") == 0) | ((start <= F.col("x")) & (F.col("x") <= start + size) & (start < F.col("__hi")))
    return p.where(inside).drop("__lo", "__hi")


def best_plane(p: np.ndarray, inlier: float, trials: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(nx, ny, nz, offset) of the plane with most points, and which those are. Trials are one batch; the best is fitted once more to its points,
    if that keeps as many. Without three points off a line no point is on it."""
    corner = p[rng.integers(0, len(p), (trials, 3))]
    normal = np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0])
    size = np.linalg.norm(normal, axis=1)
    ok = size > 1e-9
    if not ok.any():
        return np.zeros(4), np.zeros(len(p), bool)
    normal = normal[ok] / size[ok, None]
    offset = -(normal * corner[ok, 0]).sum(1)
    parts = max(1, -(-len(p) * len(normal) // VOTES))
    votes = np.concatenate([(np.abs(p @ n.T + o) < inlier).sum(0) for n, o in zip(np.array_split(normal, parts), np.array_split(offset, parts), strict=True)])
    k = votes.argmax()
    plane, on = np.append(normal[k], offset[k]), np.abs(p @ normal[k] + offset[k]) < inlier
    middle = p[on].mean(0)
    n = np.linalg.eigh((p[on] - middle).T @ (p[on] - middle))[1][:, 0]
    again = np.abs((p - middle) @ n) < inlier
    if again.sum() >= on.sum():
        plane, on = np.append(n, -(n @ middle)), again
    return plane * (1 if plane[np.abs(plane[:3]).argmax()] > 0 else -1), on


def peeled(p: np.ndarray, window: int, c: LiningParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(plane, its points' places) of one window, each from what those before it left."""
    left, rng = np.arange(len(p)), np.random.default_rng([c.seed, window])
    for _ in range(c.planes):
        if len(left) < max(3, c.support):
            return
        plane, on = best_plane(p[left], c.inlier, c.trials, rng)
        if on.sum() < c.support:
            return
        yield plane, left[on]
        left = left[~on]


def peeled_planes(sample: DataFrame, c: LiningParams, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, window, round, nx, ny, nz, offset, point_id, x, y, z): the points of up to ``planes`` planes of each window, each plane from what those before it left.

    Windows stream through their task many at a time, in the order of their points; none is a table of its own.
    """
    rows = sample.select(*keys, "window", "point_id", *XYZ)
    names = [*keys, "window"]
    # Few bytes make much work here, so Spark isn't left to join small partitions to one task.
    dealt = rows.repartition(int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names).sortWithinPartitions(*names, "point_id")
    return _peeled(dealt, names, keys, lambda xyz, number: [(np.arange(len(xyz)), int(number[0]))], c)


def windows_of(x: np.ndarray, lo: float, size: float) -> list[tuple[np.ndarray, int]]:
    """(places, window) of the points of one scan, of which ``lo`` is the least, in each window of ``windows``; points without an x are in the whole scan's alone."""
    out = [(np.arange(len(x)), 0)]
    if np.isnan(x).all():
        return out
    half, hi = size / 2, np.nanmax(x)
    k, start, w = np.floor((x - lo) / half), lo, 1
    while start < hi:
        at = np.flatnonzero((start <= x) & (x <= start + size) & (np.maximum(k - 1, 1) <= w) & (w <= k + 1))
        if len(at):
            out.append((at, w))
        w += 1
        start = lo + (w - 1) * half
    return out


def peeled_scans(sample: DataFrame, c: LiningParams, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``peeled_planes`` of the ``windows`` of a sample (keys, point_id, x, y, z) whose scans are dealt out whole: no point is copied to the windows that hold it."""
    # The least x is taken over the scan, so whatever thinned the sample, its scans still lie whole here.
    rows = sample.select(*keys, F.min("x").over(W.partitionBy(*keys)).alias("window"), "point_id", *XYZ)
    return _peeled(rows.sortWithinPartitions(*keys, "point_id"), list(keys), keys, lambda xyz, lo: windows_of(xyz[:, 0], lo[0], c.window), c)


def _peeled(rows: DataFrame, names: list[str], keys: tuple[str, ...], parts: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, int]]], c: LiningParams) -> DataFrame:
    """The planes' points of the windows that ``parts`` makes of each run of rows with equal ``names``, from their places and what stands in ``window``."""
    out = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, T.LongType()) for n in ("window", "round")), *(T.StructField(n, T.DoubleType()) for n in PLANE), rows.schema["point_id"], *(T.StructField(n, T.DoubleType()) for n in XYZ)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, scan in whole_scans(batches, len(names)):
            xyz = np.column_stack([np.asarray(t.column(a), float) for a in XYZ])
            given = np.asarray(t.column("window"))
            first = np.flatnonzero(np.r_[True, scan[1:] != scan[:-1]])
            at, windows, rounds, planes = [], [], [], []
            for a, b in zip(first, [*first[1:], len(scan)], strict=True):
                for places, number in parts(xyz[a:b], given[a:b]):
                    for k, (plane, on) in enumerate(peeled(xyz[a + places], number, c)):
                        at.append(a + places[on])
                        windows.append(np.full(len(on), number))
                        rounds.append(np.full(len(on), k))
                        planes.append(np.broadcast_to(plane, (len(on), 4)))
            if at:
                of = t.take(pa.array(np.concatenate(at)))
                plane = np.concatenate(planes)
                new = {"window": pa.array(np.concatenate(windows)), "round": pa.array(np.concatenate(rounds))} | {n: pa.array(np.ascontiguousarray(plane[:, i])) for i, n in enumerate(PLANE)}
                yield from pa.table([new[n] if n in new else of.column(n) for n in out.names], out.names).cast(arrow).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(run, out)


def across(kind: Column | str) -> Column:
    """The coordinate across a lining: height for walls, y for ceilings."""
    return F.when((F.col(kind) if isinstance(kind, str) else kind) == "wall", F.col("z")).otherwise(F.col("y"))


def linings(members: DataFrame, c: LiningParams, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``members`` of the planes that are walls or ceilings along the track, long and broad enough, with ``kind`` and the coordinate across, ``t``."""
    kind = F.when(F.abs("nx") > c.forward, None).when(F.abs("ny") >= c.cross, "wall").when(F.abs("nz") >= c.cross, "ceiling")
    m = members.withColumn("kind", kind).where("kind is not null").withColumn("t", across("kind"))
    own = W.partitionBy(*keys, "window", "round")
    span = lambda v: F.max(v).over(own) - F.min(v).over(own)
    return m.withColumns({"__l": span("x"), "__b": span("t")}).where((F.col("__l") >= c.length) & (F.col("__b") >= c.breadth)).drop("__l", "__b")


def strips(members: DataFrame, c: LiningParams, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, window, round, kind, plane, strip, n, x0, x1, t0, t1): where a lining was observed, strip by strip; between them it claims nothing."""
    own = [*keys, "window", "round", "kind", *PLANE]
    g = members.groupBy(*own, fn.cell("x", c.strip).alias("strip")).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return g.where((F.col("n") >= c.strip_support) & (F.col("t1") - F.col("t0") >= c.strip_span))


@dataclass(frozen=True)
class ClaimParams:
    band: float  # a lining's points lie this near its plane
    margin: float  # and this much beyond a strip's observed box at most
    agreement: float  # least cosine between a point's normal and the plane's
    depth: float  # what stands off a plane by this much at least
    reach: float  # and this much at most, inside a strip, protrudes
    guard: float  # points this near something that protrudes stay


@dataclass(frozen=True)
class NormalParams:
    radius: float  # a normal is that of the nearest points within this
    most: int  # of so many at most
    least: int  # and at least


def claimed(xyz: np.ndarray, scan: np.ndarray, normal: np.ndarray, boxes: np.ndarray, of: np.ndarray, c: ClaimParams) -> tuple[np.ndarray, np.ndarray]:
    """(on, off) of points of many scans against the strips' boxes of their own: whether any strip claims it, and whether it stands off any. A strip and a point meet by their
    stretch of track, about ``scans.CANDIDATES`` pairs at a time."""
    on, off = np.zeros(len(xyz), bool), np.zeros(len(xyz), bool)
    # Boxes: wall or not, normal, offset, x0, x1, t0, t1.
    known = np.flatnonzero(np.isfinite(xyz[:, 0]))
    order = known[np.lexsort((xyz[known, 0], scan[known]))]
    xs = np.sort(xyz[known, 0])
    place = scan[order] * (len(xs) + 1) + xs.searchsorted(xyz[order, 0], "left")
    lo = place.searchsorted(of * (len(xs) + 1) + xs.searchsorted(boxes[:, 5] - c.margin, "left"), "left")
    hi = place.searchsorted(of * (len(xs) + 1) + xs.searchsorted(boxes[:, 6] + c.margin, "right"), "left")
    count = np.maximum(hi - lo, 0)
    upto, start = count.cumsum(), 0
    while start < len(boxes):
        stop = max(start + 1, int(upto.searchsorted((upto[start - 1] if start else 0) + scans.CANDIDATES, "right")))
        n = count[start:stop]
        b = np.arange(start, stop).repeat(n)
        i = order[(lo[start:stop] - (n.cumsum() - n)).repeat(n) + np.arange(int(n.sum()))]
        p, s = xyz[i], boxes[b]
        t = np.where(s[:, 0] > 0, p[:, 2], p[:, 1])
        inside = (p[:, 0] >= s[:, 5] - c.margin) & (p[:, 0] <= s[:, 6] + c.margin) & (t >= s[:, 7] - c.margin) & (t <= s[:, 8] + c.margin)
        i, p, s = i[inside], p[inside], s[inside]
        far = np.abs(s[:, 1] * p[:, 0] + s[:, 2] * p[:, 1] + s[:, 3] * p[:, 2] + s[:, 4])
        agrees = np.abs(s[:, 1] * normal[i, 0] + s[:, 2] * normal[i, 1] + s[:, 3] * normal[i, 2]) >= c.agreement
        on[i[(far < c.band) & agrees]] = True
        off[i[(far >= c.depth) & (far <= c.reach) & ~agrees]] = True
        start = stop
    return on, off


def lining_mask(points: DataFrame, normals: DataFrame | NormalParams, found: DataFrame, c: ClaimParams, strip: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``points`` with ``masked`` and ``protects``: a point is masked if any strip of its own scan claims it and nothing that protrudes is near.

    ``normals`` is a table (keys, point_id, nx, ny, nz), or says how they are found among the scan's points. Scans are dealt out once, whole, with their ``found`` strips of
    whatever length (``strip`` needn't be known), and nothing is joined back. Null normals agree with nothing.
    """
    fit = normals if isinstance(normals, NormalParams) else None
    own = [*keys, *(n for n in points.columns if n not in keys)]
    p = points.select(*own)
    if fit is None:
        p = p.join(normals.select(*keys, "point_id", F.array(*[F.col(n).cast("double") for n in PLANE[:3]]).alias("__normal")), [*keys, "point_id"], "left").select(*own, "__normal")
    wall = F.when(F.col("kind") == "wall", 1.0).otherwise(0.0)
    boxes = found.dropna(subset=list(keys)).select(*keys, F.array(wall, *[F.col(n).cast("double") for n in (*PLANE, "x0", "x1", "t0", "t1")]).alias("__box"))
    rows = p.unionByName(boxes, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*(points.schema[n] for n in own), T.StructField("masked", T.BooleanType()), T.StructField("protects", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
        """A column of lists of numbers as rows of an array, NaN for nulls."""
        out = np.full((len(column), width), np.nan)
        there = np.flatnonzero(np.asarray(column.is_valid()))
        if len(there):
            out[there] = np.asarray(pc.list_flatten(column.take(pa.array(there))), float).reshape(-1, width)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, scan in whole_scans(batches, len(keys)):
            is_box = np.asarray(t.column("__box").is_valid())
            mine, theirs = np.flatnonzero(~is_box), np.flatnonzero(is_box)
            if not len(mine):
                continue
            part, of = t.take(pa.array(mine)), scan[mine]
            xyz = np.column_stack([np.asarray(part.column(a), float) for a in XYZ])
            if fit is None:
                normal = lists(part.column("__normal"), 3)
            else:
                normal, ids = np.full((len(mine), 3), np.nan), np.asarray(part.column("point_id"))
                for i, j, d2 in close_pairs(of, xyz, of, xyz, fit.radius):
                    at, n, cov = spreads(xyz, ids, i, j, d2, fit.most)
                    normal[at] = directions(n, cov, fit.least)[0]
            on, off = claimed(xyz, of, normal, lists(t.column("__box").take(pa.array(theirs)), 9), scan[theirs], c)
            protects, masked = off & ~on, on.copy()
            a, b = np.flatnonzero(on), np.flatnonzero(protects)
            for i, _, _ in close_pairs(of[a], xyz[a], of[b], xyz[b], c.guard):
                masked[a[i]] = False
            yield from pa.table([*part.select(own).columns, pa.array(masked), pa.array(protects)], schema.names).cast(arrow).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(run, schema).select(*points.columns, "masked", "protects")
