"""Objects among a scan's components: compact candidates against structure, and objects that stand on the running surface."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .assign import shortest_from, union_find
from .scans import solve_graphs


@dataclass(frozen=True)
class CompactParams:
    min_inside: int
    height: tuple[float, float]
    profile: float  # how far from a cluster's median place other inside points count as its profile
    spacing: float
    max_coverage: float
    max_length: float
    max_members: int


def clusters(members: DataFrame, c: CompactParams) -> DataFrame:
    """One row per (frame, label) of members (frame, label, x, y, z, inside) with enough inside, of a height that counts.

    ``continuous`` and ``periodic`` say what else of the scan lies on the cluster's profile: a run along the track, or stretches that
    repeat. The profile is an equi-join by scan of few clusters with the scan's inside points.
    """
    own = lambda v: F.when(F.col("inside"), F.col(v))
    g = members.groupBy("frame", "label").agg(
        F.count("*").alias("members"), F.count_if("inside").alias("n_inside"), F.min(own("x")).alias("distance"), (F.max(own("x")) - F.min(own("x"))).alias("length"),
        (F.max(own("z")) - F.min(own("z"))).alias("height"), F.median(own("y")).alias("at_y"), F.median(own("z")).alias("at_z"),
    ).where((F.col("n_inside") >= c.min_inside) & F.col("height").between(*c.height))
    inside = members.where("inside").select(F.col("frame").alias("f"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    on = (F.col("frame") == F.col("f")) & (F.abs(F.col("py") - F.col("at_y")) < c.profile) & (F.abs(F.col("pz") - F.col("at_z")) < c.profile)
    step = F.col("px") - F.lag("px").over(W.partitionBy("frame", "label").orderBy("px"))
    profile = g.select("frame", "label", "at_y", "at_z").join(inside, on).withColumn("step", step).groupBy("frame", "label")
    profile = profile.agg((F.max("px") - F.min("px")).alias("coverage"), F.count_if(F.col("step") > c.spacing).alias("repeats"))
    out = g.join(profile, ["frame", "label"], "left").withColumns({"coverage": F.coalesce("coverage", F.lit(0.0)), "repeats": F.coalesce("repeats", F.lit(0))})
    return out.withColumns({
        "long": F.col("length") > c.max_length, "attached": F.col("members") > c.max_members, "continuous": F.col("coverage") > c.max_coverage,
        "periodic": (F.col("repeats") >= 1) & (F.col("coverage") > c.max_coverage * 0.5),
    })


def compact(found: DataFrame) -> DataFrame:
    """The clusters that are objects: neither long nor attached, and nothing that continues or repeats along the track."""
    return found.where(~(F.col("long") | F.col("attached") | F.col("continuous") | F.col("periodic")))


@dataclass(frozen=True)
class SurfaceParams:
    contact: float  # points up to this height above the bed are contact
    min_part: int
    upright: float  # least height of a body that stands
    anchor: float  # a standing body's lowest point is at most this high


def _overlap(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes (rows of x and y bounds) that overlap."""
    i, j = np.triu_indices(len(lo), 1)
    meet = ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all(1)
    return i[meet], j[meet]


def surface_parts(xyz: np.ndarray, height: np.ndarray, src: np.ndarray, dst: np.ndarray, c: SurfaceParams) -> np.ndarray:
    """Part of each point of one component, 0 for the largest: what stands on the bed apart from each other is a part each.

    Points above contact form bodies over their edges. Bodies of ``min_part`` points whose footprints overlap are one. With at least two
    and one of them upright and anchored, every other point goes to the body nearest along the edges; otherwise the component stays whole.
    """
    n = len(xyz)
    whole = np.zeros(n, np.int64)
    above = height > c.contact
    place = np.flatnonzero(above)
    free = above[src] & above[dst]
    body = union_find(len(place), place.searchsorted(src[free]), place.searchsorted(dst[free]))
    size = np.bincount(body)
    keep = np.flatnonzero(size >= c.min_part)
    if len(keep) < 2:
        return whole
    own = [place[body == b] for b in keep]
    lo, hi = (np.stack([f(xyz[m, :2], axis=0) for m in own]) for f in (np.min, np.max))
    merged = union_find(len(own), *_overlap(lo, hi))
    seeds = np.full(n, -1)
    for m, b in zip(own, merged, strict=True):
        seeds[m] = b
    stands = [np.ptp(height[seeds == b]) >= c.upright and height[seeds == b].min() <= c.anchor for b in range(merged.max() + 1)]
    if len(stands) < 2 or not any(stands):
        return whole
    at = np.flatnonzero(seeds >= 0)
    length = np.linalg.norm(xyz[src] - xyz[dst], axis=1)
    _, near = shortest_from(n, list(zip(src.tolist(), dst.tolist(), length.tolist(), strict=True)), at.tolist())
    part = np.where(near >= 0, seeds[near], 0)
    order = np.argsort(-np.bincount(part, minlength=len(stands)), kind="stable")
    return np.argsort(order)[part]


def may_split(label: np.ndarray, above: np.ndarray, src: np.ndarray, c: SurfaceParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, edges) of each component with enough points above contact for two bodies; the others, most of a scan's, stay whole and aren't looked at."""
    names, of = np.unique(label, return_inverse=True)
    count = np.bincount(of, weights=above, minlength=len(names))
    by, of_edge = np.argsort(of, kind="stable"), of[src]
    by_edge = np.argsort(of_edge, kind="stable")
    points, edges = (x[y].searchsorted(np.arange(len(names) + 1)) for x, y in ((of, by), (of_edge, by_edge)))
    for k in np.flatnonzero(count >= 2 * max(c.min_part, 1)):
        yield by[points[k] : points[k + 1]], by_edge[edges[k] : edges[k + 1]]


def split_surface(points: DataFrame, edges: DataFrame, c: SurfaceParams) -> DataFrame:
    """(frame, point_id, label, part) of points (frame, point_id, label, x, y, z, height); edges (frame, src, dst) join points of one label."""

    def solve(n: pa.Table, scan: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pa.Table:
        names, rank = np.unique(np.asarray(n.column("label")), return_inverse=True)
        xyz, height = np.column_stack([np.asarray(n.column(a), float) for a in ("x", "y", "z")]), np.asarray(n.column("height"), float)
        part = np.zeros(len(scan), np.int64)
        for at, mine in may_split(scan * len(names) + rank, height > c.contact, src, c):
            part[at] = surface_parts(xyz[at], height[at], at.searchsorted(src[mine]), at.searchsorted(dst[mine]), c)
        return n.select(["frame", "point_id", "label"]).append_column("part", pa.array(part))

    schema = T.StructType([points.schema["frame"], *(T.StructField(f, T.LongType()) for f in ("point_id", "label", "part"))])
    return solve_graphs(points.select("frame", "point_id", "label", "x", "y", "z", "height"), edges, "frame", solve, schema)
