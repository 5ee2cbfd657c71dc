"""How well consecutive scans agree: local covariances and normals, registration quality, recurrence of shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import nearest_first, search
from .spatial import XYZ, nearest, radius_semi

AXES = ("xx", "xy", "xz", "yy", "yz", "zz")


def spreads(xyz: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray, d2: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, n, covariance by ``AXES``) of the ``most`` nearest j of each i, ties to the smaller id."""
    i, j, _, _ = nearest_first(i, j, d2, ids, most)
    own, at, n = np.unique(i, return_inverse=True, return_counts=True)
    off = dict(zip(XYZ, (xyz[j] - xyz[i]).T, strict=True))
    mean = lambda v: np.bincount(at, v, len(own)) / n
    m = {c: mean(off[c]) for c in XYZ}
    return own, n, np.column_stack([mean(off[p[0]] * off[p[1]]) - m[p[0]] * m[p[1]] for p in AXES])


def directions(n: np.ndarray, cov: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(normals, planarity) of covariances by ``AXES``, NaN where there is none."""
    value, vector = np.linalg.eigh(cov[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
    d = vector[:, :, 0]
    d = d * np.where(d[np.arange(len(d)), np.abs(d).argmax(1)] < 0, -1.0, 1.0)[:, None]
    ok = (n >= least) & (value[:, 1] > 1e-12)
    return np.where(ok[:, None], d, np.nan), np.where(ok, 1 - np.maximum(value[:, 0], 0) / np.maximum(value[:, 1], 1e-12), np.nan)


def covariances(points: DataFrame, radius: float, most: int, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(keys, point_id, n, xx .. zz): covariance of each point's at most ``most`` nearest neighbours within the radius, itself among them.

    Sums are taken over offsets from the point, so they stay exact far from the origin.
    """
    side = points.select(*keys, "point_id", *XYZ)
    schema = T.StructType([*(side.schema[c] for c in (*keys, "point_id")), T.StructField("n", T.LongType()), *(T.StructField(p, T.DoubleType()) for p in AXES)])

    def solve(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> pa.Table:
        xyz = np.column_stack([np.asarray(a.column(c), float) for c in XYZ])
        own, n, cov = spreads(xyz, np.asarray(b.column("point_id")), i, j, d2, most)
        return pa.table([*a.select([*keys, "point_id"]).take(pa.array(own)).columns, pa.array(n), *(pa.array(np.ascontiguousarray(v)) for v in cov.T)], schema.names)

    return search(side, side, radius, keys, XYZ, solve, schema)


def normals(cov: DataFrame, keys: tuple[str, ...] = ("frame",), least: int = 3) -> DataFrame:
    """(keys, point_id, nx, ny, nz, planarity): direction of least spread, and how much less it is than the middle one (0 to 1). Null with
    fewer than ``least`` neighbours or without a plane. All matrices of a batch are solved together."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, flat = directions(b["n"].to_numpy(), b[list(AXES)].to_numpy(float), least)
            out = b[[*keys, "point_id"]].copy()
            for i, c in enumerate(("nx", "ny", "nz")):
                out[c] = n[:, i]
            yield out.assign(planarity=flat)

    head = ", ".join(f"{k} {cov.schema[k].dataType.simpleString()}" for k in (*keys, "point_id"))
    out = cov.mapInPandas(solve, f"{head}, nx double, ny double, nz double, planarity double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("nx", "ny", "nz", "planarity")})


def registration_quality(source: DataFrame, target: DataFrame, max_residual: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(keys, n, overlap, residual): the share of source points with a target point within twice the residual, and the median distance of those."""
    near = nearest(source, target, 2 * max_residual, keys).groupBy(*keys).agg(F.count("*").alias("met"), F.median(F.sqrt("d2")).alias("residual"))
    n = source.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(near, list(keys), "left").select(*keys, "n", (F.coalesce("met", F.lit(0)) / F.col("n")).alias("overlap"), "residual")


def weak_axes(directions: DataFrame, share: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(keys, information, weak): of normals (nx, ny, nz), the share of each axis in the summed outer products' diagonal, and the axes below ``share``."""
    sums = directions.where("nx is not null").groupBy(*keys).agg(*[F.avg(F.col(c) * F.col(c)).alias(c) for c in ("nx", "ny", "nz")])
    info = F.array("nx", "ny", "nz")
    weak = F.filter(F.array(*[F.when(F.col(c) < share, F.lit(a)) for c, a in (("nx", "x"), ("ny", "y"), ("nz", "z"))]), lambda a: a.isNotNull())
    return sums.select(*keys, info.alias("information"), weak.alias("weak"))


def shape_recurrence(supports: DataFrame, radius: float, least: float, window: int, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """(keys, frame, overlap, hits) of supports (keys, frame, point_id, x, y, z): how much of an object's shape, about its own centre, recurs in
    the next scan, both ways round; and for how many consecutive scans it has done so (``window`` at most, 1 for the first)."""
    by = W.partitionBy(*keys, "frame")
    own = [*keys, "frame"]
    now = supports.select(*own, "point_id", *[(F.col(a) - F.avg(a).over(by)).alias(a) for a in XYZ])
    before = now.withColumn("frame", F.col("frame") + 1)
    count = lambda df, name: df.groupBy(*own).agg(F.count("*").alias(name))
    parts = [count(now, "n"), count(before, "m"), count(radius_semi(now, before, radius, tuple(own)), "forward"), count(radius_semi(before, now, radius, tuple(own)), "backward")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, own, "left")
    share = F.when(F.col("m").isNotNull(), F.least(F.coalesce("forward", F.lit(0)) / F.col("n"), F.coalesce("backward", F.lit(0)) / F.col("m")))
    order = W.partitionBy(*keys).orderBy("frame")
    out = out.select(*own, share.alias("overlap"), F.coalesce(share >= least, F.lit(False)).alias("again")).withColumn("run", F.sum((~F.col("again")).cast("int")).over(order))
    hits = F.least(F.row_number().over(W.partitionBy(*keys, "run").orderBy("frame")), F.lit(window))
    return out.select(*own, "overlap", hits.alias("hits"))
