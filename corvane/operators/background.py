"""The tunnel around a track: bands of patches, masks that leave protruding objects, traces along the walls; and boxes put into scans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as fn
from .spatial import XYZ, radius_semi

#: (x from, x to, unit normal, offset) of a plane n·p + offset = 0.
Patch = tuple[float, float, tuple[float, float, float], float]


def _distance(patch: Patch) -> Column:
    n = patch[2]
    return F.abs(F.lit(n[0]) * F.col("x") + F.lit(n[1]) * F.col("y") + F.lit(n[2]) * F.col("z") + F.lit(patch[3]))


def _within(patch: Patch) -> Column:
    return (F.col("x") >= patch[0]) & (F.col("x") <= patch[1])


def in_bands(patches: list[Patch], band: float) -> Column:
    """Whether a point lies within ``band`` of any patch, on the patch's stretch."""
    return reduce(lambda a, b: a | b, [_within(p) & (_distance(p) < band) for p in patches])


@dataclass(frozen=True)
class MaskParams:
    band: float
    agreement: float  # least cosine of a point's normal with its patch's
    depth: float  # protruding points stand off a patch by this much at least
    reach: float  # and at most this much
    guard: float  # points this near a protruding one stay


def mask(points: DataFrame, normals: DataFrame, patches: list[Patch], c: MaskParams, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """``points`` with ``masked`` and ``protects``. A point's verdict doesn't depend on the order of patches: it is masked if any patch takes it
    and no protruding point is near. Protruding: off a patch, with a normal that doesn't agree with it, and on no other."""
    p = points.join(normals.select(*keys, "point_id", "nx", "ny", "nz"), [*keys, "point_id"], "left")
    turn = lambda t: F.abs(F.col("nx") * t[2][0] + F.col("ny") * t[2][1] + F.col("nz") * t[2][2])
    any_of = lambda f: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(f(t), F.lit(False)) for t in patches]), F.lit(False))
    on = any_of(lambda t: _within(t) & (_distance(t) < c.band) & (turn(t) >= c.agreement))
    off = any_of(lambda t: _within(t) & (_distance(t) >= c.depth) & (_distance(t) <= c.reach) & (turn(t) < c.agreement))
    p = p.withColumns({"on": on, "protects": off & ~on})
    near = radius_semi(p.where("on").select(*keys, "point_id", *XYZ), p.where("protects"), c.guard, keys).select(*keys, "point_id", F.lit(True).alias("guarded"))
    p = p.join(near, [*keys, "point_id"], "left")
    return p.withColumn("masked", F.col("on") & F.col("guarded").isNull()).drop("on", "guarded", "nx", "ny", "nz")


def insert_box(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """``points`` with a box put in, and ``inserted``: a ray from the origin that meets the box before its return ends at the box."""
    t = fn.ray_box([F.lit(0.0)] * 3, [F.col(c) for c in XYZ], [F.lit(v) for v in low], [F.lit(v) for v in high])
    hit = F.coalesce((F.col("__t") > 0) & (F.col("__t") < 1), F.lit(False))
    moved = points.withColumn("__t", t).withColumn("inserted", hit)
    return moved.withColumns({c: F.when(F.col("inserted"), F.col(c) * F.col("__t")).otherwise(F.col(c)) for c in XYZ}).drop("__t")


def shared_curvature(points: DataFrame, keys: list[str], trace: str, least: int = 4) -> DataFrame:
    """(keys, traces, curvature): least squares of y = offset + slope x + curvature x² with an offset and slope for each trace and one curvature.

    Offsets and slopes are taken out of y and x² within each trace (partial regression), which needs its moments alone.
    """
    x, y, q = F.col("x"), F.col("y"), F.col("x") * F.col("x")
    c = points.groupBy(*keys, trace).agg(
        F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.covar_pop(q, x).alias("qx"), F.var_pop(q).alias("qq"), F.covar_pop(x, y).alias("xy"), F.covar_pop(q, y).alias("qy"),
    ).where((F.col("n") >= least) & (F.col("xx") > 0))
    top, bottom = (F.sum(F.col("n") * (F.col(a) - F.col("qx") * F.col(b) / F.col("xx"))) for a, b in (("qy", "xy"), ("qq", "qx")))
    return c.groupBy(*keys).agg(F.count("*").alias("traces"), F.when(bottom != 0, top / bottom).alias("curvature"))


def chain_traces(cells: DataFrame, tolerance: float) -> DataFrame:
    """(frame, step, value, trace) of (frame, step, value): each value goes on the nearest trace that ended in the step before within the
    tolerance; nearest pairs first, ties to the lesser value; a trace takes one value a step. One scan is one group."""

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["step", "value"])
        steps, values = g["step"].to_numpy(), g["value"].to_numpy(float)
        trace, made = np.full(len(g), -1), 0
        before = np.zeros(0, np.int64)
        for at in np.split(np.arange(len(g)), np.flatnonzero(np.diff(steps)) + 1):
            if len(before) and steps[before[0]] == steps[at[0]] - 1:
                gap = np.abs(values[at][:, None] - values[before][None, :])
                i, j = np.nonzero(gap <= tolerance)
                free_i, free_j = np.ones(len(at), bool), np.ones(len(before), bool)
                for k in np.lexsort((j, i, gap[i, j])):
                    if free_i[i[k]] and free_j[j[k]]:
                        trace[at[i[k]]] = trace[before[j[k]]]
                        free_i[i[k]] = free_j[j[k]] = False
            new = trace[at] < 0
            trace[at[new]] = made + np.arange(new.sum())
            made, before = made + int(new.sum()), at
        return pd.DataFrame({"frame": key[0], "step": steps, "value": values, "trace": trace})

    kind = cells.schema["frame"].dataType.simpleString()
    return cells.select("frame", "step", "value").groupBy("frame").applyInPandas(solve, f"frame {kind}, step long, value double, trace long")
