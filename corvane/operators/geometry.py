"""Classification of points against each scan's reference geometry, as DataFrame expressions.

A scan's geometry is one row: a plane, ground anchors (x, shift, spread), rail anchors (x, center, gauge, support),
the rail head's height and a continuation of the centre line past either end. It is joined to points by scan; every
value at a point comes from array functions over the anchors, so no as-of join and no UDF is needed.
Unmeasured uncertainty is null, never infinity, because SQL engines order NaN and infinity differently from arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import along, bracket

EDGE = "struct<x:double,y:double,slope:double,curvature:double,slope_var:double,curvature_var:double,cov:double>"
GEOMETRY = f"plane array<double>, ground array<struct<x:double,shift:double,spread:double>>, rail array<struct<x:double,center:double,gauge:double,support:double>>, rail_head double, near {EDGE}, far {EDGE}"


@dataclass(frozen=True)
class Limits:
    """Thresholds; the caller chooses all of them."""

    gauge: float
    ground_max_extrapolation: float
    path_max_extrapolation: float
    ground_max_uncertainty: float
    path_max_uncertainty: float
    rail_half_width: float
    rail_vertical_margin: float
    envelope: tuple[tuple[float, float, float, float], ...]  # (bottom, top, half width at bottom, at top), contiguous
    margin: float
    context_margin: float
    min_running_height: float
    segmentation_half_width: float


def continuation(anchors: np.ndarray, last: bool, window: float = 30.0, significance: float = 4.0, max_slope: float = 0.1) -> tuple[float, ...]:
    """(x, y, slope, curvature, var slope, var curvature, cov) of y = slope*d + curvature*d² from an end of the centre line.

    A least-squares parabola through the end anchor over ``window`` metres; a curvature within ``significance`` of its own standard
    error is taken as none, and the slope is held to ``max_slope``. Too few or degenerate anchors give the
    two-point tangent without variance.
    """
    a = anchors[np.argsort(anchors[:, 0], kind="stable")]
    end, other = (a[-1], a[-2 if len(a) > 1 else -1]) if last else (a[0], a[1 if len(a) > 1 else 0])
    d = a[:, 0] - end[0]
    d, y = d[np.abs(d) <= window], (a[:, 1] - end[1])[np.abs(d) <= window]
    m = np.stack([d, d * d], 1)
    normal = m.T @ m
    if len(d) < 3 or np.linalg.det(normal) <= 0:
        tangent = (other[1] - end[1]) / (other[0] - end[0]) if other[0] != end[0] else 0.0
        return (float(end[0]), float(end[1]), float(np.clip(tangent, -max_slope, max_slope)), 0.0, 0.0, 0.0, 0.0)
    inverse = np.linalg.inv(normal)
    slope, curvature = inverse @ m.T @ y
    cov = inverse * (np.sum((y - m @ [slope, curvature]) ** 2) / max(1, len(d) - 2) if len(d) > 2 else 0.0)
    if abs(curvature) < significance * np.sqrt(max(cov[1, 1], 0.0)):
        curvature = 0.0
    return (float(end[0]), float(end[1]), float(np.clip(slope, -max_slope, max_slope)), float(curvature), float(max(cov[0, 0], 0)), float(max(cov[1, 1], 0)), float(cov[0, 1]))


def geometry_table(spark: SparkSession, rows: list[dict], key: str = "frame") -> DataFrame:
    """A geometry table from numbers; the two continuations are fitted here."""
    out = []
    for r in rows:
        rail = np.array(r["rail"], float).reshape(-1, 4)
        ends = [continuation(rail, last) if len(rail) >= 2 else None for last in (False, True)]
        out.append((r[key], list(r["plane"]) if r["plane"] is not None else None, [tuple(x) for x in r["ground"]], [tuple(x) for x in r["rail"]], r["rail_head"], *ends))
    return spark.createDataFrame(out, f"{key} long, {GEOMETRY}")


def reach(x: Column, between: Column) -> Column:
    """Distance from x to the nearest of its bracketing anchors; null without anchors. One anchor is as good as many here."""
    return F.least(F.abs(x - between["left"]["x"]), F.abs(between["right"]["x"] - x))


def ground_values(x: Column, between: Column, max_extrapolation: float) -> tuple[Column, Column]:
    """(shift, uncertainty) of the bed at x; the uncertainty is null beyond the reach of its anchors."""
    r = reach(x, between)
    return along(x, between, "x", "shift"), F.when(r <= max_extrapolation, along(x, between, "x", "spread") + F.lit(0.008) * r)


def path_values(x: Column, between: Column, enough: Column, near: Column, far: Column, gauge: float, max_extrapolation: float) -> tuple[Column, Column, Column]:
    """(centre, gauge, uncertainty) of the path at x; past either end the continuation and its own variance hold."""
    r = reach(x, between)
    base = F.lit(0.06) + F.lit(0.008) * r + F.lit(0.0003) * r * r

    def beyond(edge: Column) -> tuple[Column, Column]:
        d = x - edge["x"]
        var = d * d * edge["slope_var"] + d * d * d * d * edge["curvature_var"] + 2 * d * d * d * edge["cov"]
        return edge["y"] + edge["slope"] * d + edge["curvature"] * d * d, F.sqrt(base * base + F.greatest(var, F.lit(0.0)))

    before, after = x < near["x"], x > far["x"]
    centre = F.when(~enough, 0.0).when(before, beyond(near)[0]).when(after, beyond(far)[0]).otherwise(along(x, between, "x", "center"))
    spread = F.when(before, beyond(near)[1]).when(after, beyond(far)[1]).otherwise(base)
    return centre, F.when(enough, along(x, between, "x", "gauge")).otherwise(F.lit(gauge)), F.when(enough & (r <= max_extrapolation), spread)


def far_field_bounds(objects: DataFrame, geometry: DataFrame, limits: Limits, key: str = "frame") -> DataFrame:
    """``objects`` (key, distance) with ``bound``, the path's uncertainty at their distance; null with fewer than two rail anchors or beyond their reach."""
    x = F.col("distance")
    g = objects.join(geometry.select(key, "rail", "near", "far"), key, "left").withColumn("__r", bracket(x, F.col("rail"), "x"))
    enough = F.coalesce(F.size("rail") >= 2, F.lit(False))
    bound = path_values(x, F.col("__r"), enough, F.col("near"), F.col("far"), limits.gauge, limits.path_max_extrapolation)[2]
    return g.withColumn("bound", F.when(enough, bound)).drop("__r", "rail", "near", "far")


def width_bounds(lo: Column, hi: Column, envelope: tuple[tuple[float, float, float, float], ...]) -> tuple[Column, Column]:
    """Least and greatest half width of the contour over [lo, hi], both sides of a step included; null where they don't meet."""
    least, most = [], []
    for b, t, wb, wt in envelope:
        meets = (hi >= b) & (lo <= t)
        at = lambda h: F.lit(wb) + F.lit((wt - wb) / (t - b)) * (h - F.lit(b))  # noqa: B023, E731
        a, z = at(F.greatest(lo, F.lit(b))), at(F.least(hi, F.lit(t)))
        least.append(F.when(meets, F.least(a, z)))
        most.append(F.when(meets, F.greatest(a, z)))
    return (F.least(*least), F.greatest(*most)) if len(envelope) > 1 else (least[0], most[0])


def classify(points: DataFrame, geometry: DataFrame, limits: Limits, key: str = "frame") -> DataFrame:
    """Adds height, observed, lateral, running, gauge and the masks core, boundary, overlap, context to each point.

    ``geometry`` holds one row per scan against ~10^5 points, so Spark broadcasts it while it is small and joins by scan
    otherwise. Scans without plane, ground anchors or two rail anchors have context only.
    """
    j = points.join(geometry, key).withColumns({"__g": bracket(F.col("x"), F.col("ground"), "x"), "__r": bracket(F.col("x"), F.col("rail"), "x")})
    x, y, z = (F.col(c) for c in "xyz")
    a, b, c = (F.col("plane")[i] for i in range(3))
    usable = F.col("plane").isNotNull() & (F.size("ground") >= 1) & (F.size("rail") >= 2)
    shift, ug = ground_values(x, F.col("__g"), limits.ground_max_extrapolation)
    centre, gauge, up = path_values(x, F.col("__r"), F.size("rail") >= 2, F.col("near"), F.col("far"), limits.gauge, limits.path_max_extrapolation)
    j = j.withColumns({"__shift": shift, "__ug": ug, "__centre": centre, "gauge": gauge, "__up": up})
    height = z - (a * x + b * y + c + F.col("__shift"))
    j = j.withColumn("height", height)
    normal, ls, dy = F.sqrt(1 + a * a + b * b), F.sqrt(1 + b * b), y - F.col("__centre")
    above = F.col("height") - F.col("rail_head")
    j = j.withColumns({"running": F.when(usable, above / normal), "lateral": F.when(usable, (dy + b * (above + b * dy)) / ls), "__u": F.col("__ug") / normal, "__ulat": F.col("__up") * ls + F.abs(b) * F.col("__ug") / ls})
    ground_ok = F.coalesce(F.col("__ug") <= limits.ground_max_uncertainty, F.lit(False))
    path_ok = F.coalesce(F.col("__up") <= limits.path_max_uncertainty, F.lit(False))
    observed = usable & ground_ok & path_ok
    run, side = F.col("running"), F.abs("lateral")
    on_rail = observed & (F.abs(side - F.col("gauge") / 2) < limits.rail_half_width) & (run <= limits.rail_vertical_margin)
    lo, hi = run - F.col("__u"), run + F.col("__u")
    least, most = width_bounds(lo, hi, limits.envelope)
    nominal = width_bounds(run, run, limits.envelope)[1]
    bottom, top = limits.envelope[0][0], limits.envelope[-1][1]
    yes = lambda e: F.coalesce(e, F.lit(False))
    core = observed & ~on_rail & yes((lo >= bottom) & (hi <= top) & (side + F.col("__ulat") <= least + limits.margin))
    touch = observed & ~on_rail & yes(side - F.col("__ulat") <= most + limits.margin)
    band = run.between(limits.min_running_height, top + limits.context_margin)
    flat_band = (F.col("height") - F.coalesce("rail_head", F.lit(0.0))).between(limits.min_running_height, top + limits.context_margin)
    context = F.when(usable, yes(band) & ~on_rail & (yes(side <= limits.segmentation_half_width) | ~path_ok)).otherwise(F.coalesce(flat_band, F.lit(True)))
    j = j.withColumns({"observed": observed, "core": core, "boundary": touch & ~core, "overlap": usable & ~on_rail & yes(side <= nominal + limits.margin), "context": context})
    return j.drop("__g", "__r", "__shift", "__ug", "__centre", "__up", "__u", "__ulat", "plane", "ground", "rail", "rail_head", "near", "far")
