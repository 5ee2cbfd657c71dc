"""Queries against reference geometry, ray casting and pose transforms, with their SQL written out from the same numbers."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as fn
from ..operators import geometry as geo
from ..sources.tables import points, raw_points, table
from .registry import query
from .spatial_queries import RAW

PLANE, HEAD = (0.001, 0.002, 0.2), 0.2
GROUND = [(10.0, 0.0, 0.02), (40.0, 0.05, 0.03), (70.0, 0.1, 0.05)]
RAIL = [(8.0, 0.0, 1.52, 10.0), (20.0, 0.05, 1.52, 9.0), (35.0, 0.15, 1.53, 9.0), (60.0, 0.42, 1.53, 8.0)]
LIMITS = geo.Limits(1.52, 25.0, 25.0, 0.3, 1.5, 0.08, 0.1, ((0.0, 1.0, 0.9, 1.1), (1.0, 3.0, 1.4, 1.4), (3.0, 4.2, 1.4, 0.6)), 0.05, 0.3, -0.1, 1.7)
NEAR, FAR = geo.continuation(np.array(RAIL), False), geo.continuation(np.array(RAIL), True)


def the_geometry(spark: SparkSession) -> DataFrame:
    """One geometry for all scans, as a row: the same numbers as in the SQL."""
    return geo.geometry_table(spark, [{"frame": 0, "plane": PLANE, "ground": GROUND, "rail": RAIL, "rail_head": HEAD}])


def frames_geometry(spark: SparkSession, d: str) -> DataFrame:
    """A geometry row for every scan, its numbers as literals."""
    g = the_geometry(spark).drop("frame")
    same = F.from_json(F.lit(json.dumps(g.first().asDict(recursive=True))), g.schema)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"), same.alias("g")).select("frame", "g.*")


def _piecewise(xs: list[float], ys: list[float]) -> str:
    """SQL for linear interpolation, clamped at both ends."""
    parts = [f"WHEN x < {xs[0]!r} THEN {ys[0]!r}::DOUBLE"]
    for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=True), strict=False):
        parts.append(f"WHEN x < {x1!r} THEN {y0!r}::DOUBLE + (({y1!r}::DOUBLE - {y0!r}::DOUBLE) / ({x1!r}::DOUBLE - {x0!r}::DOUBLE)) * (x - {x0!r}::DOUBLE)")
    return "(CASE " + " ".join(parts) + f" ELSE {ys[-1]!r}::DOUBLE END)"


def _reach(xs: list[float]) -> str:
    return "least(" + ", ".join(f"abs({x!r}::DOUBLE - x)" for x in xs) + ")"


def _beyond(e: tuple[float, ...]) -> tuple[str, str]:
    dd = f"(x - {e[0]!r}::DOUBLE)"
    return f"({e[1]!r}::DOUBLE + {e[2]!r}::DOUBLE * {dd} + {e[3]!r}::DOUBLE * {dd} * {dd})", f"greatest({dd} * {dd} * {e[4]!r}::DOUBLE + {dd} * {dd} * {dd} * {dd} * {e[5]!r}::DOUBLE + 2 * {dd} * {dd} * {dd} * {e[6]!r}::DOUBLE, 0)"


def _widths(lo: str, hi: str, pick: str) -> str:
    cases = []
    for b, t, wb, wt in LIMITS.envelope:
        at = lambda h: f"({wb!r}::DOUBLE + {(wt - wb) / (t - b)!r}::DOUBLE * ({h} - {b!r}::DOUBLE))"  # noqa: B023, E731
        cases.append(f"CASE WHEN {hi} >= {b!r} AND {lo} <= {t!r} THEN {pick}({at(f'greatest({lo}, {b!r}::DOUBLE)')}, {at(f'least({hi}, {t!r}::DOUBLE)')}) END")
    return f"{pick}({', '.join(cases)})"


_GX, _RX = [g[0] for g in GROUND], [r[0] for r in RAIL]
_A, _B, _C = PLANE
_L = LIMITS
_BASE = f"(0.06::DOUBLE + 0.008::DOUBLE * pr + 0.0003::DOUBLE * pr * pr)"
CLASSIFIED = f"""
 q1 AS (SELECT *, {_piecewise(_GX, [g[1] for g in GROUND])} AS shift, {_reach(_GX)} AS gr, {_piecewise(_GX, [g[2] for g in GROUND])} AS spread, {_reach(_RX)} AS pr, {_piecewise(_RX, [r[2] for r in RAIL])} AS gauge FROM p),
 q2 AS (SELECT *, CASE WHEN gr <= {_L.ground_max_extrapolation} THEN spread + 0.008::DOUBLE * gr END AS ug,
   CASE WHEN x < {NEAR[0]!r} THEN {_beyond(NEAR)[0]} WHEN x > {FAR[0]!r} THEN {_beyond(FAR)[0]} ELSE {_piecewise(_RX, [r[1] for r in RAIL])} END AS centre,
   CASE WHEN pr <= {_L.path_max_extrapolation} THEN CASE WHEN x < {NEAR[0]!r} THEN sqrt({_BASE} * {_BASE} + {_beyond(NEAR)[1]}) WHEN x > {FAR[0]!r} THEN sqrt({_BASE} * {_BASE} + {_beyond(FAR)[1]}) ELSE {_BASE} END END AS up FROM q1),
 q3 AS (SELECT *, z - ({_A!r}::DOUBLE * x + {_B!r}::DOUBLE * y + {_C!r}::DOUBLE + shift) AS height, sqrt(1 + {_A!r}::DOUBLE * {_A!r}::DOUBLE + {_B!r}::DOUBLE * {_B!r}::DOUBLE) AS normal, sqrt(1 + {_B!r}::DOUBLE * {_B!r}::DOUBLE) AS ls, y - centre AS dy FROM q2),
 q4 AS (SELECT *, (height - {HEAD!r}::DOUBLE) / normal AS running, (dy + {_B!r}::DOUBLE * ((height - {HEAD!r}::DOUBLE) + {_B!r}::DOUBLE * dy)) / ls AS lat, ug / normal AS u, up * ls + abs({_B!r}::DOUBLE) * ug / ls AS ulat,
   coalesce(ug <= {_L.ground_max_uncertainty}, false) AND coalesce(up <= {_L.path_max_uncertainty}, false) AS observed, coalesce(up <= {_L.path_max_uncertainty}, false) AS path_ok FROM q3),
 q5 AS (SELECT *, observed AND abs(abs(lat) - gauge / 2) < {_L.rail_half_width} AND running <= {_L.rail_vertical_margin} AS on_rail, running - u AS lo, running + u AS hi FROM q4),
 q6 AS (SELECT *, observed AND NOT on_rail AND coalesce(lo >= 0 AND hi <= 4.2 AND abs(lat) + ulat <= {_widths('lo', 'hi', 'least')} + {_L.margin}::DOUBLE, false) AS core,
   observed AND NOT on_rail AND coalesce(abs(lat) - ulat <= {_widths('lo', 'hi', 'greatest')} + {_L.margin}::DOUBLE, false) AS touch,
   NOT on_rail AND coalesce(abs(lat) <= {_widths('running', 'running', 'greatest')} + {_L.margin}::DOUBLE, false) AS overlap,
   running BETWEEN {_L.min_running_height} AND 4.5 AND NOT on_rail AND (abs(lat) <= {_L.segmentation_half_width} OR NOT path_ok) AS context FROM q5)"""


@query(
    "classify", "FIL-12 GEO-3 GEO-6 JOIN-18",
    f"""WITH {RAW}, {CLASSIFIED} SELECT frame, count(*) AS n, count(*) FILTER (WHERE observed) AS observed, count(*) FILTER (WHERE core) AS core, count(*) FILTER (WHERE touch AND NOT core) AS boundary,
    count(*) FILTER (WHERE overlap) AS overlap, count(*) FILTER (WHERE context) AS context, round(min(running), 6) AS lowest, round(max(abs(lat)), 6) AS widest FROM q6 GROUP BY frame""",
)
def classify(spark: SparkSession, d: str) -> DataFrame:
    c = geo.classify(raw_points(spark, d), frames_geometry(spark, d), LIMITS)
    return c.groupBy("frame").agg(
        F.count("*").alias("n"), *[F.count_if(m).alias(m) for m in ("observed", "core", "boundary", "overlap", "context")], F.round(F.min("running"), 6).alias("lowest"), F.round(F.max(F.abs("lateral")), 6).alias("widest")
    )


@query("interp", "JOIN-18 GEO-3", f"WITH {RAW} SELECT frame, ring, round(min({_piecewise(_GX, [g[1] for g in GROUND])}), 6) AS least, round(max({_piecewise(_GX, [g[1] for g in GROUND])}), 6) AS most, round(max({_reach(_GX)}), 6) AS reach FROM p GROUP BY frame, ring")
def interp(spark: SparkSession, d: str) -> DataFrame:
    anchors = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(s).alias("shift")) for x, s, _ in GROUND])
    v = fn.interpolate(F.col("x"), anchors, "x", "shift")
    return raw_points(spark, d).groupBy("frame", "ring").agg(F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"), F.round(F.max(geo.reach(F.col("x"), fn.bracket(F.col("x"), anchors, "x"))), 6).alias("reach"))


@query(
    "ray_box", "GEN-1 GEN-3",
    f"""WITH {RAW}, t AS (SELECT frame, ring, x, y, z, greatest(least(30 / x, 40 / x), least(-1 / nullif(y, 0), 1 / nullif(y, 0)), least(0.5 / z, 3 / z)) AS near, least(greatest(30 / x, 40 / x), greatest(-1 / nullif(y, 0), 1 / nullif(y, 0)), greatest(0.5 / z, 3 / z)) AS far FROM p)
    SELECT frame, count(*) AS rays, count(*) FILTER (WHERE far >= near AND far > 0) AS hits, round(min(near) FILTER (WHERE far >= near AND far > 0), 6) AS nearest FROM t GROUP BY frame""",
)
def ray_box(spark: SparkSession, d: str) -> DataFrame:
    """Rays from the origin along each return against one box, by the slab test."""
    zero = F.lit(0.0)
    t = fn.ray_box([zero] * 3, [F.col(c) for c in "xyz"], [F.lit(30.0), F.lit(-1.0), F.lit(0.5)], [F.lit(40.0), F.lit(1.0), F.lit(3.0)])
    return raw_points(spark, d).groupBy("frame").agg(F.count("*").alias("rays"), F.count(t).alias("hits"), F.round(F.min(t), 6).alias("nearest"))


@query(
    "ray_cylinder", "GEN-2",
    f"""WITH {RAW}, w(side, radius) AS (VALUES ('inner', 297.4::DOUBLE), ('outer', 302.6::DOUBLE)), q AS (SELECT frame, side, radius, y * 300 AS m, x * x + y * y AS k FROM p, w),
    t AS (SELECT frame, side, k, m, CASE WHEN m * m - k * (90000 - radius * radius) >= 0 THEN sqrt(m * m - k * (90000 - radius * radius)) END AS h FROM q),
    u AS (SELECT frame, side, CASE WHEN m - h > 0 THEN (m - h) / nullif(k, 0) WHEN m + h > 0 THEN (m + h) / nullif(k, 0) END AS t FROM t)
    SELECT frame, side, count(*) AS rays, count(t) AS hits, round(min(t), 6) AS nearest FROM u GROUP BY frame, side""",
)
def ray_cylinder(spark: SparkSession, d: str) -> DataFrame:
    """Rays from the origin along each return against both walls of a tunnel on a circle of 300."""
    walls = {"inner": 297.4, "outer": 302.6}
    hit = F.array(*[F.struct(F.lit(s).alias("side"), F.try_element_at(fn.ray_cylinder(F.col("x"), F.col("y"), 300.0, r), F.lit(1)).alias("t")) for s, r in walls.items()])
    return raw_points(spark, d).select("frame", F.explode(hit).alias("w")).groupBy("frame", "w.side").agg(F.count("*").alias("rays"), F.count("w.t").alias("hits"), F.round(F.min("w.t"), 6).alias("nearest"))


POSE = [[0.8, -0.6, 0.0, 10.0], [0.6, 0.8, 0.0, -2.0], [0.0, 0.0, 1.0, 0.5], [0.0, 0.0, 0.0, 1.0]]


@query("transform", "MAP-1", f"WITH {RAW}, t AS (SELECT frame, x * 0.8::DOUBLE + y * (-0.6)::DOUBLE + z * 0 + 10 AS u, x * 0.6::DOUBLE + y * 0.8::DOUBLE + z * 0 - 2 AS v, z + 0.5 AS w FROM p) SELECT frame, round(min(u), 6) AS min_u, round(max(v), 6) AS max_v, round(max(w), 6) AS max_w FROM t GROUP BY frame")
def transform(spark: SparkSession, d: str) -> DataFrame:
    u, v, w = fn.rigid([F.col(c) for c in "xyz"], POSE)
    return raw_points(spark, d).groupBy("frame").agg(F.round(F.min(u), 6).alias("min_u"), F.round(F.max(v), 6).alias("max_v"), F.round(F.max(w), 6).alias("max_w"))


@query(
    "structure_distance", "OBJ-2 JOIN-11",
    """WITH p AS (SELECT l_suppkey AS frame, l_linenumber AS ring, l_extendedprice / 1000 AS x, (l_discount - 0.05) * 40 AS y, l_quantity / 10 AS z FROM lineitem)
    SELECT a.frame, a.ring, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 6) AS distance
    FROM p a JOIN p b ON a.frame = b.frame AND abs(a.y) < 1 AND abs(b.y) >= 1.6 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1 GROUP BY a.frame, a.ring""",
)
def structure_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance from each object's evidence to structure, exact within the isolation box; null (absent) means none that near."""
    from ..operators.spatial import neighbour_pairs

    p = points(spark, d)
    pairs = neighbour_pairs(p.where(F.abs("y") < 1).select("frame", "ring", "x", "y", "z"), p.where(F.abs("y") >= 1.6).select("frame", "x", "y", "z"), 1.0)
    return pairs.groupBy("frame", F.col("a_ring").alias("ring")).agg(F.round(F.sqrt(F.min("d2")), 6).alias("distance"))


@query(
    "object_script", "GEN-4",
    "SELECT event_id AS frame, CASE user_id % 3 WHEN 0 THEN 60 - 0.01::DOUBLE * event_id WHEN 1 THEN greatest(20, 60 - 0.02::DOUBLE * event_id) ELSE CASE WHEN event_id >= 500 THEN 30 END END::DOUBLE AS x, CASE user_id % 3 WHEN 0 THEN 'approaching' WHEN 1 THEN 'stopping' ELSE 'appearing' END AS script FROM events",
)
def object_script(spark: SparkSession, d: str) -> DataFrame:
    """Where a scripted object stands in each frame; null before it appears."""
    e = table(spark, d, "events")
    kind, f = F.col("user_id") % 3, F.col("event_id")
    x = F.when(kind == 0, 60 - F.lit(0.01) * f).when(kind == 1, F.greatest(F.lit(20.0), 60 - F.lit(0.02) * f)).when(f >= 500, F.lit(30.0))
    return e.select(f.alias("frame"), x.alias("x"), F.when(kind == 0, "approaching").when(kind == 1, "stopping").otherwise("appearing").alias("script"))
