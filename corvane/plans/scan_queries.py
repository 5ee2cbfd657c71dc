"""Candidates, surfaces, normals and agreement of consecutive scans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as cd
from ..operators import geometry as geo
from ..operators import registration as rg
from ..operators import spatial as sp
from ..sources.tables import POINTS_SQL, points, raw_points
from .geometry_queries import CLASSIFIED, LIMITS, RAW, frames_geometry
from .registry import query
from .spatial_queries import COMPONENT_SQL, DIST, graph

COMPACT = cd.CompactParams(3, (0.2, 6.0), 0.73, 40.0, 92.0, 9.0, 40)


def members(spark: SparkSession, d: str) -> DataFrame:
    p, e = graph(spark, d)
    return sp.components(p, e, carried=sp.XYZ).select("frame", "point_id", "label", "x", "y", "z", (F.abs("y") < 1.2).alias("inside"))


MEMBERS_SQL = f"""{POINTS_SQL}, {COMPONENT_SQL}, l AS (SELECT frame, dense_rank() OVER (PARTITION BY frame ORDER BY root) - 1 AS label, x, y, z, abs(y) < 1.2 AS inside FROM p JOIN m USING (frame, point_id)),
 g AS (SELECT frame, label, count(*) AS members, count(*) FILTER (WHERE inside) AS n_inside, min(x) FILTER (WHERE inside) AS distance, max(x) FILTER (WHERE inside) - min(x) FILTER (WHERE inside) AS length,
   max(z) FILTER (WHERE inside) - min(z) FILTER (WHERE inside) AS height, median(y) FILTER (WHERE inside) AS at_y, median(z) FILTER (WHERE inside) AS at_z FROM l GROUP BY frame, label
   HAVING count(*) FILTER (WHERE inside) >= 3 AND max(z) FILTER (WHERE inside) - min(z) FILTER (WHERE inside) BETWEEN 0.2 AND 6.0),
 o AS (SELECT g.frame, g.label, l.x, l.x - lag(l.x) OVER (PARTITION BY g.frame, g.label ORDER BY l.x) AS step FROM g JOIN l ON l.frame = g.frame AND l.inside AND abs(l.y - at_y) < 0.73 AND abs(l.z - at_z) < 0.73),
 v AS (SELECT frame, label, max(x) - min(x) AS coverage, count(*) FILTER (WHERE step > 40.0) AS repeats FROM o GROUP BY frame, label),
 k AS (SELECT g.*, coalesce(coverage, 0) AS coverage, coalesce(repeats, 0) AS repeats FROM g LEFT JOIN v USING (frame, label))"""
FLAGS_SQL = "length > 9.0 AS long, members > 40 AS attached, coverage > 92.0 AS continuous, repeats >= 1 AND coverage > 46.0 AS periodic"


@query("structure_profile", "SEG-8", f"WITH RECURSIVE {MEMBERS_SQL} SELECT frame, label, members, n_inside, round(distance, 6) AS distance, round(coverage, 6) AS coverage, repeats, {FLAGS_SQL} FROM k")
def structure_profile(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with what continues or repeats on their profile along the track."""
    c = cd.clusters(members(spark, d), COMPACT)
    return c.select("frame", "label", "members", "n_inside", F.round("distance", 6).alias("distance"), F.round("coverage", 6).alias("coverage"), "repeats", "long", "attached", "continuous", "periodic")


@query("track_candidates", "FIL-16 SEG-8 SRT-2", f"WITH RECURSIVE {MEMBERS_SQL}, f AS (SELECT *, {FLAGS_SQL} FROM k) SELECT frame, label, round(distance, 6) AS distance FROM f WHERE NOT (long OR attached OR continuous OR periodic)")
def track_candidates(spark: SparkSession, d: str) -> DataFrame:
    return cd.compact(cd.clusters(members(spark, d), COMPACT)).select("frame", "label", F.round("distance", 6).alias("distance"))


@query("surface_split", "SEG-2 SEG-6")
def surface_split(spark: SparkSession, d: str) -> DataFrame:
    """Components whose bodies stand apart on the bed, split: the parts' sizes."""
    p, e = graph(spark, d)
    labelled = sp.components(p, e).join(p, ["frame", "point_id"]).withColumn("height", F.col("z"))
    parts = cd.split_surface(labelled, e, cd.SurfaceParams(0.8, 3, 0.3, 1.6))
    return parts.groupBy("frame", "label", "part").agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"))


_COV = ", ".join(f"avg(d{a} * d{b}) - avg(d{a}) * avg(d{b}) AS {a}{b}" for a, b in rg.AXES)
_SUMS = ", ".join(f"round(sum({a}), 4) AS {a}" for a in rg.AXES)
COVARIANCE_SQL = f"""b AS (SELECT a.frame, a.point_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, row_number() OVER (PARTITION BY a.frame, a.point_id ORDER BY {DIST}, b.point_id) AS rank
   FROM p a JOIN p b ON a.frame = b.frame AND {DIST} <= 4.0)"""


@query("covariances", "JOIN-16", f"WITH {POINTS_SQL}, {COVARIANCE_SQL}, c AS (SELECT frame, point_id, count(*) AS n, {_COV} FROM b WHERE rank <= 12 GROUP BY frame, point_id) SELECT frame, count(*) AS points, sum(n)::BIGINT AS neighbours, {_SUMS} FROM c GROUP BY frame")
def covariances(spark: SparkSession, d: str) -> DataFrame:
    """The covariances of each point's neighbours, summed over a scan."""
    c = rg.covariances(points(spark, d), 2.0, 12)
    return c.groupBy("frame").agg(F.count("*").alias("points"), F.sum("n").alias("neighbours"), *[F.round(F.sum(a), 4).alias(a) for a in rg.AXES])


@query("normals", "JOIN-16 GEO-9")
def normals(spark: SparkSession, d: str) -> DataFrame:
    """Normals of points whose neighbourhood is flat, and the axes that a scan's normals leave weak."""
    n = rg.normals(rg.covariances(points(spark, d), 2.0, 12), least=4)
    return rg.weak_axes(n.where("planarity > 0.5"), 0.2).select("frame", F.transform("information", lambda v: F.round(v, 6)).alias("information"), F.array_join("weak", "").alias("weak"))


@query(
    "registration_quality", "STR-7",
    f"""WITH {POINTS_SQL}, s AS (SELECT frame AS f, point_id AS i, x AS sx, y AS sy, z AS sz FROM p),
    n AS (SELECT f, i, min((sx - x) * (sx - x) + (sy - y) * (sy - y) + (sz - z) * (sz - z)) AS d2 FROM s JOIN p ON p.frame = f - 1 GROUP BY f, i),
    k AS (SELECT f, count(*) AS met, median(sqrt(d2)) AS residual FROM n WHERE d2 <= 4.0 GROUP BY f), c AS (SELECT f, count(*) AS n FROM s GROUP BY f)
    SELECT f AS frame, n, round(coalesce(met, 0) / n, 6) AS overlap, round(residual, 6) AS residual FROM c LEFT JOIN k USING (f)""",
)
def registration_quality(spark: SparkSession, d: str) -> DataFrame:
    """Each scan against the one before it."""
    p = points(spark, d)
    before = p.withColumn("frame", F.col("frame") + 1)
    return rg.registration_quality(p, before, 1.0).select("frame", "n", F.round("overlap", 6).alias("overlap"), F.round("residual", 6).alias("residual"))


_OVERLAP = "t.track = s.track AND t.frame = s.frame {} AND (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z) <= 6.25"


@query(
    "shape_recurrence", "STR-11 JOIN-15",
    f"""WITH {POINTS_SQL}, s AS (SELECT ring AS track, frame, point_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM p WHERE x < 40 WINDOW w AS (PARTITION BY ring, frame)),
    n AS (SELECT track, frame, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s t WHERE {_OVERLAP.format('- 1')})) AS fwd, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s t WHERE {_OVERLAP.format('+ 1')})) AS bwd FROM s GROUP BY track, frame),
    o AS (SELECT a.track, a.frame, CASE WHEN b.n > 0 THEN least(a.fwd / a.n, b.bwd / b.n) END AS overlap FROM n a LEFT JOIN n b ON b.track = a.track AND b.frame = a.frame - 1),
    r AS (SELECT *, sum(CASE WHEN overlap >= 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY frame) AS run FROM o)
    SELECT track, frame, round(overlap, 6) AS overlap, least(row_number() OVER (PARTITION BY track, run ORDER BY frame), 5)::INTEGER AS hits FROM r""",
)
def shape_recurrence(spark: SparkSession, d: str) -> DataFrame:
    s = points(spark, d).where("x < 40").withColumnRenamed("ring", "track")
    return rg.shape_recurrence(s, 2.5, 0.6, 5).select("track", "frame", F.round("overlap", 6).alias("overlap"), "hits")


@query(
    "far_field_bound", "OBJ-3",
    f"WITH {RAW.replace('p AS', 'a AS', 1)}, p AS (SELECT frame, 0 AS ring, min(x) AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM a WHERE z > 1 AND abs(y) < 1 GROUP BY frame), {CLASSIFIED} SELECT frame, x AS distance, round(up, 6) AS bound FROM q3",
)
def far_field_bound(spark: SparkSession, d: str) -> DataFrame:
    """The path's uncertainty at each scan's nearest object, null beyond what the anchors reach."""
    near = raw_points(spark, d).where((F.col("z") > 1) & (F.abs("y") < 1)).groupBy("frame").agg(F.min("x").alias("distance"))
    return geo.far_field_bounds(near, frames_geometry(spark, d), LIMITS).select("frame", "distance", F.round("bound", 6).alias("bound"))
