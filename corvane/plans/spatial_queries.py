"""Per-scan spatial queries over the point view, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as fn
from ..operators import spatial as sp
from ..sources.tables import POINTS_SQL, points, raw_points, table
from .registry import query

RAW = "p AS (SELECT l_suppkey AS frame, l_linenumber AS ring, l_extendedprice / 1000 AS x, (l_discount - 0.05) * 40 AS y, l_quantity / 10 AS z FROM lineitem)"
RANGE = "sqrt(x * x + y * y + z * z)"
VOXEL = 2.0
CELLS = "floor(x / 2.0)::BIGINT AS kx, floor(y / 2.0)::BIGINT AS ky, floor(z / 2.0)::BIGINT AS kz"


def summary(df: DataFrame) -> DataFrame:
    """Counts and bounds of each frame's points."""
    return df.groupBy("frame").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.max("z").alias("max_z"))


SUMMARY = "SELECT frame, count(*) AS n, min(x) AS min_x, max(x) AS max_x, max(z) AS max_z FROM {} GROUP BY frame"


@query("range_band_closed", "FIL-1", f"WITH {RAW} {SUMMARY.format(f'p WHERE {RANGE} BETWEEN 10 AND 40')}")
def range_band_closed(spark: SparkSession, d: str) -> DataFrame:
    return summary(sp.radial_band(raw_points(spark, d), 10.0, 40.0))


@query("range_band_open", "FIL-2", f"WITH {RAW} {SUMMARY.format(f'p WHERE {RANGE} > 10 AND {RANGE} < 40')}")
def range_band_open(spark: SparkSession, d: str) -> DataFrame:
    return summary(sp.radial_band(raw_points(spark, d), 10.0, 40.0, closed=False))


@query("crop", "FIL-3", f"WITH {RAW} {SUMMARY.format('p WHERE x >= 5 AND abs(y) < 1.2')}")
def crop(spark: SparkSession, d: str) -> DataFrame:
    return summary(sp.crop(raw_points(spark, d), 5.0, 1.2))


@query("usable_points", "FIL-4", f"WITH {RAW} {SUMMARY.format('p WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND x * x + y * y + z * z > 1e-6')}")
def usable_points(spark: SparkSession, d: str) -> DataFrame:
    return summary(sp.usable(raw_points(spark, d)))


@query("attribute_validity", "FIL-5", f"WITH {RAW} SELECT frame, count(*) FILTER (WHERE ring >= 0) AS ring_valid, count(*) FILTER (WHERE isfinite(z)) AS intensity_valid, count(*) AS slots FROM p GROUP BY frame")
def attribute_validity(spark: SparkSession, d: str) -> DataFrame:
    p = raw_points(spark, d)
    return p.groupBy("frame").agg(F.count_if(F.col("ring").isNotNull() & (F.col("ring") >= 0)).alias("ring_valid"), F.count_if(fn.finite(F.col("z"))).alias("intensity_valid"), F.count("*").alias("slots"))


@query("box_filter", "FIL-6", f"WITH {RAW} {SUMMARY.format('p WHERE x BETWEEN 20 AND 50 AND y BETWEEN -1 AND 1 AND z BETWEEN 1 AND 3')}")
def box_filter(spark: SparkSession, d: str) -> DataFrame:
    return summary(raw_points(spark, d).where(sp.in_box((20.0, -1.0, 1.0), (50.0, 1.0, 3.0))))


@query(
    "oriented_box_filter", "FIL-7",
    f"""WITH {RAW}, t AS (SELECT *, 0.8 * (x - 40) + 0.6 * y AS u, -0.6 * (x - 40) + 0.8 * y AS v FROM p)
    SELECT frame, count(*) AS n, min(x) AS min_x, max(x) AS max_x, max(z) AS max_z FROM t WHERE abs(u) <= 10 AND abs(v) <= 5 AND abs(z - 2) <= 1.5 GROUP BY frame""",
)
def oriented_box_filter(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1.0)
    rotation = [[F.lit(0.8), F.lit(-0.6), F.lit(0.0)], [F.lit(0.6), F.lit(0.8), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), one]]
    inside = fn.in_oriented_box([F.col(c) for c in sp.XYZ], [F.lit(40.0), F.lit(0.0), F.lit(2.0)], [F.lit(20.0), F.lit(10.0), F.lit(3.0)], rotation)
    return summary(raw_points(spark, d).where(inside))


PATCHES = [(0, 0.0, 45.0, 1.5), (1, 30.0, 75.0, 2.5), (2, 60.0, 105.0, 3.5)]
PATCH_SQL = "g(patch, x0, x1, z0) AS (VALUES " + ", ".join(str(p) for p in PATCHES) + ")"


def patches(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PATCHES, "patch int, x0 double, x1 double, z0 double"))  # a fixed list


@query(
    "plane_band_candidates", "FIL-8 SET-4",
    f"WITH {POINTS_SQL}, {PATCH_SQL}, c AS (SELECT DISTINCT frame, point_id FROM p JOIN g ON x BETWEEN x0 AND x1 AND abs(z - z0) <= 0.15) SELECT frame, count(*) AS masked, min(point_id) AS first_id FROM c GROUP BY frame",
)
def plane_band_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Points in the band of any patch's plane within its x-window; the union doesn't depend on the patches' order."""
    hit = points(spark, d).join(patches(spark), F.col("x").between(F.col("x0"), F.col("x1")) & (F.abs(F.col("z") - F.col("z0")) <= 0.15))
    return hit.select("frame", "point_id").distinct().groupBy("frame").agg(F.count("*").alias("masked"), F.min("point_id").alias("first_id"))


@query("strip_inside", "FIL-9", f"WITH {RAW} SELECT frame, count(*) FILTER (WHERE (x BETWEEN 9.9 AND 20.1 AND y BETWEEN -1.1 AND 0.1) OR (x BETWEEN 49.9 AND 60.1 AND y BETWEEN 0.4 AND 1.6)) AS inside, count(*) AS n FROM p GROUP BY frame")
def strip_inside(spark: SparkSession, d: str) -> DataFrame:
    strips = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "x1", "t0", "t1"), s, strict=True)]) for s in ((10.0, 20.0, -1.0, 0.0), (50.0, 60.0, 0.5, 1.5))])
    m = 0.1
    ok = F.exists(strips, lambda s: F.col("x").between(s.x0 - m, s.x1 + m) & F.col("y").between(s.t0 - m, s.t1 + m))
    return raw_points(spark, d).groupBy("frame").agg(F.count_if(ok).alias("inside"), F.count("*").alias("n"))


@query(
    "protruding_points", "FIL-10",
    f"WITH {RAW}, {PATCH_SQL} SELECT frame, patch, count(*) AS n FROM p JOIN g ON x BETWEEN x0 AND x1 AND z - z0 BETWEEN 0.3 AND 1.0 AND abs(y) / sqrt(x * x + y * y) < 0.05 GROUP BY frame, patch",
)
def protruding_points(spark: SparkSession, d: str) -> DataFrame:
    """Samples that stand out of a patch by [depth, radius] and whose direction deviates from it (cosine below the alignment)."""
    above = (F.col("z") - F.col("z0")).between(0.3, 1.0)
    cosine = F.abs("y") / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return raw_points(spark, d).join(patches(spark), F.col("x").between(F.col("x0"), F.col("x1")) & above & (cosine < 0.05)).groupBy("frame", "patch").agg(F.count("*").alias("n"))


@query("remove_rows", "FIL-11", f"WITH {POINTS_SQL} {SUMMARY.format('p WHERE point_id % 7 <> 3')}")
def remove_rows(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    gone = p.where("point_id % 7 = 3").select("frame", "point_id")
    return summary(p.join(gone, ["frame", "point_id"], "left_anti"))


@query(
    "scene_regions", "FIL-17",
    f"""WITH {RAW}, q AS (SELECT frame, CASE WHEN abs(abs(y) - 0.76) <= 0.06 AND z <= 0.5 THEN 'rail' WHEN z <= 0.5 THEN 'floor' WHEN abs(y) >= 1.6 THEN 'wall'
    WHEN z >= 4.5 THEN 'ceiling' ELSE 'interior' END AS region FROM p) SELECT frame, region, count(*) AS n FROM q GROUP BY frame, region""",
)
def scene_regions(spark: SparkSession, d: str) -> DataFrame:
    region = F.when((F.abs(F.abs("y") - 0.76) <= 0.06) & (F.col("z") <= 0.5), "rail").when(F.col("z") <= 0.5, "floor").when(F.abs("y") >= 1.6, "wall").when(F.col("z") >= 4.5, "ceiling").otherwise("interior")
    return raw_points(spark, d).groupBy("frame", region.alias("region")).agg(F.count("*").alias("n"))


@query(
    "voxel_first", "AGG-1 AGG-2",
    f"""WITH {POINTS_SQL}, c AS (SELECT *, {CELLS} FROM p WHERE x >= 5 AND abs(y) < 1.9),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY frame, kx, ky, kz ORDER BY point_id) = 1)
    SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY kx, ky, kz) AS reduced_id, kx, ky, kz, point_id, ring, x, y, z FROM f""",
)
def voxel_first(spark: SparkSession, d: str) -> DataFrame:
    return sp.voxel_first(sp.crop(points(spark, d), 5.0, 1.9), VOXEL)


@query("voxel_count", "AGG-3", f"WITH {RAW}, c AS (SELECT DISTINCT frame, ring, {CELLS} FROM p) SELECT frame, ring, count(*) AS voxels FROM c GROUP BY frame, ring")
def voxel_count(spark: SparkSession, d: str) -> DataFrame:
    return sp.voxel_count(raw_points(spark, d), VOXEL, ("frame", "ring"))


@query("voxel_centroid", "AGG-4", f"WITH {RAW}, c AS (SELECT *, {CELLS} FROM p) SELECT frame, kx, ky, kz, count(*) AS n, round(avg(x), 11) + 0.0 AS mean_x, round(avg(y), 11) + 0.0 AS mean_y, round(avg(z), 11) + 0.0 AS mean_z FROM c GROUP BY frame, kx, ky, kz")
def voxel_centroid(spark: SparkSession, d: str) -> DataFrame:
    return sp.voxel_centroid(raw_points(spark, d), VOXEL)


EDGES = [0.0, 20.0, 40.0, 60.0, 80.0, 120.0]


@query(
    "range_bins", "AGG-7",
    f"""WITH {RAW}, e(bin, lo, hi) AS (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))}),
    f AS (SELECT DISTINCT frame FROM p) SELECT f.frame, e.bin, count(p.x) AS returns, count(*) FILTER (WHERE p.z < 2.5) AS supported
    FROM f CROSS JOIN e LEFT JOIN p ON p.frame = f.frame AND p.x >= lo AND p.x < hi GROUP BY f.frame, e.bin""",
)
def range_bins(spark: SparkSession, d: str) -> DataFrame:
    return sp.range_bins(raw_points(spark, d), EDGES, F.col("z") < 2.5)


@query("grouped_median", "AGG-8", f"WITH {RAW} SELECT frame, floor(x / 5.0)::BIGINT AS bin, round(median(x), 6) + 0.0 AS med_x, round(median(y), 6) + 0.0 AS med_y FROM p GROUP BY ALL")
def grouped_median(spark: SparkSession, d: str) -> DataFrame:
    return raw_points(spark, d).groupBy("frame", fn.cell("x", 5.0).alias("bin")).agg((F.round(F.median("x"), 6) + 0.0).alias("med_x"), (F.round(F.median("y"), 6) + 0.0).alias("med_y"))


@query(
    "window_spread", "AGG-9",
    f"""WITH {RAW}, w AS (SELECT frame, floor(x / 10.0)::BIGINT AS w, z, median(z) OVER (PARTITION BY frame, floor(x / 10.0)) AS m FROM p)
    SELECT frame, w, count(*) AS n, round(any_value(m), 6) AS med, round(greatest(1.4826 * median(abs(z - m)), 0.015), 6) AS spread FROM w GROUP BY frame, w""",
)
def window_spread(spark: SparkSession, d: str) -> DataFrame:
    """Median and scaled MAD (at least 15 mm) of heights per x-window."""
    w = raw_points(spark, d).groupBy("frame", fn.cell("x", 10.0).alias("w")).agg(F.collect_list("z").alias("zs"))
    return w.select("frame", "w", F.size("zs").cast("long").alias("n"), F.round(fn.array_median(F.col("zs")), 6).alias("med"), F.round(fn.scaled_mad(F.col("zs"), 0.015), 6).alias("spread"))


@query(
    "strips", "AGG-10",
    f"""WITH {RAW} SELECT frame, floor(x / 4.0)::BIGINT AS strip, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z
    FROM p GROUP BY ALL HAVING count(*) >= 8 AND max(y) - min(y) >= 2.0""",
)
def strips(spark: SparkSession, d: str) -> DataFrame:
    return sp.support_strips(raw_points(spark, d), 4.0, 8, 2.0)


@query("cell_support", "AGG-11", f"WITH {RAW} SELECT frame, floor(y / 0.4)::BIGINT AS col, floor(z / 0.4)::BIGINT AS row, max(floor(x / 1.0)::BIGINT) - min(floor(x / 1.0)::BIGINT) AS span, count(*) AS returns FROM p GROUP BY ALL")
def cell_support(spark: SparkSession, d: str) -> DataFrame:
    return sp.cell_support(raw_points(spark, d), 0.4, 1.0)


@query("histogram", "AGG-12", f"WITH {RAW} SELECT frame, (CASE WHEN z = 5 THEN 19 ELSE floor((z - 0) / 0.25) END)::INTEGER AS bin, count(*) AS n FROM p WHERE z BETWEEN 0 AND 5 GROUP BY ALL")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return sp.histogram(raw_points(spark, d), "z", 0.0, 5.0, 20, ("frame",))


@query(
    "nearest_return", "AGG-23",
    f"""WITH {POINTS_SQL}, r AS (SELECT *, {RANGE} AS range, floor(y / 0.4)::BIGINT * 1000 + floor(z / 0.5)::BIGINT AS dir FROM p)
    SELECT frame, point_id, dir, round(range, 6) AS range, round(min(range) OVER (PARTITION BY frame, dir), 6) AS nearest FROM r""",
)
def nearest_return(spark: SparkSession, d: str) -> DataFrame:
    r = sp.nearest_return(points(spark, d), fn.cell("y", 0.4) * 1000 + fn.cell("z", 0.5))
    return r.select("frame", "point_id", "dir", F.round("range", 6).alias("range"), F.round("nearest", 6).alias("nearest"))


@query(
    "ring_table", "AGG-24",
    f"""WITH {RAW}, e AS (SELECT frame, ring, z / sqrt(x * x + y * y) AS slope FROM p)
    SELECT frame, ring, count(*) AS n, round(median(slope), 6) AS med, round(quantile_cont(slope, 0.95) - quantile_cont(slope, 0.05), 6) AS spread FROM e GROUP BY frame, ring""",
)
def ring_table(spark: SparkSession, d: str) -> DataFrame:
    slope = F.col("z") / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    q = F.percentile(slope, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    t = raw_points(spark, d).groupBy("frame", "ring").agg(F.count("*").alias("n"), q.alias("q"))
    return t.select("frame", "ring", "n", F.round(F.col("q")[1], 6).alias("med"), F.round(F.col("q")[2] - F.col("q")[0], 6).alias("spread"))


@query(
    "coverage_gap", "AGG-24 WIN-15",
    f"""WITH {RAW}, a AS (SELECT DISTINCT frame, (abs(ring * 40 + floor(y * 10))::BIGINT + 3600) % 360 AS a FROM p),
    g AS (SELECT frame, coalesce(lead(a) OVER w, first_value(a) OVER w + 360) - a AS gap FROM a WINDOW w AS (PARTITION BY frame ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT frame, count(*) AS directions, (360 - max(gap))::BIGINT AS coverage FROM g GROUP BY frame""",
)
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    """Azimuth coverage: 360 less the largest circular gap between distinct directions."""
    a = raw_points(spark, d).select("frame", ((F.abs(F.col("ring") * 40 + F.floor(F.col("y") * 10)).cast("long") + 3600) % 360).alias("a")).distinct()
    w = W.partitionBy("frame").orderBy("a")
    gap = F.coalesce(F.lead("a").over(w), F.min("a").over(W.partitionBy("frame")) + 360) - F.col("a")
    return a.withColumn("gap", gap).groupBy("frame").agg(F.count("*").alias("directions"), (360 - F.max("gap")).alias("coverage"))


@query(
    "emission_multiplicity", "AGG-25",
    f"WITH {RAW}, c AS (SELECT frame, ring, z, count(*) AS slots FROM p GROUP BY ALL) SELECT slots, count(*) AS emissions FROM c GROUP BY slots",
)
def emission_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return raw_points(spark, d).groupBy("frame", "ring", "z").agg(F.count("*").alias("slots")).groupBy("slots").agg(F.count("*").alias("emissions"))


@query(
    "line_fit", "AGG-27",
    f"WITH {RAW} SELECT frame, count(*) AS n, round(regr_slope(z, x), 6) AS slope, round(regr_intercept(z, x), 5) AS intercept FROM p GROUP BY frame",
)
def line_fit(spark: SparkSession, d: str) -> DataFrame:
    return raw_points(spark, d).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.regr_slope("z", "x"), 6).alias("slope"), F.round(F.regr_intercept("z", "x"), 5).alias("intercept"))


@query(
    "sliding_windows", "JOIN-21",
    f"""WITH {RAW}, w AS (SELECT frame, x, z, unnest(range(floor((x - 20) / 10)::BIGINT + 1, floor(x / 10)::BIGINT + 1)) AS "window" FROM p)
    SELECT frame, "window", count(*) AS n, max(z) AS max_z FROM w WHERE x >= "window" * 10 AND x < "window" * 10 + 20 GROUP BY ALL""",
)
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return sp.sliding_windows(raw_points(spark, d), 20.0, 10.0).groupBy("frame", "window").agg(F.count("*").alias("n"), F.max("z").alias("max_z"))


# --- joins by distance -----------------------------------------------------------------------------------------------

DIST = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
R = "least(0.6 + 0.004 * sqrt(x * x + y * y + z * z), 1.0)"
EDGE_SQL = f"""n AS (SELECT frame, point_id, ring, x, y, z, {R} AS radius FROM p),
 e AS (SELECT a.frame, a.point_id AS src, b.point_id AS dst FROM n a JOIN n b ON a.frame = b.frame AND a.point_id < b.point_id
  AND {DIST} <= least(a.radius, b.radius) * least(a.radius, b.radius))"""


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points with their range-adaptive radius, and the mutual-radius edges."""
    p = points(spark, d).withColumn("radius", F.least(F.lit(0.6) + F.lit(0.004) * fn.norm(*map(F.col, sp.XYZ)), F.lit(1.0)))
    return p, sp.mutual_radius_edges(p, 1.0)


def checksum(edges: DataFrame) -> DataFrame:
    """Of each scan's edges: how many, and sums that hardly another set of edges has."""
    mixed = (F.col("src") * 31 + F.col("dst")) * (F.col("src") + 7) % 1000003
    return edges.groupBy("frame").agg(F.count("*").alias("edges"), F.sum("src").alias("src"), F.sum("dst").alias("dst"), F.sum(mixed).alias("mixed"))


CHECKSUM = "SELECT frame, count(*) AS edges, sum(src)::BIGINT AS src, sum(dst)::BIGINT AS dst, sum((src * 31 + dst) * (src + 7) % 1000003)::BIGINT AS mixed FROM {} GROUP BY frame"


@query("mutual_radius", "JOIN-13", f"WITH {POINTS_SQL}, {EDGE_SQL} {CHECKSUM.format('e')}")
def mutual_radius(spark: SparkSession, d: str) -> DataFrame:
    """The edges as counts and checksums of each scan."""
    return checksum(graph(spark, d)[1])


@query("fixed_radius", "JOIN-14", f"WITH {POINTS_SQL}, e AS (SELECT a.frame, a.point_id AS src, b.point_id AS dst FROM p a JOIN p b ON a.frame = b.frame AND a.point_id < b.point_id AND {DIST} <= 0.25) {CHECKSUM.format('e')}")
def fixed_radius(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    pairs = sp.neighbour_pairs(p.drop("ring"), p.drop("ring"), 0.5, once=True)
    return checksum(pairs.select("frame", F.least("a_point_id", "b_point_id").alias("src"), F.greatest("a_point_id", "b_point_id").alias("dst")))


@query("degrees", "SEG-5", f"WITH {POINTS_SQL}, {EDGE_SQL}, t AS (SELECT frame, src AS point_id FROM e UNION ALL SELECT frame, dst FROM e), c AS (SELECT frame, point_id, count(*) AS n FROM t GROUP BY ALL) SELECT frame, point_id, coalesce(n, 0) + 1 AS degree FROM p LEFT JOIN c USING (frame, point_id)")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    p, e = graph(spark, d)
    return sp.degrees(p, e)


@query("induced_subgraph", "SEG-4", f"WITH {POINTS_SQL}, {EDGE_SQL}, i AS (SELECT e.* FROM e JOIN p a ON a.frame = e.frame AND a.point_id = src AND a.ring <= 4 JOIN p b ON b.frame = e.frame AND b.point_id = dst AND b.ring <= 4) {CHECKSUM.format('i')}")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    p, e = graph(spark, d)
    return checksum(sp.induced(e, p.where("ring <= 4")))


COMPONENT_SQL = f"""{EDGE_SQL}, s AS (SELECT frame, src AS u, dst AS v FROM e UNION ALL SELECT frame, dst, src FROM e),
 c(frame, u, v) AS (SELECT frame, point_id, point_id FROM p UNION SELECT c.frame, c.u, s.v FROM c JOIN s ON s.frame = c.frame AND s.u = c.v),
 m AS (SELECT frame, u AS point_id, min(v) AS root FROM c GROUP BY ALL)"""


@query("components", "SEG-3", f"WITH RECURSIVE {POINTS_SQL}, {COMPONENT_SQL} SELECT frame, point_id, dense_rank() OVER (PARTITION BY frame ORDER BY root) - 1 AS label FROM m")
def components(spark: SparkSession, d: str) -> DataFrame:
    p, e = graph(spark, d)
    return sp.components(p, e)


@query(
    "component_stats", "AGG-5 SRT-1 OBJ-1",
    f"""WITH RECURSIVE {POINTS_SQL}, {COMPONENT_SQL}, l AS (SELECT p.*, root FROM p JOIN m USING (frame, point_id)),
    g AS (SELECT frame, root, count(*) AS size, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(z) - min(z) AS height, count(*) FILTER (WHERE abs(y) < 0.8) AS core,
      count(*) FILTER (WHERE abs(y) BETWEEN 0.8 AND 1.2) AS uncertain, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM l GROUP BY ALL),
    w AS (SELECT frame, root, point_id FROM l QUALIFY row_number() OVER (PARTITION BY frame, root ORDER BY x, point_id) = 1)
    SELECT g.frame, g.root AS component, size, min_x, max_x, min_y, max_y, height, core, uncertain, w.point_id AS witness,
      CASE WHEN size < 2 THEN 'below_weak_min' WHEN extent < 0.3 THEN 'below_min_extent' ELSE 'admitted' END AS admission,
      CASE WHEN core >= 2 THEN 'intersecting' WHEN uncertain >= 2 THEN 'unresolved' ELSE 'adjacent' END AS relation
    FROM g JOIN w USING (frame, root)""",
)
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    """Extents, evidence counts, admission, relation and witness of each component of the density graph."""
    from ..operators.objects import component_statistics

    p, e = graph(spark, d)
    labelled = sp.components(p, e, carried=sp.XYZ)
    s = component_statistics(labelled, core=F.abs("y") < 0.8, uncertain=F.abs("y").between(0.8, 1.2), weak_min=2, min_extent=0.3, claim_min=2)
    return s.select("frame", F.col("first_point").alias("component"), "size", "min_x", "max_x", "min_y", "max_y", "height", "core", "uncertain", "witness", "admission", "relation")


TARGETS = "ring = 1"


@query("radius_semi", "JOIN-15", f"WITH {POINTS_SQL} SELECT a.frame, a.point_id FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.frame = a.frame AND b.{TARGETS} AND {DIST} <= 1.0)")
def radius_semi(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return sp.radius_semi(p, p.where(TARGETS), 1.0).select("frame", "point_id")


@query(
    "nearest_neighbour", "JOIN-11",
    f"""WITH {POINTS_SQL} SELECT a.frame, a.point_id, b.point_id AS nearest_id, round({DIST}, 6) AS d2 FROM p a JOIN p b ON a.frame = b.frame AND a.ring = 2 AND b.ring = 3 AND {DIST} <= 4
    QUALIFY row_number() OVER (PARTITION BY a.frame, a.point_id ORDER BY {DIST}, b.point_id) = 1""",
)
def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return sp.nearest(p.where("ring = 2"), p.where("ring = 3"), 2.0).withColumn("d2", F.round("d2", 6))


@query(
    "knn", "JOIN-12 JOIN-16",
    f"""WITH {POINTS_SQL} SELECT a.frame, a.point_id, row_number() OVER (PARTITION BY a.frame, a.point_id ORDER BY {DIST}, b.point_id)::INTEGER AS rank, b.point_id AS nearest_id, round({DIST}, 6) AS d2
    FROM p a JOIN p b ON a.frame = b.frame AND a.point_id <> b.point_id AND {DIST} <= 9 QUALIFY rank <= 5""",
)
def knn(spark: SparkSession, d: str) -> DataFrame:
    """Up to five nearest of every point within three metres, the point itself left out."""
    p = points(spark, d)
    return sp.nearest(p, p, 3.0, k=5, others=True).withColumn("d2", F.round("d2", 6))


@query(
    "border_assignment", "JOIN-17",
    f"""WITH {POINTS_SQL}, {EDGE_SQL}, b AS (SELECT a.frame, a.point_id, b.point_id AS core_id, {DIST} AS d2, least(a.radius, b.radius) AS r FROM n a JOIN n b ON a.frame = b.frame AND a.ring > 3 AND b.ring <= 3 AND {DIST} <= 1.0
    QUALIFY row_number() OVER (PARTITION BY a.frame, a.point_id ORDER BY {DIST}, b.point_id) = 1) SELECT frame, point_id, core_id FROM b WHERE d2 <= r * r""",
)
def border_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Only the single nearest core is tried; it is accepted within the smaller of the two radii."""
    p, _ = graph(spark, d)
    side = lambda of: p.where(of).select("frame", "point_id", *sp.XYZ, "radius")
    pairs = sp.neighbour_pairs(side("ring > 3"), side("ring <= 3"), 1.0)
    best = F.min(F.struct("d2", F.col("b_point_id").alias("core_id"), F.least("a_radius", "b_radius").alias("r"))).alias("m")
    return pairs.groupBy("frame", F.col("a_point_id").alias("point_id")).agg(best).where("m.d2 <= m.r * m.r").select("frame", "point_id", "m.core_id")


@query(
    "vector_nearest", "JOIN-11 JOIN-12",
    """WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
    SELECT a.label AS frame, a.vec_id AS point_id, b.vec_id AS nearest_id FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0025
    QUALIFY row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.vec_id) = 1""",
)
def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("frame"), F.col("vec_id").alias("point_id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(sp.XYZ)])
    pairs = sp.neighbour_pairs(e, e, 0.05).where("a_point_id <> b_point_id")
    best = F.min(F.struct("d2", F.col("b_point_id").alias("id"))).alias("m")
    return pairs.groupBy("frame", F.col("a_point_id").alias("point_id")).agg(best).select("frame", "point_id", F.col("m.id").alias("nearest_id"))
