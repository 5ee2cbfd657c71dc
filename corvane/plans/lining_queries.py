"""Linings, their strips and masks, mounting, calibration and mean rotations over the point view, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lining as ln
from ..operators import mounting as mt
from ..operators import spatial as sp
from ..sources.tables import points, raw_points, table
from .geometry_queries import RAW
from .registry import query

LINING = ln.LiningParams(40.0, 0.05, 12, 3, 0.3, 0.6, 20.0, 1.0, 10.0, 2, 0.5)
CLAIM = ln.ClaimParams(0.25, 1.0, 0.7, 0.5, 1.5, 0.4)


def bed_moments() -> dict[str, Column]:
    """What the plane of ``bed_plane`` follows from, by name."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return {"xx": F.var_pop(x), "yy": F.var_pop(y), "xy": F.covar_pop(x, y), "xz": F.covar_pop(x, z), "yz": F.covar_pop(y, z)} | {f"a{v}": F.avg(v) for v in "xyz"}


def bed_plane(prefix: str = "") -> list[Column]:
    """(a, b, c): least squares of z on x and y, from the moments' columns."""
    xx, yy, xy, xz, yz, ax, ay, az = (F.col(f"{prefix}{m}") for m in bed_moments())
    det = F.nullif(xx * yy - xy * xy, F.lit(0.0))
    a, b = (xz * yy - yz * xy) / det, (yz * xx - xz * xy) / det
    return [a, b, az - a * ax - b * ay]


def bed_planes(p: DataFrame) -> DataFrame:
    """(frame, a, b, c) of each scan."""
    return p.groupBy("frame").agg(*[m.alias(n) for n, m in bed_moments().items()]).select("frame", *[v.alias(n) for n, v in zip("abc", bed_plane(), strict=True)])


def level_scans(p: DataFrame) -> DataFrame:
    """``levelled`` by each scan's bed plane, of points whose scans are dealt out whole: moments are taken where a scan lies."""
    scan = W.partitionBy("frame")
    m = p.where("frame is not null").withColumns({f"__{n}": v.over(scan) for n, v in bed_moments().items()})
    return ln.turned(m.withColumns({f"__{n}": v for n, v in zip("abc", bed_plane("__"), strict=True)})).drop(*[f"__{n}" for n in bed_moments()])


BED_SQL = """m AS (SELECT frame, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM p GROUP BY frame),
 ab AS (SELECT frame, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b, ax, ay, az FROM m WHERE xx * yy - xy * xy <> 0),
 bed AS (SELECT frame, a, b, az - a * ax - b * ay AS c, sqrt(1 + a * a + b * b) AS size FROM ab)"""


@query(
    "levelled_points", "GEO-9",
    f"""WITH {RAW}, {BED_SQL}, t AS (SELECT frame, z - a * x - b * y - c AS height, (-a * x - b * y + z) / size AS up, sqrt(x * x + y * y + z * z - pow((-a * x - b * y + z) / size, 2)) AS level FROM p JOIN bed USING (frame))
    SELECT frame, count(*) AS n, round(max(abs(height / size - up + c / size)), 6) AS off, round(sum(up), 4) AS up, round(sum(level), 3) AS level, count(*) FILTER (WHERE height > 0.013) AS above FROM t JOIN bed USING (frame) GROUP BY frame""",
)
def levelled_points(spark: SparkSession, d: str) -> DataFrame:
    """Points turned until their scan's plane is level: height along the normal, and the distance along the level."""
    p = raw_points(spark, d)
    planes = bed_planes(p)
    t = ln.levelled(p, planes).join(planes, "frame")
    size = F.sqrt(1 + F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    off = F.max(F.abs(F.col("height") / size - F.col("z") + F.col("c") / size))
    return t.groupBy("frame").agg(F.count("*").alias("n"), F.round(off, 6).alias("off"), F.round(F.sum("z"), 4).alias("up"), F.round(F.sum(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), 3).alias("level"), F.count_if(F.col("height") > 0.013).alias("above"))


def lining_members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The levelled points, and those of their walls and ceilings: thinned above the bed, by windows, peeled. For these a scan is dealt out once."""
    # Few bytes make much work here, so Spark isn't left to join small partitions to one task.
    p = raw_points(spark, d).select("frame", *sp.XYZ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame")
    thin = sp.voxel_centroid(level_scans(p).where("height >= 0"), 0.3)
    name = F.struct("kx", "ky", "kz")
    sample = thin.select("frame", F.xxhash64(name).alias("point_id"), *[F.col(f"mean_{a}").alias(a) for a in "xyz"])
    return level_scans(points(spark, d)), ln.linings(ln.peeled_scans(sample, LINING), LINING)


@query("background_patches", "GEO-9")
def background_patches(spark: SparkSession, d: str) -> DataFrame:
    """Walls and ceilings of each scan with their strips."""
    _, members = lining_members(spark, d)
    s = ln.strips(members, LINING)
    return s.groupBy("frame", "window", "round", "kind").agg(F.count("*").alias("strips"), F.sum("n").alias("support"), F.round(F.min("x0"), 6).alias("x0"), F.round(F.max("x1"), 6).alias("x1"))


@query(
    "lining_strips", "GEO-9 AGG-10",
    f"""WITH {RAW}, m AS (SELECT frame, CASE WHEN abs(y) > 1.9 THEN 'wall' ELSE 'ceiling' END AS kind, CASE WHEN y < -1.9 THEN 0 WHEN y > 1.9 THEN 1 ELSE 2 END AS round, x, CASE WHEN abs(y) > 1.9 THEN z ELSE y END AS t FROM p WHERE abs(y) > 1.9 OR z > 4.85),
    l AS (SELECT *, max(x) OVER w - min(x) OVER w AS length, max(t) OVER w - min(t) OVER w AS breadth FROM m WINDOW w AS (PARTITION BY frame, round))
    SELECT frame, round::BIGINT AS round, kind, floor(x / 10.0)::BIGINT AS strip, count(*) AS n, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(t), 6) AS t0, round(max(t), 6) AS t1 FROM l WHERE length >= 20 AND breadth >= 1 GROUP BY ALL HAVING count(*) >= 2 AND max(t) - min(t) >= 0.5""",
)
def lining_strips(spark: SparkSession, d: str) -> DataFrame:
    """Strips of three given planes: both outermost walls and the highest layer."""
    number = F.when(F.col("y") < -1.9, 0).when(F.col("y") > 1.9, 1).when(F.col("z") > 4.85, 2)
    wall = F.abs("y") > 1.9
    given = {"round": number.cast("long"), "window": F.lit(0).cast("long"), "nx": F.lit(0.0), "ny": F.when(wall, 1.0).otherwise(0.0), "nz": F.when(wall, 0.0).otherwise(1.0), "offset": F.lit(0.0)}
    m = raw_points(spark, d).withColumns(given)
    s = ln.strips(ln.linings(m.where("round is not null"), LINING), LINING)
    return s.select("frame", "round", "kind", "strip", "n", *[F.round(c, 6).alias(c) for c in ("x0", "x1", "t0", "t1")])


@query("lining_mask", "GEO-10 FIL-10")
def lining_mask(spark: SparkSession, d: str) -> DataFrame:
    """Each scan's own linings, fitted and then masked out of it, but for what protrudes."""
    level, members = lining_members(spark, d)
    m = ln.lining_mask(level.select("frame", "point_id", *sp.XYZ), ln.NormalParams(2.0, 12, 4), ln.strips(members, LINING), CLAIM, LINING.strip)
    return m.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("masked").alias("masked"), F.count_if("protects").alias("protruding"))


MOUNT = mt.MountParams(0.0, 110.0, 10.0, 0.15, -1.0, 20.0, 0.5, 4, 2, 3, 30.0, 2.5)
MOUNT_SQL = f"""{RAW}, q AS (SELECT frame, floor(x / 10.0)::BIGINT AS bin, CASE WHEN abs(y + 0.8) < 0.15 THEN -1 WHEN abs(y - 0.8) < 0.15 THEN 1 END AS side, x, y, z FROM p WHERE x >= 0 AND x < 110 AND z > -1 AND z < 20),
 u AS (SELECT *, count(*) OVER w AS k, quantile_cont(z, 0.5) OVER w AS least FROM q WHERE side IS NOT NULL WINDOW w AS (PARTITION BY frame, bin, side)),
 h AS (SELECT frame, bin, side, median(x) AS hx, median(y) AS hy, median(z) AS hz FROM u WHERE k >= 4 AND z >= least GROUP BY ALL HAVING count(*) >= 2),
 b AS (SELECT l.frame, l.bin, r.hx AS rx, r.hy AS ry, r.hz AS rz, l.hx AS lx, l.hy AS ly, l.hz AS lz, (l.hx + r.hx) / 2 AS mx, (l.hy + r.hy) / 2 AS my FROM h l JOIN h r ON l.frame = r.frame AND l.bin = r.bin AND l.side = 1 AND r.side = -1),
 e AS (SELECT frame, mx, my, rx AS hx, ry AS hy, rz AS hz FROM b UNION ALL SELECT frame, mx, my, lx, ly, lz FROM b),
 s AS (SELECT frame, count(*) // 2 AS pairs, max(mx) - min(mx) AS stretch, avg(hx) AS ax, avg(hy) AS ay, avg(hz) AS az, var_pop(hx) AS xx, var_pop(hy) AS yy, covar_pop(hx, hy) AS xy, covar_pop(hx, hz) AS xz, covar_pop(hy, hz) AS yz, var_pop(mx) AS mm, covar_pop(mx, my) AS ml, avg(mx) AS bx, avg(my) AS by_ FROM e GROUP BY frame),
 f AS (SELECT *, CASE WHEN xx * yy - xy * xy > 1e-12 * xx * yy AND mm > 0 THEN (xz * yy - yz * xy) / (xx * yy - xy * xy) END AS a, CASE WHEN xx * yy - xy * xy > 1e-12 * xx * yy AND mm > 0 THEN (yz * xx - xz * xy) / (xx * yy - xy * xy) END AS b, ml / nullif(mm, 0) AS slope FROM s),
 g AS (SELECT *, az - a * ax - b * ay AS c, by_ - slope * bx AS o, sqrt(1 + a * a + b * b) AS size FROM f),
 d AS (SELECT b.frame, max(greatest(abs(rz - a * rx - g.b * ry - c), abs(lz - a * lx - g.b * ly - c)) / size) AS plane_residual, max(abs(my - slope * mx - o)) AS line_residual FROM b JOIN g USING (frame) GROUP BY b.frame),
 o AS (SELECT DISTINCT frame FROM p)"""


def observed(spark: SparkSession, d: str) -> DataFrame:
    p = raw_points(spark, d).withColumns({"height": F.col("z"), "center": F.lit(0.0), "spacing": F.lit(1.6)})
    return mt.observe(p, MOUNT)


@query(
    "mounting_observed", "GEO-11 AGG-27 AGG-14",
    f"""WITH {MOUNT_SQL} SELECT o.frame, coalesce(pairs, 0) AS pairs, CASE WHEN coalesce(pairs, 0) < 3 THEN 'insufficient_paired_bins' WHEN stretch < 30 THEN 'insufficient_paired_stretch' WHEN a IS NULL THEN 'degenerate_heads' WHEN greatest(plane_residual, line_residual) > 2.5 THEN 'not_straight_or_planar' ELSE 'supported_heads' END AS reason,
    round(-c / size, 5) AS height, round(a, 6) AS pitch, round(plane_residual, 5) AS plane_residual, round(line_residual, 5) AS line_residual FROM o LEFT JOIN g USING (frame) LEFT JOIN d USING (frame)""",
)
def mounting_observed(spark: SparkSession, d: str) -> DataFrame:
    """Height and pitch over the support plane of paired heads, with the residuals that decide."""
    o = observed(spark, d)
    return o.select("frame", "pairs", "reason", F.round("height", 5).alias("height"), F.round(-F.col("up")[0] / F.col("up")[2], 6).alias("pitch"), F.round("plane_residual", 5).alias("plane_residual"), F.round("line_residual", 5).alias("line_residual"))


@query("calibration", "GEO-12 WIN-10 AGG-29")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's suppliers as a run of scans: orientation fitted on the first three observed, judged on the rest."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"), F.col("s_nationkey").alias("run"))
    c = mt.calibrate(observed(spark, d).join(s, "frame"), "run", "frame", 3)
    return c.select("run", "fitted", "later", "accepted", *[F.round(x, 5).alias(x) for x in ("qw", "qx", "qy", "qz", "worst", "height_span", "lateral_span", "fraction")])


def orientations(spark: SparkSession, d: str) -> DataFrame:
    """A turn about any axis for each customer, from its keys; signs alternate."""
    k = F.col("c_custkey")
    half, sign = F.radians((k % 41) - 15.0) / 2, F.when(k % 2 == 0, 1.0).otherwise(-1.0)
    axis = [F.lit(1.0) + k % 3, F.lit(0.5) + k % 5, F.lit(2.0) + k % 7]
    size = F.sqrt(sum((a * a for a in axis), F.lit(0.0)))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), (sign * F.cos(half)).alias("qw"), *[(sign * F.sin(half) * a / size).alias(f"q{n}") for n, a in zip("xyz", axis, strict=True)])


@query("mean_rotations", "AGG-29")
def mean_rotations(spark: SparkSession, d: str) -> DataFrame:
    """Mean orientation of each nation's customers about any axis, and how far the furthest turns from it."""
    q = orientations(spark, d)
    m = mt.mean_rotations(q, ["nation"])
    worst = mt.deviations(q, m, ["nation"]).groupBy(F.col("nation").alias("__n")).agg(F.max("deviation").alias("worst"), F.avg("deviation").alias("mean"))
    return m.join(worst, F.col("nation") == F.col("__n")).select("nation", "n", *[F.round(c, 6).alias(c) for c in (*mt.QUATERNION, "worst", "mean")])
