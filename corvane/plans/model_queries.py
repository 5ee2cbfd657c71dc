"""Queries whose operators need per-group solvers or state. SQL stands beside those it can express."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import fits, generate, motion, segments, tracking
from ..sources import clouds
from ..sources.shared import shared_folder
from ..sources.tables import RESULTS_SQL, points, results, table
from ..streaming import live
from .registry import query
from .report_queries import boxes
from .spatial_queries import graph

TUNNEL, BEAMS = generate.Tunnel(), generate.Beams()
PLANE = fits.PlaneParams((2.0, 30.0), 1.5, (1.0, 2.6), 0.05, 0.2)
BED = fits.BedParams(4.0, 60.0, 4.0, 1.5, 0.08, 36, 0.1)
RAIL = fits.RailParams((0.05, 0.4), 50.0, 4.0, 0.04, 6.0, 0.2, 20.0, 1.52, 0.12, 0.2, 1.0, 3, 0.5, 0.08)


def scene(spark: SparkSession, d: str) -> DataFrame:
    """One scan per region, with an object that stands further away in each (none in the first)."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("frame"))
    there = F.col("frame") > 0
    val = lambda v: F.when(there, v).cast("double")
    frames = r.select("frame", val(F.lit(8.0) + 6 * F.col("frame")).alias("ox"), val(F.lit(-0.4)).alias("oy"), val(F.lit(-1.6)).alias("oz"), val(F.lit(0.6)).alias("sx"), val(F.lit(0.8)).alias("sy"), val(F.lit(1.6)).alias("sz"))
    return generate.scan_scene(spark, frames, TUNNEL, BEAMS, noise=0.01, dropout=0.02, seed=7)


@query("scene_labels", "GEN-1 GEN-4 FIL-17")
def scene_labels(spark: SparkSession, d: str) -> DataFrame:
    return scene(spark, d).groupBy("frame", "hit").agg(F.count("*").alias("n"), F.round(F.min("x"), 3).alias("nearest"))


@query("curved_labels", "GEN-2")
def curved_labels(spark: SparkSession, d: str) -> DataFrame:
    """What a scan meets in a curved tunnel, a tighter one to the right as well: the sides that bend in come nearer."""
    frames = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("frame"), *[F.lit(None).cast("double").alias(c) for c in ("ox", "oy", "oz", "sx", "sy", "sz")])
    parts = [generate.scan_scene(spark, frames, generate.Tunnel(radius=r), BEAMS, noise=0.01, dropout=0.02, seed=7).withColumn("radius", F.lit(r)) for r in (300.0, -80.0)]
    return parts[0].unionByName(parts[1]).groupBy("radius", "frame", "hit").agg(F.count("*").alias("n"), F.round(F.max("x"), 3).alias("furthest"))


@query("robust_plane", "GEO-1 GEO-2 SRT-7")
def robust_plane(spark: SparkSession, d: str) -> DataFrame:
    g = fits.fit_geometry(scene(spark, d), PLANE, BED, RAIL)
    return g.select("frame", "reason", F.round(F.col("plane")[2], 3).alias("height"), F.size("ground").alias("bed_anchors"))


@query("rail_anchors", "GEO-4 GEO-5")
def rail_anchors(spark: SparkSession, d: str) -> DataFrame:
    g = fits.fit_geometry(scene(spark, d), PLANE, BED, RAIL)
    return g.select("frame", F.explode("rail").alias("r")).select("frame", "r.x", F.round("r.center", 3).alias("center"), F.round("r.gauge", 3).alias("gauge"), "r.support")


@query("assignment", "JOIN-9")
def assignment(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    m = ev.match_boxes(b.where("label <> 'R'"), b.where("label = 'R'"), 0.1, ("frame",))
    return m.select("frame", "prediction", "truth", F.round("iou", 6).alias("iou"))


@query("oriented_iou", "JOIN-8")
def oriented_iou(spark: SparkSession, d: str) -> DataFrame:
    """A part's box against the same box turned about z and moved along x."""
    p = table(spark, d, "part").where("p_partkey is not null")
    a = F.radians(F.col("p_size") * 3.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    flat = [F.array(F.lit(2.0), F.lit(1.0), F.lit(1.5)).alias(c) for c in ("sa", "sb")]
    pairs = p.select(
        F.col("p_partkey").alias("id"), F.array(zero, zero, zero).alias("ca"), *flat, F.array(one, zero, zero, zero, one, zero, zero, zero, one).alias("ra"),
        F.array(F.col("p_size") / 40.0, zero, zero).alias("cb"), F.array(F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one).alias("rb"),
    )
    return ev.oriented_ious(pairs).select("id", F.round("iou", 6).alias("iou"))


@query("mean_rotation", "AGG-29")
def mean_rotation_query(spark: SparkSession, d: str) -> DataFrame:
    """Mean orientation per nation of quaternions built from its customers."""
    half = F.radians((F.col("c_custkey") % 40) - 20) / 2
    q = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.cos(half).alias("w"), F.sin(half).alias("z"))
    # The mean needs only the summed outer products, so customers are summed first and a nation is one row.
    sums = q.groupBy("nation").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in (("w", "w"), ("w", "z"), ("z", "z"))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                vec = np.linalg.eigh(np.array([[r.ww, r.wz], [r.wz, r.zz]]))[1][:, -1]
                out.append((r.nation, round(float(np.degrees(2 * np.arctan2(*(vec[::-1] * np.sign(vec[0]))))), 6)))
            yield pd.DataFrame(out, columns=["nation", "angle"])

    return sums.mapInPandas(solve, "nation int, angle double")


def stream_objects(scans: DataFrame) -> DataFrame:
    """Two objects in each scan, one of which drifts."""
    kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(y).alias("cy"), F.lit(r).alias("relation")) for i, y, r in ((1, 0.0, "intersecting"), (2, 2.0, "adjacent"))])
    s = scans.withColumn("o", F.explode(kinds))
    return s.select(
        "bag", "frame", "ns", "o.id", (F.lit(30.0) + F.col("o.id") * 5 + F.least(F.col("value"), F.lit(50.0)) / 25).alias("cx"), "o.cy", F.lit(0.5).alias("cz"),
        *[F.lit(v).alias(c) for c, v in (("ex", 0.8), ("ey", 0.6), ("ez", 1.5))], "o.relation", F.lit(12).alias("support"), F.when(F.col("o.id") == 1, 4).otherwise(0).alias("certain"), F.lit(False).alias("immediate"),
    )


DAY = 86_400.0
TRACKING = tracking.TrackParams(0.5, 0.3, 1e-5, 16.0, 1.0, DAY, DAY, 3, 5, 2 * DAY, 24, 2)


@query("tracker", "STR-9 STR-10 JOIN-10")
def tracker(spark: SparkSession, d: str) -> DataFrame:
    return tracking.track(stream_objects(results(spark, d)), TRACKING).select("bag", "frame", "id", "track_id", "hits", "accumulated", "confirmed", "intersection_confirmed", "gap_reset")


@query("track_stream", "STR-9 STR-10")
def track_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same tracks from the streaming operator."""
    out = live.run_available(live.track_stream(stream_objects(live.read_events(spark, d)), TRACKING), shared_folder(spark))
    return out.select("bag", "frame", "id", "track_id", "hits", "accumulated", "confirmed", "intersection_confirmed", "gap_reset")


@query("event_groups", "STR-12")
def event_groups(spark: SparkSession, d: str) -> DataFrame:
    c = results(spark, d).select("bag", "frame", F.col("frame").alias("id"), (F.col("k") % 7 / 2).alias("y"), (F.col("k") % 3 / 2).alias("z"), F.col("value").alias("distance"))
    return tracking.group_events(c, 1500, 0.3, 0.3).select("bag", "event", "first_frame", "last_frame", "frames", "min_distance")


PROFILE = motion.ProfileParams(0.0, 100.0, 0.5, 21, (0.25, 0.5, 0.25), 1.0, 10.0, 20.0, 2.0, 1.0, 0.1, 5, 3)


@query("profile_motion", "STR-8 AGG-12")
def profile_motion(spark: SparkSession, d: str) -> DataFrame:
    """Scans are dates of a supplier group; a profile is the day's returns along x."""
    line = table(spark, d, "lineitem")
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    p = line.select((F.col("l_suppkey") % 4).alias("bag"), (day / 30).cast("long").alias("frame"), (F.col("l_extendedprice") / 1000).alias("x")).withColumn("ns", F.col("frame") * 1_000_000_000)
    m = motion.profile_motion(motion.profiles(p, PROFILE), PROFILE)
    return m.select("bag", "frame", F.round("step", 6).alias("step"), F.round("position", 6).alias("position"))


DENSITY = segments.DensityParams(0.6, 0.004, 1.0, 1.0, 4.0, 2.0, 30.0)


@query("density_labels", "SEG-1 OBJ-1 JOIN-13 JOIN-17")
def density_labels(spark: SparkSession, d: str) -> DataFrame:
    return segments.density_labels(points(spark, d), DENSITY)


@query("nearest_seed", "SEG-6")
def nearest_seed(spark: SparkSession, d: str) -> DataFrame:
    p, e = graph(spark, d)
    s = segments.nearest_seed(p.select("frame", "point_id", (F.col("ring") == 1).alias("seed")), e.withColumn("w", F.lit(1.0)))
    return s.select("frame", "point_id", "seed", "distance")


LAYOUT = clouds.Layout((("x", 0, 8), ("y", 8, 8), ("z", 16, 8), ("ring", 24, 4)), 26)


@query(
    "decode_clouds", "SRC-2 SRC-3 FIL-4 FIL-5 SNK-6 SNK-7",
    "SELECT l_suppkey AS frame, count(*) AS n, min(l_extendedprice / 1000) AS min_x, max(l_quantity / 10) AS max_z, max(l_linenumber) AS max_ring FROM lineitem GROUP BY l_suppkey",
)
def decode_clouds(spark: SparkSession, d: str) -> DataFrame:
    """Scans packed to binary messages and decoded again."""
    p = points(spark, d).withColumn("bag", F.lit(0).cast("long"))
    c = clouds.decode_clouds(clouds.encode_clouds(p, LAYOUT), LAYOUT)
    return c.groupBy("frame").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("z").alias("max_z"), F.max("ring").alias("max_ring"))


HOUR = 3_600_000_000_000


@query(
    "stream_dedupe", "STR-1 STR-5 WIN-1",
    f"""WITH {RESULTS_SQL}, g AS (SELECT *, lag(ns) OVER (PARTITION BY bag ORDER BY ns, frame) AS b FROM r) SELECT bag, frame, CASE WHEN b IS NULL OR ns > b THEN 'processed' ELSE 'duplicate' END AS outcome, row_number() OVER (PARTITION BY bag ORDER BY ns, frame) AS received FROM g""",
)
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return live.run_available(live.monitor(live.read_events(spark, d), 8 * HOUR), shared_folder(spark)).select("bag", "frame", "outcome", "received")


@query(
    "stream_gap", "STR-2",
    f"""WITH {RESULTS_SQL}, g AS (SELECT bag, ns - lag(ns) OVER (PARTITION BY bag ORDER BY ns, frame) AS dt FROM r) SELECT bag, count(*) AS frames, count(*) FILTER (WHERE dt > {8 * HOUR}) AS resets FROM g GROUP BY bag""",
)
def stream_gap(spark: SparkSession, d: str) -> DataFrame:
    m = live.run_available(live.monitor(live.read_events(spark, d), 8 * HOUR), shared_folder(spark))
    return m.groupBy("bag").agg(F.count("*").alias("frames"), F.count_if("gap_reset").alias("resets"))


@query(
    "stream_resets", "STR-1 STR-3 STR-5",
    f"""WITH {RESULTS_SQL}, g AS (SELECT bag, value, ns - lag(ns) OVER (PARTITION BY bag ORDER BY ns, frame) AS dt FROM r)
    SELECT bag, count(*) AS frames, count(*) FILTER (WHERE coalesce(dt, 1) > 0 AND value < 20) AS insufficient, count(*) FILTER (WHERE dt > {8 * HOUR} AND NOT coalesce(value < 20, false)) AS gaps, count(*) FILTER (WHERE dt = 0) AS duplicates FROM g GROUP BY bag""",
)
def stream_resets(spark: SparkSession, d: str) -> DataFrame:
    """What clears a recording's state: too few returns, or a gap (late scans come in later batches only)."""
    m = live.run_available(live.monitor(live.read_events(spark, d).withColumn("returns", F.col("value")), 8 * HOUR, 20), shared_folder(spark))
    is_ = lambda r: F.count_if(F.col("reset") == r)
    return m.groupBy("bag").agg(F.count("*").alias("frames"), is_("insufficient_returns").alias("insufficient"), is_("gap").alias("gaps"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"))


@query("stream_watchdog", "STR-4")
def stream_watchdog(spark: SparkSession, d: str) -> DataFrame:
    """The last scan of each recording as the watchdog saw it."""
    w = live.run_available(live.watchdog(live.read_events(spark, d), 60_000), shared_folder(spark), one_batch=True)
    return w.groupBy("bag").agg(F.max("ns").alias("ns"), F.max_by("status", "ns").alias("status"))
