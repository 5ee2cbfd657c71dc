"""Structure, mounting, curves, backgrounds, stage tables and key audits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fits
from ..operators import spatial as sp
from ..sources.shared import shared_folder
from ..sources.tables import POINTS_SQL, points, raw_points, table
from .model_queries import BED, PLANE, RAIL, scene
from .registry import query
from .spatial_queries import RAW


@query(
    "structural_mask", "GEO-7 AGG-11 FIL-9",
    f"""WITH {POINTS_SQL}, c AS (SELECT *, floor((y + 0.2) / 0.4)::BIGINT AS sc, floor((z + 0.2) / 0.4)::BIGINT AS sr, floor(y / 0.1)::BIGINT AS col, floor(z / 0.1)::BIGINT AS row FROM p),
    s AS (SELECT frame, sc, sr FROM c GROUP BY ALL HAVING max(floor(x)) - min(floor(x)) + 1 >= 30 AND count(*) >= 6), o AS (SELECT DISTINCT frame, col, row FROM c),
    t AS (SELECT DISTINCT frame, col + i AS col, row + j AS row FROM o, range(-3, 4) a(i), range(-1, 2) b(j)), n AS (SELECT *, col - row_number() OVER (PARTITION BY frame, row ORDER BY col) AS run FROM t),
    r AS (SELECT frame, row, col, min(col) OVER w AS l, max(col) OVER w AS h FROM n WINDOW w AS (PARTITION BY frame, row, run)),
    g AS (SELECT o.* FROM o JOIN r USING (frame, row, col) WHERE CASE WHEN o.col >= 0 THEN (h + 1) * 0.1::DOUBLE ELSE -l * 0.1::DOUBLE END >= CASE WHEN row < 20 THEN 1.6 ELSE 1.9 END)
    SELECT frame, count(*) FILTER (WHERE s.frame IS NOT NULL AND g.frame IS NOT NULL) AS structural, count(*) AS n FROM c LEFT JOIN s USING (frame, sc, sr) LEFT JOIN g USING (frame, col, row) GROUP BY frame""",
)
def structural_mask(spark: SparkSession, d: str) -> DataFrame:
    limit = F.when(F.col("row") < 20, 1.6).otherwise(1.9)
    p = sp.structural(raw_points(spark, d), limit, 0.4, 0.1, 1.0, 30.0, 6, 0.3)
    return p.groupBy("frame").agg(F.count_if("structural").alias("structural"), F.count("*").alias("n"))


@query(
    "mounting", "AGG-27 AGG-14",
    f"""WITH {RAW}, b AS (SELECT frame, floor(x / 5)::BIGINT AS bin, quantile_cont(z, 0.9) AS top, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3)
    SELECT frame, count(*) AS bins, round(regr_slope(top, bin), 6) AS pitch, round(median(top), 6) AS height FROM b GROUP BY frame""",
)
def mounting(spark: SparkSession, d: str) -> DataFrame:
    """Height and pitch of the sensor from upper quantiles of binned returns: two aggregates, no UDF."""
    b = raw_points(spark, d).groupBy("frame", F.floor(F.col("x") / 5).alias("bin")).agg(F.percentile("z", F.lit(0.9)).alias("top"), F.count("*").alias("n")).where("n >= 3")
    return b.groupBy("frame").agg(F.count("*").alias("bins"), F.round(F.regr_slope("top", "bin"), 6).alias("pitch"), F.round(F.median("top"), 6).alias("height"))


@query(
    "pair_ranking", "SRT-4 SRT-5",
    """WITH c AS (SELECT p_brand AS frame, p_partkey AS id, (p_partkey * 7919 % 1000) / 1000.0::DOUBLE AS score, p_size / 10.0::DOUBLE AS center FROM part),
    r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS s2, lead(center) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY frame ORDER BY score DESC, center DESC, id DESC))
    SELECT frame, id, score, center, coalesce(s2 > 0.8 * score AND abs(c2 - center) > 0.3, false) AS ambiguous FROM r WHERE rank = 1""",
)
def pair_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate by (score, centre, id), and whether the second makes it ambiguous."""
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.col("p_brand").alias("frame"), k.alias("id"), ((k * 7919 % 1000) / 1000).alias("score"), (F.col("p_size") / 10).alias("center"))
    w = W.partitionBy("frame").orderBy(F.desc("score"), F.desc("center"), F.desc("id"))
    r = c.withColumns({"rank": F.row_number().over(w), "s2": F.lead("score").over(w), "c2": F.lead("center").over(w)}).where("rank = 1")
    return r.select("frame", "id", "score", "center", F.coalesce((F.col("s2") > 0.8 * F.col("score")) & (F.abs(F.col("c2") - F.col("center")) > 0.3), F.lit(False)).alias("ambiguous"))


@query("radius_counts", "RPT-25 FIL-6 AGG-13", f"WITH {RAW}, e(edge) AS (VALUES (10.0), (20.0), (40.0), (80.0)), s AS (SELECT frame, sqrt(x * x + y * y + z * z) AS r FROM p) SELECT frame, edge::DOUBLE AS edge, count(*) FILTER (WHERE r <= edge) AS n FROM s, e GROUP BY frame, edge")
def radius_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative counts by radius edge: one pass of conditional counts, unpivoted after aggregation."""
    edges = [10.0, 20.0, 40.0, 80.0]
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    g = raw_points(spark, d).groupBy("frame").agg(*[F.count_if(r <= e).alias(f"n{i}") for i, e in enumerate(edges)])
    return g.select("frame", F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"n{i}").alias("n")) for i, e in enumerate(edges)])).alias("v")).select("frame", "v.edge", "v.n")


@query(
    "key_audit", "DIF-2",
    "WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key FROM events) SELECT event_type, key, key NOT IN ('value', 'unit') AS removed, count(*) AS n FROM k GROUP BY ALL",
)
def key_audit(spark: SparkSession, d: str) -> DataFrame:
    """Keys of nested JSON by kind of row, and whether a schema that allows (value, unit) has removed them."""
    k = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return k.groupBy("event_type", "key", (~F.col("key").isin("value", "unit")).alias("removed")).agg(F.count("*").alias("n"))


@query(
    "stage_tables", "SRC-9",
    f"WITH {RAW} SELECT frame, ring, count(*) AS n, max(x) AS most FROM p WHERE ring IN (1, 2) GROUP BY frame, ring",
)
def stage_tables(spark: SparkSession, d: str) -> DataFrame:
    """Per-stage points written once by stage and read back with partitions pruned and columns chosen: no index of offsets is needed."""
    at = f"{shared_folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
    raw_points(spark, d).write.partitionBy("ring").parquet(at)
    read = spark.read.schema("frame long, x double, y double, z double, ring int").parquet(at)
    return read.where("ring in (1, 2)").groupBy("frame", "ring").agg(F.count("*").alias("n"), F.max("x").alias("most"))


@query("curve_radius", "GEO-13 GEO-14")
def curve_radius(spark: SparkSession, d: str) -> DataFrame:
    """Circle and smoothed centre line through each scan's rail anchors."""
    g = fits.fit_geometry(scene(spark, d), PLANE, BED, RAIL).where(F.size("rail") >= 3).select("frame", "rail")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                x, y = np.array([a["x"] for a in r.rail]), np.array([a["center"] for a in r.rail])
                c = fits.circle(x, y)
                rows.append((r.frame, len(x), None if c is None else float(min(c[2], 1e6)), float(fits.penalised_spline(x, y, 10.0, 1.0, np.array([x.mean()]))[0])))
            yield pd.DataFrame(rows, columns=["frame", "anchors", "radius", "middle"])

    return g.mapInPandas(solve, "frame long, anchors int, radius double, middle double").select("frame", "anchors", F.round("radius", 0).alias("radius"), F.round("middle", 2).alias("middle"))


@query("point_order", "SRT-5 SRC-1", f"WITH {POINTS_SQL} SELECT frame, count(*) AS n, max(point_id) AS last_id FROM p GROUP BY frame")
def point_order(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("frame").agg(F.count("*").alias("n"), F.max("point_id").alias("last_id"))
