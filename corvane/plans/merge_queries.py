"""Runs side by side and gates, result lines, insertion, tilted patches, traces and shared curvature, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import background as bg
from ..operators import compare as cp
from ..operators import registration as rg
from ..sources import clouds
from ..sources.shared import shared_folder
from ..sources.tables import RESULTS_SQL, points, raw_points, results, table
from .geometry_queries import RAW
from .registry import query
from .report_queries import RUNS, two_runs

MERGED = f"""{RUNS}, a AS (SELECT *, row_number() OVER (ORDER BY frame) AS line FROM x), b AS (SELECT *, row_number() OVER (ORDER BY frame) AS line FROM y),
 z AS (SELECT coalesce(a.line, b.line) AS line, a.frame AS old_frame, b.frame AS new_frame, a.frame IS NOT DISTINCT FROM b.frame AS same, a.status AS old_status, b.status AS new_status, a.value AS old_value, b.value AS new_value, a.reason FROM a FULL JOIN b ON a.line = b.line)"""


def line_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(cp.numbered(r, ["frame"]) for r in two_runs(spark, d))


@query("positional_merge", "JOIN-2", f"WITH {MERGED} SELECT same, old_frame IS NULL AS added, new_frame IS NULL AS removed, count(*) AS n, min(line) AS first_line FROM z GROUP BY 1, 2, 3")
def positional_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two runs zipped line by line: how many lines have the same identity, and where others begin."""
    m = cp.positional_merge(*line_runs(spark, d), ["frame"])
    return m.groupBy("same", F.col("before").isNull().alias("added"), F.col("after").isNull().alias("removed")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


PANEL = f"""{RUNS}, j AS (SELECT coalesce(x.reason, y.reason) AS scene, x.frame AS xf, y.frame AS yf, x.status AS os, y.status AS ns, x.value AS ov, y.value AS nv FROM x FULL JOIN y ON x.frame = y.frame)"""


@query(
    "panel_report", "RPT-3 JOIN-2 DIF-1 AGG-31",
    f"""WITH {PANEL} SELECT scene, count(*) AS frames, count(*) FILTER (WHERE xf IS NULL) AS extra, count(*) FILTER (WHERE yf IS NULL) AS missing, count(*) FILTER (WHERE os <> ns) AS changed,
    count(*) FILTER (WHERE abs(ov - nv) > 1e-10 + 1e-10 * greatest(abs(ov), abs(nv))) AS moved, round(max(abs(ov - nv)), 6) AS most, round(median(ov), 6) AS before, round(median(nv), 6) AS after FROM j GROUP BY scene""",
)
def panel_report(spark: SparkSession, d: str) -> DataFrame:
    """Before and after of each scene: frames, changed statuses, values beyond tolerance, medians."""
    before, after = two_runs(spark, d)
    j = before.alias("b").join(after.alias("a"), F.col("b.frame") == F.col("a.frame"), "full_outer")
    b, a = F.col("b.value"), F.col("a.value")
    return j.groupBy(F.coalesce("b.reason", "a.reason").alias("scene")).agg(
        F.count("*").alias("frames"), F.count_if(F.col("b.frame").isNull()).alias("extra"), F.count_if(F.col("a.frame").isNull()).alias("missing"), F.count_if(F.col("b.status") != F.col("a.status")).alias("changed"),
        F.count_if(~cp.close(b, a, cp.TOLERANCE) & b.isNotNull() & a.isNotNull()).alias("moved"), F.round(F.max(F.abs(b - a)), 6).alias("most"), F.round(F.median(b), 6).alias("before"), F.round(F.median(a), 6).alias("after"),
    )


@query(
    "stability_report", "RPT-11 RPT-10 DIF-3",
    f"""WITH {PANEL}, t AS (SELECT scene, os || ' -> ' || ns AS change, count(*) AS n FROM j WHERE os <> ns GROUP BY 1, 2), k AS (SELECT scene, count(*) AS kept FROM j WHERE os = ns GROUP BY scene)
    SELECT scene, change, n, round(n / (n + kept), 6) AS share, row_number() OVER (PARTITION BY scene ORDER BY n DESC, change)::INTEGER AS rank FROM t JOIN k USING (scene)""",
)
def stability_report(spark: SparkSession, d: str) -> DataFrame:
    """Each scene's status changes against what stayed, the most frequent first."""
    before, after = two_runs(spark, d)
    j = before.select("frame", F.col("reason").alias("scene"), F.col("status").alias("old")).join(after.select("frame", F.col("status").alias("new")), "frame")
    kept = j.where("old = new").groupBy("scene").agg(F.count("*").alias("kept"))
    t = j.where("old <> new").groupBy("scene", F.concat_ws(" -> ", "old", "new").alias("change")).agg(F.count("*").alias("n")).join(kept, "scene")
    return t.select("scene", "change", "n", F.round(F.col("n") / (F.col("n") + F.col("kept")), 6).alias("share"), F.row_number().over(W.partitionBy("scene").orderBy(F.desc("n"), "change")).alias("rank"))


@query(
    "acceptance_gate", "DIF-6 RPT-22",
    f"""WITH {PANEL}, v AS (SELECT 'missing_frames' AS violation, count(*) AS n, 0 AS allowed FROM j WHERE yf IS NULL UNION ALL SELECT 'extra_frames', count(*), 0 FROM j WHERE xf IS NULL
      UNION ALL SELECT 'changed_status', count(*), 10 FROM j WHERE os <> ns UNION ALL SELECT 'unknown_status', count(*), 1000000 FROM j WHERE ns = 'Z')
    SELECT violation, n, allowed::BIGINT AS allowed FROM v WHERE n > allowed""",
)
def acceptance_gate(spark: SparkSession, d: str) -> DataFrame:
    """What a run violates against a reference run: every rule with its count and what is allowed."""
    before, after = two_runs(spark, d)
    j = before.alias("b").join(after.alias("a"), F.col("b.frame") == F.col("a.frame"), "full_outer")
    rules = {"missing_frames": (F.col("a.frame").isNull(), 0), "extra_frames": (F.col("b.frame").isNull(), 0), "changed_status": (F.col("b.status") != F.col("a.status"), 10), "unknown_status": (F.col("a.status") == "Z", 1_000_000)}
    return cp.violations(j, rules)


@query("result_lines", "SRC-7 SNK-1", f"WITH {RESULTS_SQL} SELECT bag, count(*) AS n, min(frame) AS first_frame, count(*) FILTER (WHERE status = 'error') AS errors, round(max(value), 6) AS most FROM r GROUP BY bag")
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    """Results written as compressed JSON lines and read back with their schema given, timing files passed over."""
    at = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    clouds.write_results(results(spark, d).select(F.col("bag").cast("string").alias("bag"), "frame", F.col("ns").alias("measurement_timestamp_ns"), "status", F.col("value").alias("nearest_obstacle_m")), at)
    back = clouds.read_results(spark, at)
    return back.groupBy(F.col("bag").cast("long").alias("bag")).agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.max("nearest_obstacle_m"), 6).alias("most"))


@query("file_audit", "SNK-3", "SELECT sha256(r_name || chr(10)) AS sha256, length(r_name)::BIGINT + 1 AS length FROM region")
def file_audit(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of files: one for each region, which holds its name."""
    at = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    table(spark, d, "region").select(F.col("r_regionkey").alias("key"), "r_name").write.partitionBy("key").text(at)
    return clouds.file_digests(spark, f"{at}/key=*/*.txt").select("sha256", "length")


@query("unique_gaps", "WIN-15", f"WITH {RAW}, u AS (SELECT DISTINCT frame, x FROM p), g AS (SELECT frame, lead(x) OVER (PARTITION BY frame ORDER BY x) - x AS gap FROM u) SELECT frame, count(*) AS places, count(*) FILTER (WHERE gap > 1.0) AS gaps, round(max(gap), 6) AS widest FROM g GROUP BY frame")
def unique_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between a scan's distinct places along the track."""
    u = raw_points(spark, d).select("frame", "x").distinct()
    g = u.withColumn("gap", F.lead("x").over(W.partitionBy("frame").orderBy("x")) - F.col("x"))
    return g.groupBy("frame").agg(F.count("*").alias("places"), F.count_if(F.col("gap") > 1.0).alias("gaps"), F.round(F.max("gap"), 6).alias("widest"))


#: Tilted patches: x window, unit normal and offset.
PATCHES = [(0.0, 60.0, (0.0, 0.8, 0.6), -1.0), (40.0, 110.0, (0.0, -0.6, 0.8), -2.0), (20.0, 80.0, (0.28, 0.0, 0.96), -18.0)]
_BAND = " OR ".join(f"(x >= {a} AND x <= {b} AND abs({n[0]}::DOUBLE * x + {n[1]}::DOUBLE * y + {n[2]}::DOUBLE * z + {o}::DOUBLE) < 0.2537)" for a, b, n, o in PATCHES)


@query("tilted_patches", "FIL-8 SET-4", f"WITH {RAW} SELECT frame, count(*) AS n, round(min(x), 6) AS nearest FROM p WHERE {_BAND} GROUP BY frame")
def tilted_patches(spark: SparkSession, d: str) -> DataFrame:
    """Returns in the band of any tilted patch within the patch's stretch: a union of predicates, not a join."""
    return raw_points(spark, d).where(bg.in_bands(PATCHES, 0.2537)).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("nearest"))


@query("background_mask", "FIL-10")
def background_mask(spark: SparkSession, d: str) -> DataFrame:
    """Points on the patches whose normals agree, but for those that protrude or stand beside what does."""
    p = points(spark, d)
    n = rg.normals(rg.covariances(p, 2.0, 12), least=4)
    m = bg.mask(p, n, PATCHES, bg.MaskParams(0.25, 0.8, 0.5, 1.0, 0.5))
    return m.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("masked").alias("masked"), F.count_if("protects").alias("protruding"))


_SLABS = "greatest(least(18.0 / x, 24.0 / x), least(-1.1 / nullif(y, 0), 1.3 / nullif(y, 0)), least(0.45 / z, 3.1 / z)) AS near, least(greatest(18.0 / x, 24.0 / x), greatest(-1.1 / nullif(y, 0), 1.3 / nullif(y, 0)), greatest(0.45 / z, 3.1 / z)) AS far"


@query(
    "box_insertion", "GEN-3 GEN-1 AGG-23",
    f"""WITH {RAW}, t AS (SELECT *, {_SLABS} FROM p), h AS (SELECT frame, x, far >= near AND far > 0 AND near > 0 AND near < 1 AS hit, near FROM t)
    SELECT frame, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(min(CASE WHEN hit THEN x * near ELSE x END), 6) AS nearest, round(sum(CASE WHEN hit THEN x * near ELSE x END), 4) AS total FROM h GROUP BY frame""",
)
def box_insertion(spark: SparkSession, d: str) -> DataFrame:
    """A box put into recorded scans: a ray that meets it before its return ends there, what lies nearer hides it."""
    p = bg.insert_box(raw_points(spark, d), [18.0, -1.1, 0.45], [24.0, 1.3, 3.1])
    return p.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("inserted").alias("hits"), F.round(F.min("x"), 6).alias("nearest"), F.round(F.sum("x"), 4).alias("total"))


@query(
    "shared_curvature", "GEO-13 AGG-27",
    f"""WITH {RAW}, c AS (SELECT frame, ring, count(*) AS n, var_pop(x) AS xx, covar_pop(x * x, x) AS qx, var_pop(x * x) AS qq, covar_pop(x, y) AS xy, covar_pop(x * x, y) AS qy FROM p GROUP BY frame, ring HAVING count(*) >= 4 AND var_pop(x) > 0)
    SELECT frame, count(*) AS traces, round(1e6 * sum(n * (qy - qx * xy / xx)) / sum(n * (qq - qx * qx / xx)), 3) AS curvature FROM c GROUP BY frame""",
)
def shared_curvature(spark: SparkSession, d: str) -> DataFrame:
    """One curvature for all traces of a scan, each with its own offset and slope, in closed form from sums."""
    c = bg.shared_curvature(raw_points(spark, d), ["frame"], "ring", least=4)
    return c.select("frame", "traces", F.round(1e6 * F.col("curvature"), 3).alias("curvature"))


@query("surface_traces", "STR-13")
def surface_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces through the lateral places of successive steps along the track."""
    cells = raw_points(spark, d).groupBy("frame", F.floor(F.col("x") / 5).alias("step"), F.floor(F.col("y") / 0.4).alias("cell")).agg(F.avg("y").alias("value"))
    t = bg.chain_traces(cells, 0.35)
    return t.groupBy("frame", "trace").agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.round(F.avg("value"), 6).alias("place"))
