"""Queries over ordered result streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import episodes as ep
from ..sources.tables import RESULTS_SQL, results
from .registry import query

HOUR = 3_600_000_000_000
GAP = 8 * HOUR
BAG = "PARTITION BY bag ORDER BY ns"
ISLANDS = f"""c AS (SELECT *, CASE WHEN lag(status) OVER ({BAG}) = status THEN 0 ELSE 1 END AS ch FROM r),
 i AS (SELECT *, sum(ch) OVER ({BAG} ROWS UNBOUNDED PRECEDING) AS island FROM c),
 e AS (SELECT bag, island::BIGINT AS island, status, count(*) AS frames, min(ns) AS start_ns, max(ns) AS end_ns FROM i GROUP BY bag, island, status)"""
FLAGGED = f"g AS (SELECT *, ns - lag(ns) OVER ({BAG}) AS dt_ns FROM r)"


@query(
    "run_summary", "RPT-1 AGG-13 AGG-14 WIN-2 AGG-31",
    f"""WITH {RESULTS_SQL}, {ISLANDS}, s AS (SELECT bag, count(*) AS frames, count(*) FILTER (WHERE status = 'error') AS error_frames, count(DISTINCT status) AS statuses,
      round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM r GROUP BY bag),
    a AS (SELECT bag, count(*) FILTER (WHERE status = 'error') AS error_episodes, max(frames) AS longest_episode FROM e GROUP BY bag)
    SELECT * FROM s JOIN a USING (bag)""",
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Frames, statuses, exact latency quantiles and status episodes of each recording: one shuffle by recording serves all."""
    r = results(spark, d)
    w = ep.ordered()
    runs = ep.islands(r, F.lag("status").over(w).isNull() | (F.lag("status").over(w) != F.col("status")))
    runs = runs.withColumn("start", F.row_number().over(W.partitionBy("bag", "island").orderBy("ns")) == 1).withColumn("length", F.count("*").over(W.partitionBy("bag", "island")))
    g = runs.groupBy("bag").agg(
        F.count("*").alias("frames"), F.count_if(F.col("status") == "error").alias("error_frames"), F.count_distinct("status").alias("statuses"),
        F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q"),
        F.count_if((F.col("status") == "error") & F.col("start")).alias("error_episodes"), F.max("length").alias("longest_episode"),
    )
    return g.select("bag", "frames", "error_frames", "statuses", *[F.round(F.col("q")[i], 6).alias(p) for i, p in enumerate(("p50", "p95", "p99"))], "error_episodes", "longest_episode")


@query("status_counts", "AGG-13 RPT-5", f"WITH {RESULTS_SQL} SELECT status, count(*) AS n, count(DISTINCT bag) AS bags FROM r GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("bag").alias("bags"))


@query(
    "latency_quantiles", "AGG-14 AGG-15 RPT-21",
    f"WITH {RESULTS_SQL} SELECT status, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS least, max(value) AS most, round(sum(value::DECIMAL(18, 4)) / count(*), 6)::DOUBLE AS mean FROM r GROUP BY status",
)
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    mean = F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("*"), 6)
    g = results(spark, d).groupBy("status").agg(q.alias("q"), F.min("value").alias("least"), F.max("value").alias("most"), mean.alias("mean"))
    return g.select("status", *[F.round(F.col("q")[i], 6).alias(p) for i, p in enumerate(("p50", "p95", "p99"))], "least", "most", "mean")


@query(
    "scan_stream", "SRC-1 SRT-8 STR-1 FIL-19",
    f"""WITH {RESULTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY ns, frame) - 1 AS index, lag(ns) OVER (PARTITION BY bag ORDER BY ns, frame) AS b FROM r)
    SELECT bag, frame, ns, index::INTEGER AS index FROM n WHERE index % 3 = 0 AND (b IS NULL OR b < ns) QUALIFY row_number() OVER ({BAG}) <= 10""",
)
def scan_stream(spark: SparkSession, d: str) -> DataFrame:
    return ep.scan_stream(results(spark, d), 3, 10).select("bag", "frame", "ns", "index")


@query("gap_flags", "WIN-1 STR-2", f"WITH {RESULTS_SQL}, {FLAGGED} SELECT bag, count(*) AS frames, count(*) FILTER (WHERE dt_ns > {GAP}) AS gaps, count(*) FILTER (WHERE dt_ns <= 0) AS nonincreasing, max(dt_ns) AS longest_ns FROM g GROUP BY bag")
def gap_flags(spark: SparkSession, d: str) -> DataFrame:
    g = ep.gap_flags(results(spark, d), GAP)
    return g.groupBy("bag").agg(F.count("*").alias("frames"), F.count_if("gap").alias("gaps"), F.count_if("nonincreasing").alias("nonincreasing"), F.max("dt_ns").alias("longest_ns"))


@query("episodes", "WIN-2", f"WITH {RESULTS_SQL}, {ISLANDS} SELECT * FROM e")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    return ep.status_episodes(results(spark, d))


@query(
    "episodes_gap", "WIN-3 RPT-22",
    f"""WITH {RESULTS_SQL}, a AS (SELECT *, status IN ('error', 'purchase') AS alarm, ns - lag(ns) OVER ({BAG}) AS dt FROM r), p AS (SELECT *, lag(alarm) OVER ({BAG}) AS pa, coalesce(dt > {GAP}, false) AS gap FROM a)
    SELECT bag, count(*) AS frames, count(*) FILTER (WHERE alarm) AS alarm_frames, count(*) FILTER (WHERE alarm AND (dt IS NULL OR gap OR NOT pa)) AS alarm_episodes,
      coalesce(sum(dt) FILTER (WHERE NOT gap), 0)::BIGINT AS observed_ns, coalesce(sum(dt) FILTER (WHERE gap), 0)::BIGINT AS excluded_ns, coalesce(sum(dt) FILTER (WHERE NOT gap AND pa), 0)::BIGINT AS alarm_ns FROM p GROUP BY bag""",
)
def episodes_gap(spark: SparkSession, d: str) -> DataFrame:
    return ep.alarm_accounting(results(spark, d), F.col("status").isin("error", "purchase"), GAP)


FLAGS_SQL = f"""n AS (SELECT *, row_number() OVER ({BAG}) AS seq, coalesce(ns - lag(ns) OVER ({BAG}) > {GAP}, false) AS gap FROM r),
 f AS (SELECT bag, seq, gap, 'slow' AS kind, CASE WHEN value > 30 THEN 'very' ELSE 'some' END AS reason FROM n WHERE value > 10
  UNION ALL SELECT bag, seq, gap, 'odd', status FROM n WHERE k % 3 <> 0),
 s AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR seq - lag(seq) OVER w > 1 OR gap OR lag(reason) OVER w <> reason THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY bag, kind ORDER BY seq)),
 i AS (SELECT *, sum(st) OVER (PARTITION BY bag, kind ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM s),
 e AS (SELECT bag, kind, reason, count(*) AS frames, min(seq) AS start, max(seq) AS "end" FROM i GROUP BY bag, kind, island, reason)"""


@query(
    "top_episodes", "WIN-4 SRT-3 RPT-6",
    f"""WITH {RESULTS_SQL}, {FLAGS_SQL} SELECT bag, kind, reason, frames, start, "end", ((start + "end") // 2)::BIGINT AS representative,
    row_number() OVER (PARTITION BY bag, kind ORDER BY frames DESC, start)::INTEGER AS rank FROM e QUALIFY rank <= 3""",
)
def top_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The three longest episodes of each kind, with their middle scan."""
    n = ep.gap_flags(results(spark, d), GAP).withColumn("seq", F.row_number().over(ep.ordered()).cast("long"))
    slow = F.when(F.col("value") > 10, F.struct(F.lit("slow").alias("kind"), F.when(F.col("value") > 30, "very").otherwise("some").alias("reason")))
    odd = F.when(F.col("k") % 3 != 0, F.struct(F.lit("odd").alias("kind"), F.col("status").alias("reason")))
    flags = n.select("bag", "seq", "ns", "gap", F.explode(F.array_compact(F.array(slow, odd))).alias("f")).select("bag", "seq", "ns", "gap", "f.kind", "f.reason")
    e = ep.flag_episodes(flags, GAP)
    rank = F.row_number().over(W.partitionBy("bag", "kind").orderBy(F.desc("frames"), "start"))
    return e.withColumn("rank", rank).where("rank <= 3").select("bag", "kind", "reason", "frames", "start", "end", F.expr("(start + `end`) div 2").alias("representative"), "rank")


@query(
    "confirmation_hits", "WIN-5 STR-10",
    f"""WITH {RESULTS_SQL} SELECT bag, frame, count(*) FILTER (WHERE value > 5) OVER w AS hits, count(*) FILTER (WHERE value > 5) OVER w >= 3 AS confirmed FROM r
    WINDOW w AS (PARTITION BY bag ORDER BY frame RANGE BETWEEN 999 PRECEDING AND CURRENT ROW)""",
)
def confirmation_hits(spark: SparkSession, d: str) -> DataFrame:
    h = ep.hits_in_window(results(spark, d), F.col("value") > 5, "frame", 1000, ("bag",))
    return h.select("bag", "frame", "hits", (F.col("hits") >= 3).alias("confirmed"))


@query(
    "evidence_window", "WIN-6",
    f"WITH {RESULTS_SQL} SELECT bag, frame, count(DISTINCT k) OVER (PARTITION BY bag ORDER BY ns RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW)::INTEGER AS distinct FROM r",
)
def evidence_window(spark: SparkSession, d: str) -> DataFrame:
    return ep.distinct_in_window(results(spark, d), "k", 12 * HOUR).select("bag", "frame", "distinct")


@query("rolling_median", "WIN-7", f"WITH {RESULTS_SQL} SELECT bag, frame, round(median(value) OVER ({BAG} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS median FROM r")
def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return ep.rolling_median(results(spark, d), "value", 5).select("bag", "frame", F.round("median", 6).alias("median"))


@query("moving_average", "WIN-8", f"WITH {RESULTS_SQL} SELECT bag, frame, round(sum(k) OVER ({BAG} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS mean FROM r")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return ep.moving_average(results(spark, d), "k", 2).select("bag", "frame", F.round("mean", 6).alias("mean"))


@query(
    "second_difference", "WIN-9",
    f"""WITH {RESULTS_SQL}, s AS (SELECT bag, frame, abs(lag(k) OVER w - 2 * k + lead(k) OVER w) AS dd FROM r WINDOW w AS ({BAG})) SELECT bag, frame, dd, dd > 60 AS broken FROM s WHERE dd IS NOT NULL""",
)
def second_difference(spark: SparkSession, d: str) -> DataFrame:
    w = ep.ordered()
    s = results(spark, d).withColumn("dd", F.abs(F.lag("k").over(w) - 2 * F.col("k") + F.lead("k").over(w))).where("dd is not null")
    return s.select("bag", "frame", "dd", (F.col("dd") > 60).alias("broken"))


@query(
    "fit_holdout", "WIN-10 RPT-15 RPT-16 GEO-12",
    f"""WITH {RESULTS_SQL}, n AS (SELECT *, row_number() OVER ({BAG}) <= 20 AS fit FROM r) SELECT bag, count(*) FILTER (WHERE fit) AS fitted, count(*) FILTER (WHERE NOT fit) AS held_out,
    round(median(k) FILTER (WHERE fit), 6) AS fit_median, round(median(k) FILTER (WHERE NOT fit), 6) AS held_median FROM n GROUP BY bag""",
)
def fit_holdout(spark: SparkSession, d: str) -> DataFrame:
    """The first scans fit, strictly later ones are held out."""
    n = results(spark, d).withColumn("fit", F.row_number().over(ep.ordered()) <= 20)
    return n.groupBy("bag").agg(
        F.count_if("fit").alias("fitted"), F.count_if(~F.col("fit")).alias("held_out"), F.round(F.median(F.when(F.col("fit"), F.col("k"))), 6).alias("fit_median"), F.round(F.median(F.when(~F.col("fit"), F.col("k"))), 6).alias("held_median")
    )


@query("id_switches", "WIN-11 RPT-13", f"WITH {RESULTS_SQL}, s AS (SELECT bag, status <> lag(status) OVER ({BAG}) AS sw FROM r) SELECT bag, count(*) FILTER (WHERE sw) AS switches, count(*) AS frames FROM s GROUP BY bag")
def id_switches(spark: SparkSession, d: str) -> DataFrame:
    s = results(spark, d).withColumn("sw", F.lag("status").over(ep.ordered()) != F.col("status"))
    return s.groupBy("bag").agg(F.count_if("sw").alias("switches"), F.count("*").alias("frames"))


@query("first_last", "WIN-12 RPT-19", f"WITH {RESULTS_SQL} SELECT bag, status, arg_min(frame, ns) AS first_frame, arg_max(frame, ns) AS last_frame, arg_min(value, ns) AS first_value, arg_max(value, ns) AS last_value FROM r GROUP BY bag, status")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("bag", "status").agg(
        F.min_by("frame", "ns").alias("first_frame"), F.max_by("frame", "ns").alias("last_frame"), F.min_by("value", "ns").alias("first_value"), F.max_by("value", "ns").alias("last_value")
    )


@query(
    "value_clusters", "WIN-13",
    f"""WITH {RESULTS_SQL}, v AS (SELECT DISTINCT bag, value FROM r), s AS (SELECT *, CASE WHEN value - lag(value) OVER w > 2.5 THEN 1 ELSE 0 END AS st FROM v WINDOW w AS (PARTITION BY bag ORDER BY value)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY bag ORDER BY value ROWS UNBOUNDED PRECEDING) AS cluster FROM s) SELECT bag, cluster::BIGINT AS cluster, count(*) AS n, min(value) AS lo, max(value) AS hi FROM i GROUP BY bag, cluster""",
)
def value_clusters(spark: SparkSession, d: str) -> DataFrame:
    """One-dimensional clusters of sorted values, cut at gaps over 2.5."""
    v = results(spark, d).select("bag", "value").distinct()
    w = W.partitionBy("bag").orderBy("value")
    c = ep.islands(v, F.col("value") - F.lag("value").over(w) > 2.5, ("bag",), "value", "cluster")
    return c.groupBy("bag", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(
    "contiguous_run", "WIN-14 GEO-8",
    f"""WITH {RESULTS_SQL}, b AS (SELECT DISTINCT bag, floor(k / 5)::BIGINT AS cell FROM r), s AS (SELECT bag, cell, cell - row_number() OVER (PARTITION BY bag ORDER BY cell) AS g FROM b),
    f AS (SELECT bag, arg_min(g, cell) AS g FROM s GROUP BY bag) SELECT s.bag, min(cell) * 5 AS start, max(cell) * 5 + 5 AS "end" FROM s JOIN f ON s.bag = f.bag AND s.g = f.g GROUP BY s.bag""",
)
def contiguous_run(spark: SparkSession, d: str) -> DataFrame:
    """The supported stretch from the first supported station on, on a grid of 5."""
    b = results(spark, d).select("bag", F.floor(F.col("k") / 5).alias("cell")).distinct()
    w = W.partitionBy("bag").orderBy("cell")
    runs = b.withColumn("g", F.col("cell") - F.row_number().over(w)).withColumn("g0", F.first("g").over(w))
    return runs.where("g = g0").groupBy("bag").agg((F.min("cell") * 5).alias("start"), (F.max("cell") * 5 + 5).alias("end"))


@query(
    "clock_stats", "AGG-26 RPT-20",
    f"""WITH {RESULTS_SQL}, {FLAGGED}, m AS (SELECT bag, median(dt_ns) AS med FROM g GROUP BY bag)
    SELECT g.bag, count(dt_ns) AS steps, round(any_value(med) / 1e9, 9) AS median_s, count(*) FILTER (WHERE dt_ns = 0) AS duplicates, count(*) FILTER (WHERE dt_ns > 1.5 * med) AS gaps, round(quantile_cont(dt_ns, 0.95) / 1e9, 9) AS p95_s FROM g JOIN m ON g.bag = m.bag GROUP BY g.bag""",
)
def clock_stats(spark: SparkSession, d: str) -> DataFrame:
    g = ep.gap_flags(results(spark, d), GAP).withColumn("med", F.median("dt_ns").over(W.partitionBy("bag")))
    return g.groupBy("bag").agg(
        F.count("dt_ns").alias("steps"), F.round(F.first("med") / 1e9, 9).alias("median_s"), F.count_if(F.col("dt_ns") == 0).alias("duplicates"), F.count_if(F.col("dt_ns") > 1.5 * F.col("med")).alias("gaps"), F.round(F.percentile("dt_ns", F.lit(0.95)) / 1e9, 9).alias("p95_s")
    )


@query(
    "sessions", "STR-2",
    f"""WITH {RESULTS_SQL}, {FLAGGED}, s AS (SELECT *, sum(CASE WHEN dt_ns IS NULL OR dt_ns > {GAP} THEN 1 ELSE 0 END) OVER ({BAG} ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT bag, min(ns) AS start_ns, max(ns) AS end_ns, count(*) AS frames FROM s GROUP BY bag, s""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by Spark's session window: rows exactly one gap apart stay together, as they do in the reset rule."""
    r = results(spark, d).withColumn("ts", F.timestamp_micros(F.expr("ns div 1000")))
    s = r.groupBy("bag", F.session_window("ts", f"{GAP // 1_000_000_000} seconds")).agg(F.min("ns").alias("start_ns"), F.max("ns").alias("end_ns"), F.count("*").alias("frames"))
    return s.drop("session_window")


@query("newest_only", "STR-6 SRC-13", f"WITH {RESULTS_SQL} SELECT bag, arg_max(frame, ns) AS frame, max(ns) AS ns, arg_max(status, ns) AS status FROM r GROUP BY bag")
def newest_only(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("bag").agg(F.max_by(F.struct("frame", "ns", "status"), "ns").alias("m")).select("bag", "m.frame", "m.ns", "m.status")


@query(
    "counters", "STR-5",
    f"""WITH {RESULTS_SQL}, {FLAGGED} SELECT bag, count(*) AS received, count(*) FILTER (WHERE k < 5) AS invalid, count(*) FILTER (WHERE k >= 5 AND dt_ns = 0) AS duplicate,
    count(*) FILTER (WHERE k >= 5 AND dt_ns < 0) AS out_of_order, count(*) FILTER (WHERE k >= 5 AND (dt_ns IS NULL OR dt_ns > 0)) AS processed FROM g GROUP BY bag""",
)
def counters(spark: SparkSession, d: str) -> DataFrame:
    """Mutually exclusive outcomes of received scans; they add up to ``received``."""
    g = ep.gap_flags(results(spark, d), GAP)
    outcome = F.when(F.col("k") < 5, "invalid").when(F.col("dt_ns") == 0, "duplicate").when(F.col("dt_ns") < 0, "out_of_order").otherwise("processed")
    return g.withColumn("o", outcome).groupBy("bag").agg(F.count("*").alias("received"), *[F.count_if(F.col("o") == o).alias(o) for o in ("invalid", "duplicate", "out_of_order", "processed")])


@query(
    "health", "STR-15",
    f"""WITH {RESULTS_SQL}, h AS (SELECT frame, list_filter([CASE WHEN k % 5 = 0 THEN 'geometry_unavailable' END, CASE WHEN k % 7 = 0 THEN 'motion_unavailable' END, CASE WHEN value > 20 THEN 'slow' END], lambda x: x IS NOT NULL) AS reasons FROM r)
    SELECT frame, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) = 0 THEN 'normal' WHEN list_contains(reasons, 'geometry_unavailable') THEN 'unavailable' ELSE 'degraded' END AS health FROM h""",
)
def health(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("k") % 5 == 0, "geometry_unavailable"), F.when(F.col("k") % 7 == 0, "motion_unavailable"), F.when(F.col("value") > 20, "slow")))
    state = F.when(F.size("r") == 0, "normal").when(F.array_contains("r", "geometry_unavailable"), "unavailable").otherwise("degraded")
    return results(spark, d).select("frame", reasons.alias("r")).select("frame", F.array_join("r", ",").alias("reasons"), state.alias("health"))


@query(
    "refit_cadence", "FIL-20",
    f"""WITH {RESULTS_SQL}, t AS (SELECT *, sum(k) OVER ({BAG} ROWS UNBOUNDED PRECEDING) AS travel, row_number() OVER ({BAG}) AS n FROM r),
    s AS (SELECT *, floor(travel / 500)::BIGINT AS leg, (n - 1) // 8 AS batch FROM t), f AS (SELECT *, lag(leg) OVER ({BAG}) AS pl, lag(batch) OVER ({BAG}) AS pb FROM s)
    SELECT bag, count(*) AS frames, count(*) FILTER (WHERE pl IS NULL OR leg <> pl OR batch <> pb) AS refits FROM f GROUP BY bag""",
)
def refit_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Refits of a cached model: every 8 scans, or when travel passes another 500."""
    w = ep.ordered()
    t = results(spark, d).withColumns({"leg": F.floor(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, 0)) / 500), "batch": F.floor((F.row_number().over(w) - 1) / 8)})
    due = F.lag("leg").over(w).isNull() | (F.lag("leg").over(w) != F.col("leg")) | (F.lag("batch").over(w) != F.col("batch"))
    return t.withColumn("due", due).groupBy("bag").agg(F.count("*").alias("frames"), F.count_if("due").alias("refits"))


@query(
    "label_interpolation", "STR-14",
    f"""WITH {RESULTS_SQL}, l AS (SELECT *, CASE WHEN k % 4 = 0 THEN value END AS v FROM r),
    b AS (SELECT bag, frame, ns, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN ns END IGNORE NULLS) OVER p AS t0, first_value(v IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN v IS NOT NULL THEN ns END IGNORE NULLS) OVER n AS t1
      FROM l WINDOW p AS ({BAG} ROWS UNBOUNDED PRECEDING), n AS ({BAG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT bag, frame, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((ns - t0)::DOUBLE / (t1 - t0)) END, 6) AS value FROM b WHERE v0 IS NOT NULL AND v1 IS NOT NULL""",
)
def label_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Linear interpolation between labelled scans (k a multiple of 4)."""
    v = F.when(F.col("k") % 4 == 0, F.col("value"))
    t = F.when(F.col("k") % 4 == 0, F.col("ns"))
    before, after = ep.ordered().rowsBetween(W.unboundedPreceding, 0), ep.ordered().rowsBetween(0, W.unboundedFollowing)
    b = results(spark, d).withColumns({"v0": F.last(v, True).over(before), "t0": F.last(t, True).over(before), "v1": F.first(v, True).over(after), "t1": F.first(t, True).over(after)})
    share = (F.col("ns") - F.col("t0")).cast("double") / F.nullif(F.col("t1") - F.col("t0"), F.lit(0))
    value = F.when(F.col("t1") == F.col("t0"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * share)
    return b.where("v0 is not null and v1 is not null").select("bag", "frame", F.round(value, 6).alias("value"))


@query("top_gaps", "SRT-3 RPT-7", f"WITH {RESULTS_SQL}, {FLAGGED} SELECT bag, frame, dt_ns FROM g WHERE dt_ns IS NOT NULL ORDER BY dt_ns DESC, bag, frame LIMIT 20")
def top_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The 20 longest gaps (a report's own limit)."""
    return ep.gap_flags(results(spark, d), GAP).where("dt_ns is not null").select("bag", "frame", "dt_ns").orderBy(F.desc("dt_ns"), "bag", "frame").limit(20)


@query("systematic_sample", "SRT-6 RPT-23", f"WITH {RESULTS_SQL}, n AS (SELECT *, row_number() OVER ({BAG}) AS n FROM r) SELECT bag, frame, value FROM n WHERE (n - 1) % 5 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth scan of a recording (the operator's own step)."""
    return results(spark, d).withColumn("n", F.row_number().over(ep.ordered())).where("(n - 1) % 5 = 0").select("bag", "frame", "value")


@query(
    "frame_pairs", "JOIN-20 RPT-18",
    f"""WITH {RESULTS_SQL}, t AS (SELECT bag, frame, sum(k) OVER ({BAG} ROWS UNBOUNDED PRECEDING)::BIGINT AS travel FROM r) SELECT a.bag, a.frame AS early, b.frame AS late, b.travel - a.travel AS apart FROM t a JOIN t b ON a.bag = b.bag AND b.travel - a.travel BETWEEN 200 AND 260""",
)
def frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of scans whose travel differs by 200 to 260: bucketed, so each scan meets only its two neighbouring travel buckets."""
    t = results(spark, d).select("bag", "frame", F.sum("k").over(ep.ordered().rowsBetween(W.unboundedPreceding, 0)).alias("travel"))
    size = 60
    a = t.select("bag", F.col("frame").alias("early"), F.col("travel").alias("ta"), F.explode(F.sequence(F.floor((F.col("travel") + 200) / size), F.floor((F.col("travel") + 260) / size))).alias("b"))
    b = t.select("bag", F.col("frame").alias("late"), F.col("travel").alias("tb"), F.floor(F.col("travel") / size).alias("b"))
    apart = F.col("tb") - F.col("ta")
    return a.join(b, ["bag", "b"]).where(apart.between(200, 260)).select("bag", "early", "late", apart.alias("apart"))


@query(
    "neighbour_track", "JOIN-22",
    f"""WITH {RESULTS_SQL}, n AS (SELECT bag, status AS track, row_number() OVER ({BAG}) AS n, value FROM r)
    SELECT a.bag, a.n, a.track, p.value AS previous, q.value AS next FROM n a LEFT JOIN n p ON p.bag = a.bag AND p.track = a.track AND p.n = a.n - 1 LEFT JOIN n q ON q.bag = a.bag AND q.track = a.track AND q.n = a.n + 1""",
)
def neighbour_track(spark: SparkSession, d: str) -> DataFrame:
    """The same track in the scan before and after: lag and lead over the recording instead of two self-joins."""
    w = ep.ordered()
    same = lambda f: F.when(f("status").over(w) == F.col("status"), f("value").over(w))
    return results(spark, d).select("bag", F.row_number().over(w).cast("long").alias("n"), F.col("status").alias("track"), same(F.lag).alias("previous"), same(F.lead).alias("next"))
