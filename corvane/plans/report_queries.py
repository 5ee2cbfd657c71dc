"""Joins, set operations, comparisons, evaluation and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as fn
from ..operators import compare as cp
from ..operators import evaluate as ev
from ..operators import objects as ob
from ..sources.tables import table
from .registry import query


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as boxes of a scan (order): (frame, id, label, x0, y0, z0, x1, y1, z1). Ids number each order's items."""
    order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    x, y, z = F.col("l_quantity") / 4, F.col("l_discount") * 100, F.col("l_tax") * 100
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame"), order.cast("long").alias("id"), F.col("l_returnflag").alias("label"),
        x.alias("x0"), y.alias("y0"), z.alias("z0"), (x + 4).alias("x1"), (y + 6).alias("y1"), (z + 5).alias("z1"),
    )


BOXES = """b AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id,
  l_returnflag AS label, l_quantity / 4 AS x0, l_discount * 100 AS y0, l_tax * 100 AS z0, l_quantity / 4 + 4 AS x1, l_discount * 100 + 6 AS y1, l_tax * 100 + 5 AS z1 FROM lineitem)"""
OVERLAP = "greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) * greatest(0, least(p.z1, t.z1) - greatest(p.z0, t.z0))"
VOLUMES = "(p.x1 - p.x0) * (p.y1 - p.y0) * (p.z1 - p.z0) + (t.x1 - t.x0) * (t.y1 - t.y0) * (t.z1 - t.z0)"
IOU = f"(CASE WHEN {VOLUMES} - {OVERLAP} > 0 THEN {OVERLAP} / ({VOLUMES} - {OVERLAP}) ELSE 0 END)"
LO, HI = ("x0", "y0", "z0"), ("x1", "y1", "z1")


def prediction_pairs(b: DataFrame) -> DataFrame:
    """Every prediction (flag other than R) with every truth box (flag R) of its scan: an equi-join by scan."""
    p = b.where("label <> 'R'").select("frame", *[F.col(c).alias(f"p_{c}") for c in ("id", *LO, *HI)])
    t = b.where("label = 'R'").select("frame", *[F.col(c).alias(f"t_{c}") for c in ("id", *LO, *HI)])
    side = lambda s, cs: [F.col(f"{s}_{c}") for c in cs]
    return p.join(t, "frame").withColumn("iou", fn.box_iou(side("p", LO), side("p", HI), side("t", LO), side("t", HI)))


@query(
    "best_iou", "JOIN-8 RPT-12",
    f"""WITH {BOXES}, j AS (SELECT t.frame, t.id AS truth, p.id AS prediction, {IOU} AS iou FROM b t JOIN b p ON t.frame = p.frame AND t.label = 'R' AND p.label <> 'R')
    SELECT frame, truth, prediction, round(iou, 6) AS iou FROM j QUALIFY row_number() OVER (PARTITION BY frame, truth ORDER BY iou DESC, prediction) = 1""",
)
def best_iou(spark: SparkSession, d: str) -> DataFrame:
    """The prediction of most overlap for each label; the first of equals."""
    best = F.max_by(F.struct(F.col("p_id").alias("prediction"), "iou"), F.struct("iou", -F.col("p_id"))).alias("m")
    return prediction_pairs(boxes(spark, d)).groupBy("frame", F.col("t_id").alias("truth")).agg(best).select("frame", "truth", "m.prediction", F.round("m.iou", 6).alias("iou"))


@query("box_intersections", "JOIN-7 RPT-4", f"WITH {BOXES} SELECT p.frame, p.id AS prediction, t.id AS truth FROM b p JOIN b t ON p.frame = t.frame AND p.label <> 'R' AND t.label = 'R' AND p.x0 <= t.x1 AND t.x0 <= p.x1 AND p.y0 <= t.y1 AND t.y0 <= p.y1 AND p.z0 <= t.z1 AND t.z0 <= p.z1")
def box_intersections(spark: SparkSession, d: str) -> DataFrame:
    touch = F.lit(True)
    for a, b in zip(LO, HI, strict=True):
        touch = touch & (F.col(f"p_{a}") <= F.col(f"t_{b}")) & (F.col(f"t_{a}") <= F.col(f"p_{b}"))
    return prediction_pairs(boxes(spark, d)).where(touch).select("frame", F.col("p_id").alias("prediction"), F.col("t_id").alias("truth"))


@query("box_containment", "JOIN-6 RPT-8", f"WITH {BOXES} SELECT p.frame, p.id AS inner_id, t.id AS outer_id FROM b p JOIN b t ON p.frame = t.frame AND p.label <> 'R' AND t.label = 'R' AND p.x0 >= t.x0 - 1.5 AND p.x1 <= t.x1 + 1.5 AND p.y0 >= t.y0 - 1.5 AND p.y1 <= t.y1 + 1.5 AND p.z0 >= t.z0 - 1.5 AND p.z1 <= t.z1 + 1.5")
def box_containment(spark: SparkSession, d: str) -> DataFrame:
    inside = F.lit(True)
    for a, b in zip(LO, HI, strict=True):
        inside = inside & (F.col(f"p_{a}") >= F.col(f"t_{a}") - 1.5) & (F.col(f"p_{b}") <= F.col(f"t_{b}") + 1.5)
    return prediction_pairs(boxes(spark, d)).where(inside).select("frame", F.col("p_id").alias("inner_id"), F.col("t_id").alias("outer_id"))


@query(
    "box_key_match", "JOIN-5",
    f"""WITH {BOXES}, k AS (SELECT *, [round_even(x0 * 1e7, 0)::BIGINT, round_even(y0 * 1e7, 0)::BIGINT] AS key FROM b), o AS (SELECT frame, key, max(id) AS id FROM k WHERE label = 'A' GROUP BY ALL), n AS (SELECT frame, key, max(id) AS id FROM k WHERE label = 'N' GROUP BY ALL)
    SELECT o.frame, o.id AS old_id, n.id AS new_id FROM o JOIN n USING (frame, key)""",
)
def box_key_match(spark: SparkSession, d: str) -> DataFrame:
    """Same-place boxes of two runs by rounded key; the last of repeated keys counts."""
    k = boxes(spark, d).withColumn("key", cp.rounded_key([F.col("x0"), F.col("y0")]))
    side = lambda flag, name: k.where(F.col("label") == flag).groupBy("frame", "key").agg(F.max("id").alias(name))
    return side("A", "old_id").join(side("N", "new_id"), ["frame", "key"]).select("frame", "old_id", "new_id")


RUNS = """x AS (SELECT o_orderkey AS frame, o_orderstatus AS status, o_totalprice AS value, o_orderpriority AS reason FROM orders WHERE o_orderpriority <> '5-LOW'),
 y AS (SELECT o_orderkey AS frame, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS status, o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 0.5 WHEN o_orderkey % 13 = 0 THEN 1e-12 ELSE 0 END AS value, o_orderpriority AS reason FROM orders WHERE o_orderpriority <> '1-URGENT')"""


def two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the orders: the second lacks other frames and changes some statuses and values."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    before = o.where("o_orderpriority <> '5-LOW'").select(k.alias("frame"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("reason"))
    bump = F.when(k % 11 == 0, 0.5).when(k % 13 == 0, 1e-12).otherwise(0.0)
    after = o.where("o_orderpriority <> '1-URGENT'").select(k.alias("frame"), F.when(k % 7 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") + bump).alias("value"), F.col("o_orderpriority").alias("reason"))
    return before, after


@query(
    "run_diff", "JOIN-3 DIF-1 DIF-4",
    f"""WITH {RUNS}, j AS (SELECT frame, x.status AS os, y.status AS ns, x.value AS ov, y.value AS nv FROM x JOIN y USING (frame))
    SELECT frame, 'status' AS path, os AS "old", ns AS "new" FROM j WHERE os <> ns UNION ALL SELECT frame, 'value', NULL, NULL FROM j WHERE abs(ov - nv) > 1e-10 + 1e-10 * greatest(abs(ov), abs(nv))""",
)
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf that differs beyond tolerance between rows of two runs (numbers' texts are left out of the result)."""
    diff = cp.deep_difference(*two_runs(spark, d), ["frame"])
    text = lambda c: F.when(F.col("path") != "value", F.col(c)).alias(c)
    return diff.select("frame", "path", text("old"), text("new"))


@query("run_transitions", "DIF-3", f"WITH {RUNS} SELECT x.status || ' -> ' || y.status AS change, count(*) AS n FROM x JOIN y USING (frame) WHERE x.status <> y.status GROUP BY 1")
def run_transitions(spark: SparkSession, d: str) -> DataFrame:
    return cp.transitions(*two_runs(spark, d), ["frame"], "status")


@query("key_sets", "SET-1 SET-2 JOIN-3", f"WITH {RUNS} SELECT CASE WHEN x.frame IS NULL THEN 'extra' WHEN y.frame IS NULL THEN 'missing' ELSE 'common' END AS kind, count(*) AS n FROM x FULL JOIN y ON x.frame = y.frame GROUP BY 1")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    p = cp.presence(*two_runs(spark, d), ["frame"])
    kind = F.when(~F.col("in_before"), "extra").when(~F.col("in_after"), "missing").otherwise("common")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("subset_violations", "SET-3", f"WITH {RUNS} SELECT frame FROM x WHERE frame NOT IN (SELECT frame FROM y)")
def subset_violations(spark: SparkSession, d: str) -> DataFrame:
    before, after = two_runs(spark, d)
    return before.select("frame").join(after.select("frame"), "frame", "left_anti")


@query("labelled_frames", "SET-5 FIL-19 SNK-8", "WITH l AS (SELECT doc_id FROM labels), e AS (SELECT doc_id FROM documents WHERE lang = 'en') SELECT doc_id, doc_id IN (SELECT doc_id FROM l) AS labelled, doc_id IN (SELECT doc_id FROM e) AS exhaustive FROM (SELECT doc_id FROM l UNION SELECT doc_id FROM e)")
def labelled_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames that are labelled or declared exhaustive."""
    declared = table(spark, d, "documents").where("lang = 'en'")
    p = cp.presence(table(spark, d, "labels"), declared, ["doc_id"])
    return p.select("doc_id", F.col("in_before").alias("labelled"), F.col("in_after").alias("exhaustive"))


@query("multiset_difference", "SET-6 AGG-30", f"WITH {RUNS}, a AS (SELECT status, reason FROM x), b AS (SELECT status, reason FROM y), d AS (SELECT 'before' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'after', * FROM (FROM b EXCEPT ALL FROM a)) SELECT side, status, reason, count(*) AS n FROM d GROUP BY ALL")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """Rows that one run has more often than the other. Counts by value and side, not sorted copies."""
    before, after = two_runs(spark, d)
    both = before.select("status", "reason", F.lit(1).alias("v")).unionByName(after.select("status", "reason", F.lit(-1).alias("v")))
    g = both.groupBy("status", "reason").agg(F.sum("v").alias("v")).where("v <> 0")
    return g.select(F.when(F.col("v") > 0, "before").otherwise("after").alias("side"), "status", "reason", F.abs("v").alias("n"))


@query("concat_runs", "SET-7 RPT-9", f"WITH {RUNS}, u AS (SELECT 'before' AS run, * FROM x UNION ALL SELECT 'after', * FROM y) SELECT run, status, count(*) AS n, max(value) AS most FROM u GROUP BY run, status")
def concat_runs(spark: SparkSession, d: str) -> DataFrame:
    before, after = two_runs(spark, d)
    u = before.withColumn("run", F.lit("before")).unionByName(after.withColumn("run", F.lit("after")))
    return u.groupBy("run", "status").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("eval_join", "JOIN-1", "SELECT count(*) AS truth_frames, count(d.doc_id) AS found, count(*) - count(d.doc_id) AS missing_frames FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 6 <> 1) d USING (doc_id)")
def eval_join(spark: SparkSession, d: str) -> DataFrame:
    """Truth frames with and without a prediction row; missing ones are counted, not dropped."""
    predictions = table(spark, d, "documents").where("doc_id % 6 <> 1").select("doc_id", F.lit(1).alias("there"))
    j = table(spark, d, "labels").join(predictions, "doc_id", "left")
    return j.agg(F.count("*").alias("truth_frames"), F.count("there").alias("found"), (F.count("*") - F.count("there")).alias("missing_frames"))


@query("semi_frames", "JOIN-4 SRC-7", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def semi_frames(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


CONFUSION = "e AS (SELECT source, exhaustive, p, t FROM (SELECT source, doc_id % 4 <> 0 AS exhaustive, n_chars > 1500 AS p, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)))"


@query(
    "confusion", "AGG-17 RPT-2 GEN-6",
    f"""WITH {CONFUSION}, c AS (SELECT source, count(*) FILTER (WHERE exhaustive AND p AND t) AS tp, count(*) FILTER (WHERE exhaustive AND p AND NOT t) AS fp, count(*) FILTER (WHERE exhaustive AND NOT p AND t) AS fn FROM e WHERE exhaustive GROUP BY source)
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates by source over exhaustive frames only; null where a denominator is zero."""
    j = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id").where("doc_id % 4 <> 0")
    p, t = F.col("n_chars") > 1500, F.col("toxic") == 1
    c = j.groupBy("source").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return c.select("source", "tp", "fp", "fn", *ev.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


@query("event_recall", "AGG-18", f"WITH {BOXES}, e AS (SELECT label AS event_id, frame, id, x0, y0 > 5 AS matched FROM b) SELECT event_id, count(*) AS annotated, count(*) FILTER (WHERE matched) AS matched, arg_min(x0, frame * 100 + id) FILTER (WHERE matched) AS first_distance FROM e GROUP BY event_id")
def event_recall(spark: SparkSession, d: str) -> DataFrame:
    """Annotated and matched frames of each event and the distance at its first match."""
    e, m = boxes(spark, d), F.col("y0") > 5
    return e.groupBy(F.col("label").alias("event_id")).agg(F.count("*").alias("annotated"), F.count_if(m).alias("matched"), F.min_by("x0", F.when(m, F.struct("frame", "id"))).alias("first_distance"))


@query("mask_metrics", "AGG-19 RPT-17", "WITH m AS (SELECT l_returnflag AS scene, l_quantity > 25 AS p, l_discount > 0.04 AS t FROM lineitem), c AS (SELECT scene, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn FROM m GROUP BY scene) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def mask_metrics(spark: SparkSession, d: str) -> DataFrame:
    p, t = F.col("l_quantity") > 25, F.col("l_discount") > 0.04
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("scene")).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return c.select("scene", "tp", "fp", "fn", *ev.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


@query(
    "grouping_sets", "AGG-20 RPT-14",
    "WITH o AS (SELECT floor(p_size / 10)::BIGINT AS size_bucket, p_brand AS brand, p_type AS kind, p_retailprice > 1200 AS hit FROM part) SELECT size_bucket, brand, kind, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM o GROUP BY GROUPING SETS ((size_bucket), (brand), (kind))",
)
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Outcome tables by three axes in one pass over the cases."""
    cases = table(spark, d, "part").selectExpr("floor(p_size / 10) AS size_bucket", "p_brand AS brand", "p_type AS kind", "p_retailprice > 1200 AS hit")
    sets = [[F.col(c)] for c in ("size_bucket", "brand", "kind")]
    return cases.groupingSets(sets, "size_bucket", "brand", "kind").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(
    "box_coverage", "AGG-21",
    f"""WITH {BOXES}, q AS (SELECT frame, id, x0 + 4 * (i + 0.5) / 4 AS x, y0 + 6 * (j + 0.5) / 4 AS y FROM b, range(4) s(i), range(4) u(j) WHERE label = 'R'), h AS (SELECT frame, id, x, y, EXISTS (SELECT 1 FROM b p WHERE p.frame = q.frame AND p.label <> 'R' AND q.x BETWEEN p.x0 AND p.x1 AND q.y BETWEEN p.y0 AND p.y1) AS covered FROM q)
    SELECT frame, id, count(*) FILTER (WHERE covered) AS covered, count(*) AS samples FROM h GROUP BY frame, id""",
)
def box_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a 4 x 4 sample of each label box that any prediction of its scan covers."""
    b = boxes(spark, d)
    others = b.where("label <> 'R'").groupBy("frame").agg(F.collect_list(F.struct("x0", "x1", "y0", "y1")).alias("ps"))  # a scan's boxes are few
    grid = F.array(*[F.struct(F.lit(4 * (i + 0.5) / 4).alias("dx"), F.lit(6 * (j + 0.5) / 4).alias("dy")) for i in range(4) for j in range(4)])
    hit = lambda g: F.exists(F.coalesce("ps", F.array()), lambda p: (F.col("x0") + g.dx).between(p.x0, p.x1) & (F.col("y0") + g.dy).between(p.y0, p.y1))
    r = b.where("label = 'R'").join(others, "frame", "left")
    return r.select("frame", "id", F.size(F.filter(grid, hit)).cast("long").alias("covered"), F.size(grid).cast("long").alias("samples"))


@query("point_coverage", "AGG-22", f"WITH {BOXES} SELECT t.frame, t.id, count(*) AS returns, count(*) FILTER (WHERE q.p) AS claimed FROM b t JOIN (SELECT frame, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, label = 'A' AS p FROM b WHERE label <> 'R') q ON q.frame = t.frame AND t.label = 'R' AND q.x BETWEEN t.x0 AND t.x1 AND q.y BETWEEN t.y0 AND t.y1 GROUP BY t.frame, t.id")
def point_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of the returns inside each label box, how many a prediction claims."""
    b = boxes(spark, d)
    q = b.where("label <> 'R'").select("frame", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("label") == "A").alias("p"))
    t = b.where("label = 'R'").select("frame", "id", *LO, *HI)
    j = t.join(q, "frame").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return j.groupBy("frame", "id").agg(F.count("*").alias("returns"), F.count_if("p").alias("claimed"))


@query("label_stats", "AGG-28", "SELECT p_type AS kind, p_brand AS obj, count(*) AS n FROM part GROUP BY p_type, p_brand")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("obj")).agg(F.count("*").alias("n"))


@query("distinct_poses", "AGG-30", "SELECT o_orderpriority AS run, count(DISTINCT sha256(o_orderstatus || '|' || o_custkey::VARCHAR)) AS patterns FROM orders GROUP BY 1")
def distinct_poses(spark: SparkSession, d: str) -> DataFrame:
    """Distinct bit patterns, by digest."""
    digest = F.sha2(F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string")).cast("binary"), 256)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count_distinct(digest).alias("patterns"))


SEGMENTS = [(i, f"2000-{i + 1:02d}-01", f"2000-{i + 1:02d}-21") for i in range(12)]


@query(
    "segment_asof", "JOIN-19",
    "WITH s(segment, a, b) AS (VALUES " + ", ".join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, a, b in SEGMENTS) + ") SELECT segment, count(*) AS n, min(o_orderkey) AS first_key FROM orders JOIN s ON o_orderdate BETWEEN a AND b GROUP BY segment",
)
def segment_asof(spark: SparkSession, d: str) -> DataFrame:
    """The segment that holds a record: the last start at or before it, then the end check. Segments are a short broadcast list."""
    kind = dict(table(spark, d, "orders").dtypes)["o_orderdate"]
    s = spark.createDataFrame(SEGMENTS, "segment int, a string, b string").select("segment", F.col("a").cast(kind), F.col("b").cast(kind))
    j = table(spark, d, "orders").join(F.broadcast(s), F.col("o_orderdate").between(F.col("a"), F.col("b")))
    return j.groupBy("segment").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("case_grid", "JOIN-24 GEN-6", "SELECT r.r_name AS range_name, s AS size, t AS side, r.r_regionkey * 100 + s * 10 + t AS case_id FROM region r, range(3) a(s), range(-1, 2) b(t) UNION ALL SELECT 'negative', NULL, NULL, -1 - i FROM range(2) c(i)")
def case_grid(spark: SparkSession, d: str) -> DataFrame:
    """The product of an experiment's axes (fixed lists, exploded) with its negatives."""
    r = table(spark, d, "region")
    g = r.withColumn("size", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))).withColumn("side", F.explode(F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])))
    grid = g.select(F.col("r_name").alias("range_name"), "size", "side", (F.col("r_regionkey") * 100 + F.col("size") * 10 + F.col("side")).alias("case_id"))
    none = F.lit(None).cast("long")
    return grid.unionByName(spark.range(2).select(F.lit("negative").alias("range_name"), none.alias("size"), none.alias("side"), (-1 - F.col("id")).alias("case_id")))


@query(
    "ranked_components", "SRT-2 JOIN-23",
    "WITH c AS (SELECT l_orderkey AS frame, l_suppkey AS component, count(*) AS points FROM lineitem GROUP BY ALL) SELECT frame, component, points, row_number() OVER (PARTITION BY frame ORDER BY points DESC, component)::INTEGER AS rank FROM c",
)
def ranked_components(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_suppkey").alias("component")).agg(F.count("*").alias("points"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("frame").orderBy(F.desc("points"), "component")))


@query("evidence_audit", "AGG-16", "WITH e AS (SELECT user_id AS bag, list(epoch_us(ts) // 86400000000 ORDER BY ts) AS days, min(epoch_us(ts)) AS t0 FROM events GROUP BY user_id) SELECT bag, len(days) AS n, len(days) <> len(list_distinct(days)) AS repeated, len(list_filter(days, lambda x: x > t0 // 86400000000 + 20)) > 0 AS late FROM e")
def evidence_audit(spark: SparkSession, d: str) -> DataFrame:
    """Repeated and too-late entries in evidence lists."""
    from ..sources.tables import micros

    e = table(spark, d, "events")
    day = F.floor(micros(e, "ts") / 86_400_000_000)
    by_day = e.groupBy(F.col("user_id").alias("bag"), day.alias("day")).agg(F.count("*").alias("n"))
    return by_day.groupBy("bag").agg(F.sum("n").alias("n"), (F.max("n") > 1).alias("repeated"), (F.max("day") > F.min("day") + 20).alias("late"))


OBJECTS = """o AS (SELECT o_orderkey AS id, o_custkey % 500 AS frame, CASE o_orderkey % 5 WHEN 0 THEN 'intersecting' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'unknown' ELSE 'adjacent' END AS relation,
 o_orderkey % 3 AS certified, o_orderkey % 4 AS structural, o_orderkey % 7 AS unmeasured, o_orderkey % 6 AS boundary, CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 10) / 10 END AS structure_distance, o_orderkey % 2 = 0 AS confirmed, o_orderkey % 4 = 0 AS certain FROM orders)"""


def scan_objects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    relation = F.when(k % 5 == 0, "intersecting").when(k % 5 == 1, "unresolved").when(k % 5 == 2, "unknown").otherwise("adjacent")
    return table(spark, d, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 500).alias("frame"), relation.alias("relation"), (k % 3).alias("certified"), (k % 4).alias("structural"), (k % 7).alias("unmeasured"), (k % 6).alias("boundary"),
        F.when(k % 8 != 0, (k % 10) / 10).alias("structure_distance"), (k % 2 == 0).alias("confirmed"), (k % 4 == 0).alias("certain"),
    )


@query(
    "decision", "FIL-13 FIL-14",
    f"""WITH {OBJECTS}, f AS (SELECT *, relation IN ('intersecting', 'unresolved') AS hz, relation NOT IN ('intersecting', 'unresolved') AND boundary >= 2 AND (structure_distance IS NULL OR structure_distance > 0.3) AS db FROM o),
    g AS (SELECT frame, count(*) FILTER (WHERE hz) AS hazards, count(*) FILTER (WHERE db) AS doubts, count(*) FILTER (WHERE NOT hz AND unmeasured > 0) AS range_unknown, bool_or(hz AND confirmed AND certain) AS c, bool_or(hz AND confirmed) AS f, bool_and(relation <> 'unknown') AS v FROM f GROUP BY frame)
    SELECT frame, hazards, doubts, range_unknown, CASE WHEN c THEN 'obstacle' WHEN f THEN 'unresolved_obstacle' WHEN hazards > 0 OR doubts > 0 THEN 'candidate' WHEN v THEN 'no_obstacle_observed' ELSE 'unknown' END AS status FROM g""",
)
def decision(spark: SparkSession, d: str) -> DataFrame:
    return ob.frame_status(scan_objects(spark, d), ("frame",), 2, 0.3, F.col("relation") != "unknown")


@query(
    "relation_reasons", "FIL-15",
    f"""WITH {OBJECTS}, r AS (SELECT relation, CASE WHEN relation = 'unknown' THEN 'geometry_unavailable' WHEN relation = 'intersecting' AND certified > 0 THEN 'inside_heuristic_path_and_ground_interval' WHEN relation = 'intersecting' THEN 'certified_interior_shared_with_structure'
    WHEN relation = 'unresolved' THEN 'envelope_boundary_uncertainty' WHEN structural > 0 THEN 'structure_crossing_envelope' WHEN unmeasured > 0 THEN 'unmeasured_corridor' WHEN boundary > 0 THEN 'envelope_boundary_uncertainty' ELSE 'outside_envelope_evidence' END AS reason FROM o)
    SELECT relation, reason, count(*) AS n FROM r GROUP BY ALL""",
)
def relation_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = ob.relation_reason(*[F.col(c) for c in ("relation", "certified", "structural", "unmeasured", "boundary")])
    return scan_objects(spark, d).groupBy("relation", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("compact_candidates", "AGG-6", f"WITH {OBJECTS} SELECT frame, count(*) AS n, min(structure_distance) AS nearest FROM o WHERE boundary >= 2 AND relation <> 'unknown' AND structural = 0 AND NOT (certified = 1) GROUP BY frame")
def compact_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Objects with enough inside support that are compact and neither attached, continuous nor periodic."""
    keep = (F.col("boundary") >= 2) & (F.col("relation") != "unknown") & (F.col("structural") == 0) & ~(F.col("certified") == 1)
    return scan_objects(spark, d).where(keep).groupBy("frame").agg(F.count("*").alias("n"), F.min("structure_distance").alias("nearest"))


@query("evidence_split", "AGG-6", f"WITH {OBJECTS} SELECT frame, relation, count(*) FILTER (WHERE certified > 0) AS certified, count(*) FILTER (WHERE structural > 0) AS structural, count(*) FILTER (WHERE unmeasured > 0) AS unmeasured, count(*) FILTER (WHERE boundary > 0) AS boundary, min(structure_distance) AS lo, max(structure_distance) AS hi FROM o GROUP BY frame, relation")
def evidence_split(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count_if(F.col(c) > 0).alias(c) for c in ("certified", "structural", "unmeasured", "boundary")]
    return scan_objects(spark, d).groupBy("frame", "relation").agg(*counts, F.min("structure_distance").alias("lo"), F.max("structure_distance").alias("hi"))


@query("distance_summary", "OBJ-4", f"WITH {OBJECTS} SELECT frame, min(structure_distance) FILTER (WHERE relation = 'intersecting') AS intersecting, min(structure_distance) FILTER (WHERE relation = 'unresolved') AS unresolved, min(structure_distance) AS any_object FROM o GROUP BY frame")
def distance_summary(spark: SparkSession, d: str) -> DataFrame:
    of = lambda r: F.min(F.when(F.col("relation") == r, F.col("structure_distance"))).alias(r)
    return scan_objects(spark, d).groupBy("frame").agg(of("intersecting"), of("unresolved"), F.min("structure_distance").alias("any_object"))


@query(
    "annotation_violations", "FIL-19 FIL-18",
    f"""WITH {BOXES}, v AS (SELECT frame, 'duplicate_event' AS kind FROM b GROUP BY frame, label HAVING count(*) > 1 UNION ALL SELECT frame, 'no_volume' FROM b WHERE NOT (x1 > x0 AND y1 > y0 AND z1 > z0) UNION ALL SELECT frame, 'unknown_label' FROM b WHERE label NOT IN ('A', 'N'))
    SELECT kind, count(*) AS n, min(frame) AS first_frame FROM v GROUP BY kind""",
)
def annotation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Constraint queries: an event once per frame, positive volume, known labels."""
    b = boxes(spark, d)
    twice = b.groupBy("frame", "label").count().where("count > 1").select("frame", F.lit("duplicate_event").alias("kind"))
    row = F.array_compact(F.array(F.when(~((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("z1") > F.col("z0"))), F.lit("no_volume")), F.when(~F.col("label").isin("A", "N"), F.lit("unknown_label"))))
    return twice.unionByName(b.select("frame", F.explode(row).alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"))


@query(
    "label_checks", "RPT-24",
    f"""WITH {BOXES}, s AS (SELECT *, (x1 - x0) * (1 + (id % 4) / 50.0) AS size FROM b), m AS (SELECT *, avg(size) OVER (PARTITION BY label, id % 4 > 1) AS mean, lag(y0) OVER (PARTITION BY label, id ORDER BY frame) AS before FROM s)
    SELECT label, count(*) FILTER (WHERE abs(size / mean - 1) > 0.005) AS odd_size, count(*) FILTER (WHERE abs(y0 - before) > 5) AS jumps, count(*) AS n FROM m GROUP BY label""",
)
def label_checks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes whose size strays from their object's mean, and jumps between consecutive labelled frames."""
    s = boxes(spark, d).withColumn("size", (F.col("x1") - F.col("x0")) * (1 + (F.col("id") % 4) / 50.0))
    means = s.groupBy("label", (F.col("id") % 4 > 1).alias("g")).agg(F.avg("size").alias("mean"))
    m = s.withColumn("g", F.col("id") % 4 > 1).join(F.broadcast(means), ["label", "g"])  # one row per object class
    m = m.withColumn("before", F.lag("y0").over(W.partitionBy("label", "id").orderBy("frame")))
    return m.groupBy("label").agg(F.count_if(F.abs(F.col("size") / F.col("mean") - 1) > 0.005).alias("odd_size"), F.count_if(F.abs(F.col("y0") - F.col("before")) > 5).alias("jumps"), F.count("*").alias("n"))


@query("header_scan", "SRC-5", "SELECT source AS topic, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT text) AS messages FROM documents GROUP BY source")
def header_scan(spark: SparkSession, d: str) -> DataFrame:
    """Count, bounds and distinct messages by topic."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return docs.groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("text").alias("messages"))
