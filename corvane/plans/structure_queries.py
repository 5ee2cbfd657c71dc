"""Growing logs, recurrences over scans, interval joins and differences of free JSON, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import jsontree as jt
from ..operators import ranges
from ..sources import archives, growing, recordings
from ..sources.shared import shared_folder
from ..sources.tables import RESULTS_SQL, results, table
from ..streaming import fanout, live
from .registry import query
from .stream_queries import GAP

LOGGED = "bag long, frame long, ns long, status string, value double"
LOG_SQL = f"WITH {RESULTS_SQL} SELECT bag, count(*) AS n, min(frame) AS first_frame, max(ns) AS last_ns, count(*) FILTER (WHERE status = 'error') AS errors, round(max(value), 6) AS most FROM r GROUP BY bag"


def result_log(spark: SparkSession, d: str) -> str:
    """The results as lines of JSON in a folder of logs."""
    at = f"{shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    results(spark, d).select(F.to_json(F.struct("bag", "frame", "ns", "status", "value")).alias("line")).write.text(at)
    return at


def by_bag(lines: DataFrame) -> DataFrame:
    r = lines.select(F.from_json("line", LOGGED).alias("r")).select("r.*")
    return r.groupBy("bag").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("ns").alias("last_ns"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.max("value"), 6).alias("most"))


@query("growing_log", "SRC-8", LOG_SQL)
def growing_log(spark: SparkSession, d: str) -> DataFrame:
    """A result log read by byte positions, in pieces that end within lines."""
    return by_bag(growing.read_log(spark, result_log(spark, d), piece=1 << 18))


@query("growing_log_stream", "SRC-8", LOG_SQL)
def growing_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same log as a stream of its complete lines."""
    return by_bag(live.run_available(growing.stream_log(spark, result_log(spark, d), piece=1 << 18), shared_folder(spark)))


#: Rounding by a shifted floor: velocities are sums of halves, which often lie on the ties of rounding.
_COARSE = "floor({} * 1000 + 0.3141592::DOUBLE)::BIGINT"


@query(
    "label_prediction", "STR-14",
    f"""WITH RECURSIVE {RESULTS_SQL}, n AS (SELECT *, row_number() OVER w AS seq, lag(ns) OVER w AS pns, lag(value) OVER w AS pv FROM r WINDOW w AS (PARTITION BY bag ORDER BY ns, frame)),
    f AS (SELECT bag, frame, seq, value, value - pv AS dx, coalesce(ns - pns > {GAP}, true) AS start FROM n),
    v AS (SELECT bag, seq, frame, value, true AS started, 0::DOUBLE AS v FROM f WHERE seq = 1
      UNION ALL SELECT f.bag, f.seq, f.frame, f.value, f.start, CASE WHEN f.start THEN 0 WHEN v.started THEN f.dx ELSE 0.5 * v.v + 0.5 * f.dx END FROM v JOIN f ON f.bag = v.bag AND f.seq = v.seq + 1)
    SELECT bag, frame, {_COARSE.format('v')} AS velocity, {_COARSE.format('(value + v)')} AS predicted FROM v""",
)
def label_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Where each recording's value goes next: half the last step, half the velocity before; the first step counts whole, and a gap starts anew."""

    def step(before):
        start = F.coalesce(F.col("ns") - before("ns") > GAP, F.lit(True))
        half = F.when(~start, 0.5 * (F.col("value") - before("value")))
        # The second component says that a row started: the step after it has no velocity to be averaged with.
        return [[F.when(~start, 0.5), half], [0.0, 0.0]], [half, start.cast("double")]

    v = ranges.affine_scan(results(spark, d), ["bag"], ["ns", "frame"], ["ns", "value"], step, ["v", "started"])
    coarse = lambda x: F.floor(x * 1000 + 0.3141592).cast("long")
    return v.select("bag", "frame", coarse(F.col("v")).alias("velocity"), coarse(F.col("value") + F.col("v")).alias("predicted"))


EPOCH = "1992-01-01"
_DAY = "date_diff('day', DATE '1992-01-01', {}::DATE)"


def day(col: str) -> Column:
    return F.datediff(F.col(col).cast("date"), F.lit(EPOCH).cast("date")).cast("long")


@query(
    "interval_pairs", "JOIN-19",
    f"""WITH i AS (SELECT l_suppkey AS span, min({_DAY.format('l_shipdate')}) AS a, min({_DAY.format('l_shipdate')}) + l_suppkey % 700 AS b FROM lineitem GROUP BY l_suppkey), o AS (SELECT o_orderkey, {_DAY.format('o_orderdate')} AS dd FROM orders)
    SELECT span, count(*) AS n, min(o_orderkey) AS first_key, sum(dd - a)::BIGINT AS total FROM o JOIN i ON dd BETWEEN a AND b GROUP BY span""",
)
def interval_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every order with every supplier's interval that holds its day: overlapping intervals of any length, from a table.

    What is asked of the pairs are sums and minima, so the orders of a day meet the intervals as one record: the work grows with the intervals' days.
    """
    i = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("span")).agg(F.min(day("l_shipdate")).alias("a")).withColumn("b", F.col("a") + F.col("span") % 700)
    days = table(spark, d, "orders").groupBy(day("o_orderdate").alias("dd")).agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first"))
    j = iv.interval_join(days, i, "dd", "a", "b")
    return j.groupBy("span").agg(F.sum("orders").alias("n"), F.min("first").alias("first_key"), F.sum((F.col("dd") - F.col("a")) * F.col("orders")).alias("total"))


@query(
    "segment_states", "JOIN-19",
    f"""WITH s AS (SELECT o_orderpriority AS kind, date_trunc('month', o_orderdate)::DATE AS month, min({_DAY.format('o_orderdate')}) AS a, min({_DAY.format('o_orderdate')}) + 19 AS b FROM orders GROUP BY ALL),
    r AS (SELECT o_orderpriority AS kind, {_DAY.format('l_shipdate')} AS dd, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    j AS (SELECT r.kind, r.dd, r.l_orderkey, s.a, s.b FROM r ASOF LEFT JOIN s ON r.kind = s.kind AND r.dd >= s.a)
    SELECT kind, a AS start, CASE WHEN a IS NULL THEN 'before' WHEN dd <= b THEN 'inside' ELSE 'outside' END AS state, count(*) AS n, min(l_orderkey) AS first_key FROM j GROUP BY ALL""",
)
def segment_states(spark: SparkSession, d: str) -> DataFrame:
    """Each line's segment of its kind, by a sweep: the last that started, and whether it still ran. Segments come from a table."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("kind"), "o_orderdate")
    s = o.groupBy("kind", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.min(day("o_orderdate")).alias("a")).withColumn("b", F.col("a") + 19)
    r = table(spark, d, "lineitem").select("l_orderkey", day("l_shipdate").alias("dd")).join(o.drop("o_orderdate"), "l_orderkey")
    found = iv.segment_of(r, s, "dd", "a", "b", ["kind"])
    return found.groupBy("kind", F.col("segment.a").alias("start"), "state").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


def order_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders with their lines as JSON, twice: the second misses some keys and lines, and has other values and kinds in places."""
    k = F.col("id")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("qty"), F.array("l_returnflag", "l_linestatus").alias("tags"), F.col("l_extendedprice").alias("price")).alias("line"))
    lines = lines.groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("items"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("prio")).join(lines, "id")
    kept = F.when(k % 7 == 0, F.slice("items", F.lit(1), F.size("items") - 1)).otherwise(F.col("items"))
    changed = F.transform(kept, lambda x: F.struct(x["n"].alias("n"), F.when(k % 11 != 0, x["qty"]).alias("qty"), F.when(k % 11 == 0, "many").alias("count"), F.when(k % 3 == 0, F.reverse(x["tags"])).otherwise(x["tags"]).alias("tags"), (x["price"] + F.when(k % 13 == 0, 1.0).otherwise(0.0)).alias("price")))
    before = F.struct("id", F.struct("status", "total", "prio").alias("meta"), "items")
    after = F.struct("id", F.struct(F.when(k % 17 != 0, F.col("status")).alias("status"), "total", F.when(k % 5 != 0, F.col("prio")).alias("prio")).alias("meta"), changed.alias("items"))
    return o.select("id", F.to_json(before).alias("doc")), o.select("id", F.to_json(after).alias("doc"))


DOCUMENTS_SQL = """l AS (SELECT l_orderkey AS id, list({'n': l_linenumber, 'qty': l_quantity, 'tags': [l_returnflag, l_linestatus], 'price': l_extendedprice} ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus, l_extendedprice) AS items FROM lineitem GROUP BY l_orderkey),
 o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS prio, items FROM orders JOIN l ON o_orderkey = id),
 b AS (SELECT id, to_json({'id': id, 'meta': {'status': status, 'total': total, 'prio': prio}, 'items': items}) AS j FROM o),
 cut AS (SELECT *, CASE WHEN id % 7 = 0 THEN items[1:len(items) - 1] ELSE items END AS kept FROM o),
 a AS (SELECT id, json_object('id', id, 'meta', CASE WHEN id % 17 <> 0 AND id % 5 <> 0 THEN json_object('status', status, 'total', total, 'prio', prio) WHEN id % 17 <> 0 THEN json_object('status', status, 'total', total) WHEN id % 5 <> 0 THEN json_object('total', total, 'prio', prio) ELSE json_object('total', total) END,
   'items', to_json(list_transform(kept, lambda x: CASE WHEN id % 11 <> 0 THEN json_object('n', x.n, 'qty', x.qty, 'tags', CASE WHEN id % 3 = 0 THEN list_reverse(x.tags) ELSE x.tags END, 'price', x.price + CASE WHEN id % 13 = 0 THEN 1.0 ELSE 0.0 END)
     ELSE json_object('n', x.n, 'count', 'many', 'tags', CASE WHEN id % 3 = 0 THEN list_reverse(x.tags) ELSE x.tags END, 'price', x.price + CASE WHEN id % 13 = 0 THEN 1.0 ELSE 0.0 END) END))) AS j FROM cut)"""
_TREE = "SELECT x.id, t.fullkey AS path, t.path AS parent, t.key, CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN lower(t.type) WHEN t.type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'number' WHEN t.type = 'VARCHAR' THEN 'string' ELSE lower(t.type) END AS kind, CASE t.type WHEN 'ARRAY' THEN json_array_length(t.value)::VARCHAR WHEN 'OBJECT' THEN len(json_keys(t.value))::VARCHAR ELSE json_extract_string(t.value, '$') END AS value FROM {} x, json_tree(x.j) t"


@query(
    "json_difference", "DIF-2",
    f"""WITH {DOCUMENTS_SQL}, tb AS ({_TREE.format('b')}), ta AS ({_TREE.format('a')}),
    m AS (SELECT coalesce(tb.id, ta.id) AS id, coalesce(tb.path, ta.path) AS path, coalesce(tb.parent, ta.parent) AS parent, tb.kind AS bk, ta.kind AS ak, tb.value AS old, ta.value AS new FROM tb FULL JOIN ta ON tb.id = ta.id AND tb.path = ta.path),
    s AS (SELECT id, path, ak AS within FROM m WHERE bk = ak AND ak IN ('object', 'array')),
    c AS (SELECT *, CASE WHEN bk IS NULL THEN 'added' WHEN ak IS NULL THEN 'removed' WHEN bk <> ak THEN 'kind' WHEN ak = 'array' AND old <> new THEN 'length' WHEN ak NOT IN ('object', 'array') AND old IS DISTINCT FROM new THEN 'value' END AS change FROM m),
    f AS (SELECT c.id, substr(c.path, 3) || CASE WHEN change = 'length' THEN '.length' ELSE '' END AS path, change, old, new FROM c JOIN s ON s.id = c.id AND s.path = c.parent WHERE change IS NOT NULL AND (within = 'object' OR change NOT IN ('added', 'removed')))
    SELECT id, path, change, CASE WHEN bkind THEN round(old::DOUBLE, 3)::VARCHAR ELSE old END AS old, CASE WHEN bkind THEN round(new::DOUBLE, 3)::VARCHAR ELSE new END AS new,
      change = 'removed' AND (path = 'meta.prio' OR regexp_matches(path, '^items\\[\\d+\\]\\.qty$') OR path = 'meta.status' AND old = 'O') AS allowed FROM (SELECT *, path LIKE '%.price' AND change = 'value' AS bkind FROM f)""",
)
def json_difference(spark: SparkSession, d: str) -> DataFrame:
    """What two runs' documents say differently, whatever their shape, and which removals a plan allows."""
    allowed = spark.sql("VALUES ('meta.prio', NULL), ('items[*].qty', NULL), ('meta.status', 'O') AS t(pattern, value)")
    found = jt.json_difference(*order_documents(spark, d), ["id"], "doc", allowed)
    price = F.col("path").endswith(".price") & (F.col("change") == "value")
    return found.withColumns({c: F.when(price, F.round(F.col(c).cast("double"), 3).cast("string")).otherwise(F.col(c)) for c in ("old", "new")})


@query(
    "json_named_keys", "DIF-5",
    f"WITH {DOCUMENTS_SQL}, t AS (SELECT * FROM ({_TREE.format('a')}) UNION ALL SELECT NULL, '$.' || key, '$', key, 'any', NULL FROM (SELECT unnest(json_keys(props)) AS key FROM events)) SELECT regexp_replace(substr(path, 3), '\\[\\d+\\]', '[*]', 'g') AS pattern, kind, count(*) AS n FROM t WHERE key IN ('qty', 'count', 'prio', 'k') GROUP BY ALL",
)
def json_named_keys(spark: SparkSession, d: str) -> DataFrame:
    """Where documents still have keys that were to go, at any depth."""
    _, after = order_documents(spark, d)
    names, props = ["qty", "count", "prio", "k"], table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("doc"))
    found = jt.json_tree(after, ["id"], "doc", only=names).unionByName(jt.json_tree(props, ["id"], "doc", only=names).withColumn("kind", F.lit("any")))
    return found.groupBy(jt.pattern(F.col("path")).alias("pattern"), "kind").agg(F.count("*").alias("n"))


@query("archived_results", "SRC-11", f"WITH {RESULTS_SQL} SELECT (bag % 3)::VARCHAR AS archive, bag::VARCHAR || '.jsonl' AS member, count(*) AS n, min(frame) AS first_frame, max(ns) AS last_ns, count(DISTINCT status) AS statuses FROM r GROUP BY ALL")
def archived_results(spark: SparkSession, d: str) -> DataFrame:
    """Each recording's result lines as a member of an archive, read back by member with digests checked."""
    line = F.to_json(F.struct("bag", "frame", "ns", "status", "value"))
    r = results(spark, d).groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("ns", "frame", line.alias("line")))).alias("rows"))  # a member is one recording's file
    text = F.concat(F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n"))
    at = f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    told = archives.write_archives(r.select((F.col("bag") % 3).cast("string").alias("archive"), F.concat(F.col("bag").cast("string"), F.lit(".jsonl")).alias("member"), text.cast("binary").alias("content")), at)
    back = archives.read_archives(spark, at, "*.jsonl", manifest=told)
    rows = back.select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("archive"), "member", F.from_json(F.col("content").cast("string"), LOGGED).alias("r"))
    return rows.groupBy("archive", "member").agg(F.count("*").alias("n"), F.min("r.frame").alias("first_frame"), F.max("r.ns").alias("last_ns"), F.count_distinct("r.status").alias("statuses"))


@query(
    "stream_outputs", "SNK-4 SNK-5 SNK-2",
    f"""WITH {RESULTS_SQL}, g AS (SELECT *, ns - lag(ns) OVER (PARTITION BY bag ORDER BY ns, frame) AS dt FROM r) SELECT 'results' AS output, bag, count(*) AS n, max(ns) AS last_ns FROM g GROUP BY bag
    UNION ALL SELECT 'timing', bag, count(*), max(ns) FROM g WHERE value IS NOT NULL GROUP BY bag UNION ALL SELECT 'health', bag, count(*), max(ns) FROM g WHERE coalesce(dt, 1) > 0 AND value < 20 OR dt > {GAP} OR dt = 0 GROUP BY bag
    UNION ALL SELECT 'objects', bag, 2 * count(*), max(ns) FROM g WHERE status = 'purchase' GROUP BY bag UNION ALL SELECT 'poses', bag, count(*), max(ns) FROM g WHERE coalesce(dt, 1) > 0 GROUP BY bag""",
)
def stream_outputs(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the live stream to five tables: results, timing, objects, health and poses, each batch committed for all at once."""
    at = f"{shared_folder(spark).rstrip('/')}/outputs-{uuid.uuid4().hex}"
    told = live.read_events(spark, d).withColumn("returns", F.col("value"))
    stream = live.monitor(told, GAP, 20)
    values = results(spark, d).select("bag", "frame", F.col("status").alias("event"), "value")  # the batch's own columns that the state leaves out
    with_values = lambda b: b.join(values, ["bag", "frame"])
    both = F.array(F.lit("first"), F.lit("second"))
    outputs = {
        "results": lambda b: b.select("bag", "frame", "ns", "status", "outcome"),
        "timing": lambda b: with_values(b).where("value is not null").select("bag", "frame", "ns", "value"),
        "objects": lambda b: with_values(b).where("event = 'purchase'").select("bag", "frame", "ns", F.explode(both).alias("object")),
        "health": lambda b: b.where("reset is not null or outcome = 'duplicate'").select("bag", "frame", "ns", "reset"),
        "poses": lambda b: b.where("outcome = 'processed'").select("bag", "frame", "ns", "processed"),
    }
    fanout.fan_out(stream, at, f"{at}/_checkpoint", outputs).awaitTermination()
    parts = [fanout.read_output(spark, at, n, "bag long, frame long, ns long").select(F.lit(n).alias("output"), "bag", "ns") for n in outputs]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("output", "bag").agg(F.count("*").alias("n"), F.max("ns").alias("last_ns"))


#: A segment of a recording: fifteen days of it.
SEGMENT_NS = 15 * 86_400_000_000_000
SEGMENTED = f"s AS (SELECT bag, frame, ns, status, value, ns // {SEGMENT_NS} AS segment FROM r)"


def recording_folder(spark: SparkSession, d: str) -> str:
    """The results as recordings in a folder a segment, with every seventh recording disabled."""
    at = f"{shared_folder(spark).rstrip('/')}/recordings-{uuid.uuid4().hex}"
    r = results(spark, d)
    recordings.write_recordings(r.select("bag", F.floor(F.col("ns") / SEGMENT_NS).alias("segment"), "frame", "ns", "status", "value"), at)
    recordings.disable(r.select("bag").distinct().where("bag % 7 = 3"), at)
    return at


@query(
    "partial_recordings", "SRC-6",
    f"""WITH {RESULTS_SQL}, {SEGMENTED}, w AS (SELECT bag, segment FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE status = 'error') >= 2), k AS (SELECT *, segment - row_number() OVER (PARTITION BY bag ORDER BY segment) AS run FROM w),
    t AS (SELECT bag, segment, min(segment) OVER (PARTITION BY bag, run) AS stretch FROM k WHERE bag % 7 <> 3) SELECT bag, stretch, count(DISTINCT segment) AS segments, count(*) AS n, min(frame) AS first_frame, max(ns) AS last_ns FROM s JOIN t USING (bag, segment) GROUP BY bag, stretch""",
)
def partial_recordings(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each recording whose segments have errors, read from their own folders only."""
    at = recording_folder(spark, d)
    seg = F.floor(F.col("ns") / SEGMENT_NS).alias("segment")
    wanted = results(spark, d).groupBy("bag", seg).agg(F.count_if(F.col("status") == "error").alias("n")).where("n >= 2").select("bag", "segment")
    r = recordings.read_segments(spark, at, wanted, "frame long, ns long, status string, value double")
    return r.groupBy("bag", "stretch").agg(F.count_distinct("segment").alias("segments"), F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("ns").alias("last_ns"))


@query(
    "recording_catalogue", "SRC-12",
    f"WITH {RESULTS_SQL}, {SEGMENTED} SELECT bag::VARCHAR AS bag, count(DISTINCT segment) AS segments, min(segment)::BIGINT AS first, max(segment)::BIGINT AS last, true AS sized, bag % 7 = 3 AS disabled FROM s GROUP BY bag",
)
def recording_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """What recordings there are, from the index beside them."""
    c = recordings.catalogue(spark, recording_folder(spark, d))
    return c.select("bag", "segments", "first", "last", (F.col("scans") >= F.col("segments")).alias("sized"), "disabled")
