"""Growing logs, range scans, interval joins and JSON differences: against brute force, restarts and unusual tables."""

from __future__ import annotations

import json
import os
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from corvane.operators import intervals as iv
from corvane.operators import jsontree as jt
from corvane.operators import ranges
from corvane.sources import growing

# --- growing logs ----------------------------------------------------------------------------------------------------


def drain(spark, log, out, piece=7):
    growing.stream_log(spark, log, piece).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted((os.path.basename(r.file), r.offset, r.line) for r in spark.read.schema(growing.SCHEMA).parquet(f"{out}/rows").collect())


def complete_lines(folder):
    found = []
    for f in sorted(os.listdir(folder)):
        if not f.startswith(("_", ".")):
            at = 0
            for line in open(f"{folder}/{f}", "rb").read().split(b"\n")[:-1]:
                found.append((f, at, line.decode()))
                at += len(line) + 1
    return sorted(found)


def test_a_growing_log_loses_and_doubles_nothing(spark, tmp_path):
    """Half a line between batches, new files, restarts from the checkpoint: every batch is a new query. Batch equals stream."""
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    os.makedirs(log)
    rng = random.Random(4)
    for step in range(4):
        for name in ("a.jsonl", "b.jsonl")[: 1 + (step > 1)]:
            with open(f"{log}/{name}", "ab") as f:
                text = "".join(json.dumps({"step": step, "k": k, "é": "x" * rng.randrange(20)}, ensure_ascii=False) + "\n" for k in range(rng.randrange(4))) + "\n" * rng.randrange(2) + "half a li"
                f.write(text.encode() if step % 2 else b"ne ends\n" + text.encode()[: -rng.randrange(1, 9)])
        open(f"{log}/_hidden", "w").write("not a log\n")
        want = complete_lines(log)
        assert drain(spark, log, out) == want
        for piece in (1 + step, 1 << 20):
            assert sorted((os.path.basename(r.file), r.offset, r.line) for r in growing.read_log(spark, log, piece).collect()) == want
    assert drain(spark, log, out) == want


def test_replaced_logs_are_errors_and_offsets_are_addresses(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    os.makedirs(log)
    open(f"{log}/a", "w").write("one\ntwo\nthree\n")
    assert len(drain(spark, log, out)) == 3
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for r in growing.read_log(spark, log, 4).collect():
            assert [x.line for x in growing.read_log(spark, log, 4).where((F.col("file") == r.file) & (F.col("offset") == r.offset)).collect()] == [r.line]
        assert [r.line for r in growing.read_log(spark, log, 5).where("offset > 3 and offset < 8").collect()] == ["two"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    open(f"{log}/a", "w").write("x\n")
    with pytest.raises(Exception, match="replaced or truncated"):
        drain(spark, log, out)
    open(f"{log}/a", "w").write("another text that is longer\n")
    with pytest.raises(Exception, match="was replaced"):
        drain(spark, log, out)
    os.remove(f"{log}/a")
    with pytest.raises(Exception, match="is gone"):
        drain(spark, log, out)
    with pytest.raises(Exception, match="no log at"):
        growing.read_log(spark, f"{log}/none").collect()


# --- recurrences over ranges -----------------------------------------------------------------------------------------


def recordings(rng, keys=(None, 1, 2, 3)):
    return [(k, t, float(rng.randrange(1000)), rng.random() < 0.1) for k in keys for t in range({1: 700, 2: 1}.get(k, 40))]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_affine_scan_equals_the_loop(spark, parts):
    """Recordings over many ranges, ranges of one row, resets, null keys; two components that need each other."""
    rows_ = recordings(random.Random(2))
    df = spark.createDataFrame(rows_, "k long, t long, x double, r boolean").repartition(5)

    def step(before):
        return [[F.when(~F.col("r"), 0.5), (F.col("x") - before("x")) / 3000], [0.25, F.when(F.col("r"), -0.5)]], [F.col("x"), F.coalesce(before("x"), F.lit(3.0))]

    got = {(r.k, r.t): (r.v, r.w) for r in ranges.affine_scan(df, ["k"], ["t"], ["x"], step, ["v", "w"], parts).collect()}
    assert len(got) == len(rows_)
    state, last = {}, {}
    for k, t, x, r in rows_:
        v, w = state.get(k, (0.0, 0.0))
        p = last.get(k)
        state[k] = (((0 if r else 0.5) * v + ((x - p) / 3000 if p is not None else 0) * w) + x, 0.25 * v + (-0.5 if r else 0) * w + (3.0 if p is None else p))
        last[k] = x
        assert got[k, t] == pytest.approx(state[k], rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError, match="__part"):
        ranges.affine_scan(df.withColumn("__part", F.lit(1)), ["k"], ["t"], ["x"], step, ["v", "w"])
    assert ranges.affine_scan(df.limit(0), ["k"], ["t"], ["x"], step, ["v", "w"]).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_last_seen_equals_the_loop(spark, parts):
    rows_ = recordings(random.Random(3))
    df = spark.createDataFrame(rows_, "k long, t long, x double, r boolean")
    got = {(r.k, r.t): r.s for r in ranges.last_seen(df, ["k"], ["t"], F.when(F.col("r"), F.col("x")), "s", parts).collect()}
    seen = {}
    for k, t, x, r in rows_:
        seen[k] = x if r else seen.get(k)
        assert got[k, t] == seen[k]


def test_no_task_of_a_scan_holds_a_recording(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    out = ranges.affine_scan(df, ["k"], ["t"], ["x"], lambda before: ([[1.0]], [F.col("x")]), ["n"], parts=16)
    assert out.where("n <> t + 1").count() == 0
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 20_000 or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


# --- intervals -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("salt_rows", [100_000, 3])
def test_interval_join_equals_brute_force(spark, salt_rows):
    """Negative places, lengths from nothing to everything, repeats, nulls, ends before starts; hot bins dealt over salts."""
    rng = random.Random(6)
    spans = [(i, rng.choice(["a", "b", None]), s := rng.randrange(-500, 500), s + rng.choice([0, 1, 3, 4, 5, 16, 17, 900, 4096])) for i in range(60)]
    spans += [(60, "a", 5, 4), (61, "a", None, 9), (62, "a", 9, None), spans[0]]
    points = [(i, rng.choice(["a", "b", None]), rng.randrange(-600, 600)) for i in range(150)] + [(150, "a", 7)] * 9 + [(151, "a", None)]
    r, s = spark.createDataFrame(points, "p long, k string, at long"), spark.createDataFrame(spans, "i long, k string, a long, b long")
    got = sorted((x.p, x.i) for x in iv.interval_join(r, s, "at", "a", "b", ["k"], salt_rows).collect())
    inside = lambda t, a, b: None not in (t, a, b) and a <= t <= b
    assert got == sorted((p, i) for p, k, t in points for i, k2, a, b in spans if k is not None and k == k2 and inside(t, a, b))
    got = sorted((x.p, x.i) for x in iv.interval_join(r.drop("k"), s, "at", "a", "b", salt_rows=salt_rows).collect())
    assert got == sorted((p, i) for p, k, t in points for i, k2, a, b in spans if inside(t, a, b))
    assert iv.interval_join(r, s.limit(0), "at", "a", "b", ["k"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        iv.interval_join(r, s, "at", "a", "b")


def test_segments_are_swept_without_a_broadcast_of_them(spark):
    rng = random.Random(7)
    starts = sorted(rng.sample(range(0, 1000, 3), 40))
    segments = [(i, "x", a, min(a + rng.choice([0, 5, 40]), b)) for i, (a, b) in enumerate(pairwise([*starts, 2000]))] + [(99, "y", 500, 600), (98, "y", 500, 700)]
    points = [(i, rng.choice("xyz"), rng.randrange(-5, 1100)) for i in range(300)]
    r, s = spark.createDataFrame(points, "p long, k string, at long"), spark.createDataFrame(segments, "i long, k string, a long, b long")
    out = iv.segment_of(r, s, "at", "a", "b", ["k"], parts=7)
    got = {x.p: (x.segment.i if x.segment else None, x.state) for x in out.collect()}
    for p, k, t in points:
        began = [(a, b, str(i), i) for i, k2, a, b in segments if k2 == k and a <= t]
        want = max(began)[3] if began else None
        end = next((b for i, _, _, b in segments if i == want), None)
        assert got[p] == (want, "before" if want is None else "inside" if t <= end else "outside")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = iv.interval_join(r, s.withColumnRenamed("k", "k2"), "at", "a", "b")._jdf.queryExecution().toString()
        assert "BroadcastExchange" not in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- free JSON -------------------------------------------------------------------------------------------------------


def tree_of(v, path="", parent=None, key=None):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}[type(v)]
    value = {"object": lambda: str(len(v)), "array": lambda: str(len(v)), "boolean": lambda: str(v).lower(), "null": lambda: None}.get(kind, lambda: str(v))()
    yield path, parent, key, kind, value
    if kind == "object":
        for k, x in v.items():
            simple = k and all(c.isascii() and (c.isalnum() or c in "_-") for c in k)
            quoted = k.replace("\\", "\\\\").replace('"', '\\"')
            yield from tree_of(x, (f"{path}.{k}" if path else k) if simple else f'{path}["{quoted}"]', path, k)
    for i, x in enumerate(v if kind == "array" else ()):
        yield from tree_of(x, f"{path}[{i}]", path)


def difference_of(a, b, path=""):
    if type(a) is not type(b):
        yield path, "kind"
    elif isinstance(a, dict):
        for k in a.keys() | b.keys():
            child = f"{path}.{k}" if path else k
            if k not in a or k not in b:
                yield child, "added" if k in b else "removed"
            else:
                yield from difference_of(a[k], b[k], child)
    elif isinstance(a, list):
        if len(a) != len(b):
            yield f"{path}.length", "length"
        for i, (x, y) in enumerate(zip(a, b, strict=False)):
            yield from difference_of(x, y, f"{path}[{i}]")
    elif a != b:
        yield path, "value"


def anything(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return [None, True, rng.randrange(3), 2.5, "x[{\\\"", "é"][kind]
    return [anything(rng, depth - 1) for _ in range(rng.randrange(4))] if kind == 6 else {k: anything(rng, depth - 1) for k in rng.sample("abcde", rng.randrange(5))}


def altered(rng, v):
    if isinstance(v, dict):
        return {k: altered(rng, x) for k, x in v.items() if rng.random() > 0.1} | ({"new": 1} if rng.random() < 0.1 else {})
    if isinstance(v, list):
        return [altered(rng, x) for x in v][: None if rng.random() > 0.2 else -1]
    return v if rng.random() > 0.1 else rng.choice([0, "other", None, 2.5])


def test_json_trees_and_differences_equal_the_definition(spark):
    rng = random.Random(8)
    before = [(i, anything(rng, 4)) for i in range(150)]
    after = [(i, altered(rng, v)) for i, v in before]
    odd = [(1000, {"a.b": {"[0]": 1, 'q"\\': [0]}, "": 1})]
    frame = lambda rows_: spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in rows_], "id long, doc string")
    got = sorted((r.id, r.path, r.parent or "", r.key or "", r.kind, r.value or "") for r in jt.json_tree(frame(before + odd), ["id"], "doc").collect())
    assert got == sorted((i, *(x or "" for x in row)) for i, v in before + odd for row in tree_of(v))
    got = sorted((r.id, r.path, r.change) for r in jt.json_difference(frame(before), frame(after), ["id"], "doc").collect())
    want = sorted((i, p, c) for (i, a), (_, b) in zip(before, after, strict=True) for p, c in difference_of(a, b))
    assert got == want and {c for _, _, c in want} == {"added", "removed", "kind", "length", "value"}


def test_json_differences_of_odd_documents_and_allowed_removals(spark):
    b = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"a": 1, "a": 2}'), (4, "7"), (None, '{"m": {"x": 1, "y": [{"z": 1}]}}'), (6, "{}")], "id long, doc string")
    a = spark.createDataFrame([(1, "{}"), (2, "no json"), (3, "{}"), (4, "7.0"), (None, '{"m": {"y": [{}]}}'), (7, "[]")], "id long, doc string")
    plan = spark.createDataFrame([("m.x", "2"), ("m.y[*].z", None)], "pattern string, value string")
    got = {(r.id, r.path): (r.change, r.allowed) for r in jt.json_difference(b, a, ["id"], "doc", plan).collect()}
    assert got == {(1, ""): ("kind", False), (3, ""): ("kind", False), (4, ""): ("kind", False), (None, "m.x"): ("removed", False), (None, "m.y[0].z"): ("removed", True), (6, ""): ("removed", False), (7, ""): ("added", False)}
    assert jt.json_difference(b.limit(0), a.limit(0), ["id"], "doc").count() == 0
    assert [r.path for r in jt.named_keys(jt.json_tree(b, ["id"], "doc"), ["z"]).collect()] == ["m.y[0].z"]


def test_differences_tell_values_as_trees_do(spark):
    """Numbers, halves of surrogate pairs, texts that end early or late: both say the same; equal numbers written otherwise don't differ."""
    told = ["1", "-0", "007", "1.0", "-0.0", "-0e0", "1e2", "1E400", "0.1e-5", "12345678901234567890", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1" * 60, "0." + "3" * 50, "100000000.5", '"x\\ud800y"', '"\\u0000"', "true", "null", "[1, [2]]", '{"k": {}}', "NaN", "tru", "1x", '"a" b', "{} {", "\n 5\t6", "", "[1,]", '{"a": 1, "b": {"c": 1, "c": 2}}', "'q'"]
    docs = spark.createDataFrame(list(enumerate(told)), "id long, doc string")
    want = {r.id: (r.kind, r.value) for r in jt.json_tree(docs, ["id"], "doc").where("path = ''").collect()}
    got = {r.id: r.old for r in jt.json_difference(docs, docs.limit(0), ["id"], "doc").where("change = 'removed' and path = ''").collect()}
    assert got == {i: v for i, (_, v) in want.items()}
    got = {r.id: (r.change, r.old, r.new) for r in jt.json_difference(docs, docs.withColumn("doc", F.lit('"other"')), ["id"], "doc").collect()}
    assert got == {i: ("value" if k == "string" else "kind", v, "other") for i, (k, v) in want.items()}
    same = [("1.0", "1.00"), ("1e2", "100.0"), ("[-0]", "[0]"), ('{"a": 1, "b": 2}', '{"b": 2,"a": 1}'), ('"\\u0041"', '"A"')]
    differ = [("1", "1.0", "kind"), ("true", "1", "kind"), ("[0.0]", "[-0e0]", "value"), ('"1"', "1", "kind"), ("[[1]]", "[[true]]", "kind")]
    b, a = (spark.createDataFrame([(i, p[x]) for i, p in enumerate(same + differ)], "id long, doc string") for x in (0, 1))
    assert {r.id: r.change for r in jt.json_difference(b, a, ["id"], "doc").collect()} == {len(same) + i: p[2] for i, p in enumerate(differ)}


def test_differences_of_deep_documents_are_one_descent(spark):
    """A level of the deepest document is no step of the plan."""
    doc = lambda v: '{"a": [' * 150 + v + "]}" * 150
    frame = lambda v: spark.createDataFrame([(1, doc(v)), (2, doc("0"))], "id long, doc string")
    d = jt.json_difference(frame("1"), frame("2"), ["id"], "doc")
    assert [(r.id, r.path, r.change, r.old, r.new) for r in d.collect()] == [(1, ".".join(["a[0]"] * 150), "value", "1", "2")]
    assert "explode" not in d._jdf.queryExecution().optimizedPlan().toString()
