"""What keeps the queries' work in step with their input."""

from __future__ import annotations

import hashlib
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.functions import numeric
from corvane.operators import assign, candidates, evaluate, jsontree, lining, scans, spatial, tracking
from corvane.plans import QUERIES, lining_queries, structure_queries
from corvane.sources import archives, recordings


def test_parts_of_one_candidate_leave_in_one_table():
    """A recording with a pause before every scan is as many parts as scans; they aren't as many tables."""
    n = 5000
    b = pd.DataFrame({"bag": 1, "frame": np.arange(n) * 10, "y": 0.0, "z": 0.0, "distance": 1.0, "part": np.arange(n, dtype=float)})
    got = list(tracking.greedy_events(iter([b.iloc[:3000], b.iloc[3000:]]), 3, 0.5, 0.5))
    assert len(got) == 3 and sum(map(len, got)) == n
    assert (pd.concat(got)["event"] == 0).all() and (pd.concat(got)["frames"] == 1).all()


def test_orders_of_a_day_meet_the_intervals_once(spark, sf, monkeypatch):
    seen = {}

    def join(records, *rest, **named):
        seen["n"] = records.count()
        return real(records, *rest, **named)

    real = structure_queries.iv.interval_join
    monkeypatch.setattr(structure_queries.iv, "interval_join", join)
    QUERIES["interval_pairs"](spark, sf).collect()
    assert seen["n"] == spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date")).distinct().count()


def test_oriented_boxes_are_met_many_at_once(spark):
    """A unit box against itself turned about z: what is cut is 2 / (1 + sin + cos) of the square. As a table the pairs are spread over tasks."""
    n = 3000
    turn = np.linspace(0, np.pi / 2, n)
    cos, sin, zero, one = np.cos(turn), np.sin(turn), np.zeros(n), np.ones(n)
    turned = np.stack([cos, -sin, zero, sin, cos, zero, zero, zero, one], 1)
    sides = np.zeros((n, 3)), np.ones((n, 3)), np.tile(np.eye(3).reshape(9), (n, 1))
    cut = 2 / (1 + sin + cos)
    got = assign.oriented_ious((*sides[:2], sides[2].reshape(-1, 3, 3)), (*sides[:2], turned.reshape(-1, 3, 3)))
    assert got == pytest.approx(cut / (2 - cut), abs=1e-8)
    names = {c: v.tolist() for c, v in zip(("ca", "sa", "ra", "cb", "sb", "rb"), (*sides, *sides[:2], turned), strict=True)}
    pairs = evaluate.oriented_ious(spark.createDataFrame(pd.DataFrame({"id": range(n), **names})).coalesce(1))
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1 and pairs.agg({"iou": "sum"}).first()[0] == pytest.approx(got.sum())


@pytest.mark.parametrize(("dims", "radius", "candidates"), [(3, 0.3, 1 << 20), (2, 0.2, 50), (1, 0.05, 7), (3, 5.0, 64)])
def test_close_pairs_equal_brute_force(monkeypatch, dims, radius, candidates):
    """Whatever part of the pairs is weighed at once; scans don't meet, and points that aren't finite are near nothing."""
    monkeypatch.setattr(scans, "CANDIDATES", candidates)
    rng = np.random.default_rng(dims)
    a, b = (np.round(rng.uniform(-1, 1, (n, dims)), 2) for n in (150, 120))
    a[3], b[5, 0] = np.nan, np.inf
    ga, gb = np.sort(rng.integers(0, 3, 150)), np.sort(rng.integers(0, 3, 120))
    with np.errstate(invalid="ignore"):
        d2 = sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(dims))
    want = set(zip(*np.nonzero((d2 <= radius * radius) & (ga[:, None] == gb[None])), strict=True))
    got = [(i, j) for part in scans.close_pairs(ga, a, gb, b, radius) for i, j in zip(*part[:2], strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    d2 = sum((a[:, None, k] - a[None, :, k]) ** 2 for k in range(dims))
    want = {(i, j) for i, j in zip(*np.nonzero((d2 <= radius * radius) & (ga[:, None] == ga[None])), strict=True) if i < j}
    got = [(i, j) for part in scans.close_pairs(ga, a, ga, a, radius, once=True) for i, j in zip(*part[:2], strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_points_are_not_copied_to_their_neighbours_cells(spark, sf, monkeypatch):
    """A pair whose distance rounds to the radius over a whole cell between them counts, as it does in SQL; long scans are taken whole."""
    monkeypatch.setattr(scans, "SCAN_ROWS", 2)
    p = spark.createDataFrame([(f, i, 0.0, y, 0.0) for f in (1, None, 2) for i, y in enumerate((1 - 2**-53, 2.0, 1.5, None))], "frame long, point_id long, x double, y double, z double")
    pairs = spatial.neighbour_pairs(p, p, 1.0, once=True)
    assert sorted((r.frame, *sorted((r.a_point_id, r.b_point_id))) for r in pairs.collect()) == [(f, *ij) for f in (1, 2) for ij in ((0, 1), (0, 2), (1, 2))]
    for q in ("mutual_radius", "knn", "covariances", "radius_semi", "registration_quality"):
        assert "explode" not in QUERIES[q](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_many_members_share_tasks(spark, tmp_path):
    """More members than tasks, empty ones and a large one among them: all are read, whole and by line."""
    content = {f"m{i}": b"".join(b"%d\n" % k for k in range(i % 7)) for i in range(900)} | {"m7": b"x" * (3 << 20)}
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in list(content.items())[k::2]:
                z.writestr(n, c)
    digests = {n: hashlib.sha256(c).hexdigest() for n, c in content.items()}
    whole = archives.read_archives(spark, str(tmp_path), lines=False, manifest=digests)
    assert whole.rdd.getNumPartitions() < 300 and {r.member: bytes(r.content) for r in whole.collect()} == content
    lines = archives.read_archives(spark, str(tmp_path), "m[1-6]*").groupBy("member").count().collect()
    assert {r.member: r["count"] for r in lines} == {n: c.count(b"\n") for n, c in content.items() if n[1] in "123456" and c}


def test_folders_grow_with_segments_not_with_recordings(spark, tmp_path):
    at = str(tmp_path / "rec")
    rows = spark.range(4000).select((F.col("id") % 200).alias("bag"), (F.col("id") % 4).alias("segment"), F.col("id").alias("frame"), F.col("id").alias("ns"))
    recordings.write_recordings(rows, at)
    recordings.disable(rows.select("bag").distinct().where("bag < 50"), at)
    assert sorted(os.listdir(f"{at}/scans"))[-4:] == [f"segment={s}" for s in range(4)] and len(list((tmp_path / "rec").rglob("*.parquet"))) < 50
    c = recordings.catalogue(spark, at).collect()
    assert len(c) == 200 and sum(r.disabled for r in c) == 50 and sum(r.scans for r in c) == 4000 and {(r.segments, r.first == r.last) for r in c} == {(1, True)}
    got = recordings.read_segments(spark, at, rows.select("bag", "segment").where("segment = 3"), "frame long, ns long")
    assert got.count() == rows.where("segment = 3 and bag >= 50").count()


def test_documents_are_compared_without_joining_their_values(spark):
    """Documents meet once, by their keys; equal ones aren't taken apart, and what differs is found on the way down."""
    docs = lambda x: spark.createDataFrame([(i, f'{{"a": [{i}, {{"b": {x if i == 7 else 0}}}]}}') for i in range(50)], "id long, doc string")
    d = jsontree.json_difference(docs(1), docs(2), ["id"], "doc")
    assert [tuple(r) for r in d.collect()] == [(7, "a[1].b", "value", "1", "2", False)]
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_windows_are_peeled_in_batches(spark, monkeypatch):
    """No window is a table of its own, nor is it read with others by too few tasks; those of a null scan are a scan's, wherever batches end."""
    monkeypatch.setattr(scans, "SCAN_ROWS", 50)
    rng, c = np.random.default_rng(1), lining_queries.LINING
    rows = [(f, w, i, *map(float, p)) for f in (1, None, 2) for w in (0, 1) for i, p in enumerate(np.c_[rng.uniform(0, 40, 90), rng.integers(0, 3, 90), rng.uniform(0, 4, 90)])]
    d = lining.peeled_planes(spark.createDataFrame(rows, "frame long, window long, point_id long, x double, y double, z double"), c)
    assert "FlatMapGroups" not in d._jdf.queryExecution().optimizedPlan().toString() and d.rdd.getNumPartitions() == 4
    got = sorted((r.frame or 0, r.window, r["round"], r.ny, r.offset, r.point_id) for r in d.collect())
    of = lambda f, w: np.array([r[3:] for r in rows if r[:2] == (f, w)])
    want = sorted((f or 0, w, k, *plane[[1, 3]], i) for f in (1, None, 2) for w in (0, 1) for k, (plane, on) in enumerate(lining.peeled(of(f, w), w, c)) for i in on)
    assert len(want) > 500 and got == want


def test_components_that_cannot_split_are_not_looked_at():
    c = candidates.SurfaceParams(0.5, 3, 0.3, 1.6)
    label = np.array([5, 0, 5, 0, 5, 2, 5, 5, 5, 2])
    above = np.array([1, 1, 1, 0, 1, 1, 1, 1, 1, 1], bool)
    got = [(a.tolist(), e.tolist()) for a, e in candidates.may_split(label, above, np.array([9, 0, 1, 2]), c)]
    assert got == [([0, 2, 4, 6, 7, 8], [1, 3])]


def test_graphs_of_many_scans_are_solved_at_once(spark, monkeypatch):
    """Equal to each scan's own union-find, wherever batches end; a null scan is one, edges to what isn't there go."""
    monkeypatch.setattr(scans, "SCAN_ROWS", 9)
    rng, ids = np.random.default_rng(3), {f: np.sort(np.random.default_rng(9).choice(90, 20, False)) for f in (None, 1, 2, 7)}
    ends = {f: rng.choice(v, (9, 2)) for f, v in ids.items()}
    nodes = spark.createDataFrame([(f, int(i)) for f, v in ids.items() for i in v], "frame long, point_id long")
    edges = spark.createDataFrame([(f, *map(int, e)) for f, v in ends.items() for e in v] + [(1, 1000, int(ids[1][0])), (5, 1, 2)], "frame long, src long, dst long")
    d = spatial.components(nodes, edges)
    assert "CoGroup" not in d._jdf.queryExecution().optimizedPlan().toString()
    want = {(f, i, k) for f, v in ids.items() for i, k in zip(v.tolist(), assign.union_find(20, v.searchsorted(ends[f][:, 0]), v.searchsorted(ends[f][:, 1])).tolist(), strict=True)}
    assert {tuple(r) for r in d.collect()} == want


def test_component_stats_joins_no_point_back(spark, sf):
    """Points keep their coordinates while their scan's graph is solved."""
    assert "Join" not in QUERIES["component_stats"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    nodes = spark.createDataFrame([(1, 3, 0.5, "c"), (1, 1, 1.5, None), (1, 2, None, "b"), (None, 7, 2.5, "d")], "frame long, point_id long, x double, name string")
    edges = spark.createDataFrame([(1, 1, 3)], "frame long, src long, dst long")
    got = spatial.components(nodes, edges, carried=("x", "name"))
    assert set(map(tuple, got.collect())) == {(1, 1, 1.5, None, 0), (1, 2, None, "b", 1), (1, 3, 0.5, "c", 0), (None, 7, 2.5, "d", 0)}


def test_tracks_of_few_objects_need_no_matrices():
    """The filter along each axis equals the one on whole matrices, and few pairs are weighed and matched as many are."""
    p = tracking.TrackParams(0.3, 0.2, 0.7, 16.0, 1.0, 9.0, 9.0, 3, 5, 2.0, 24, 2)
    m, rng = tracking.Motion(p), np.random.default_rng(2)
    t = tracking.Track((1.0, 2.0, 3.0), (0.0, 0.0, 0.0), (p.position_sigma**2, 0.0, 1.0), 0.0, 0.0, (1.0, 1.0, 1.0))
    state, cov, r = np.array([1.0, 2, 3, 0, 0, 0]), np.diag([p.position_sigma**2] * 3 + [1.0] * 3), np.eye(3) * (p.position_sigma**2 + p.pose_sigma**2)
    for dt, centre in zip((0.1, 0.5, 2.0), rng.uniform(0, 4, (3, 3)), strict=True):
        at, spread = m.ahead(t, dt)
        m.corrected(t, at, spread, tuple(centre))
        move, push = np.eye(6) + dt * np.eye(6, k=3), np.r_[np.eye(3) * dt * dt / 2, np.eye(3) * dt]
        state, cov = move @ state, move @ cov @ move.T + p.acceleration_sigma**2 * push @ push.T
        gain = cov[:, :3] @ np.linalg.inv(cov[:3, :3] + r)
        state, cov = state + gain @ (centre - state[:3]), cov - gain @ cov[:3]
        assert [*t.at, *t.speed] == pytest.approx(state) and t.spread == pytest.approx((cov[0, 0], cov[0, 3], cov[3, 3]))
    places, centres, sizes = rng.uniform(0, 3, (6, 3)), rng.uniform(0, 3, (7, 3)), rng.uniform(0.5, 2, (13, 3))
    few = m.few_pairs([*map(tuple, places)], [t.spread] * 6, [*map(tuple, sizes[:6])], [*map(tuple, centres)], [*map(tuple, sizes[6:])], 16.0, 1.0)
    pairs, cost = m.pairs(np.c_[places, np.zeros((6, 3))], np.stack([cov] * 6), sizes[:6], centres, sizes[6:], 16.0, 1.0)
    assert [e[:2] for e in few] == [tuple(x) for x in pairs.tolist()] and [e[2] for e in few] == pytest.approx(cost)


def test_few_pairs_are_matched_as_many_are(monkeypatch):
    rng = np.random.default_rng(6)
    for k in range(60):
        pairs = np.argwhere(rng.random((6, 7)) < (0.1, 0.25, 0.6)[k % 3])
        cost = rng.integers(0, 5, len(pairs)) / 1.0
        got = []
        for few in (64, 0):
            monkeypatch.setattr(assign, "FEW", few)
            got.append(assign.match_or_leave(pairs, cost, 4.0))
        assert got[0] == got[1]


def test_a_median_is_found_once_for_all_elements(spark):
    values = [float(v) for v in np.random.default_rng(0).integers(0, 50, 40)]
    d = spark.createDataFrame([(values,), ([],)], "v array<double>").select(numeric.scaled_mad(F.col("v"), 0.1).alias("m"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 2
    assert [r.m for r in d.collect()] == [pytest.approx(1.4826 * np.median(np.abs(values - np.median(values)))), 0.1]


def test_structure_is_decided_where_a_scan_was_dealt(spark):
    wall = [(f, 0.5 * i, y, 0.1 * j) for f in (1, None) for i in range(30) for j in range(12) for y in (1.75, 0.1)]
    p = spark.createDataFrame([*wall, (1, 1.0, None, 1.0), (1, None, 0.1, None)], "frame long, x double, y double, z double")
    d = spatial.structural(p, F.lit(1.6), 0.4, 0.1, 1.0, 5.0, 3, 0.3)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(((r.frame or 0, r.y or 0, r.structural, r["count"]) for r in d.groupBy("frame", "y", "structural").count().collect())) == [(0, 0.1, False, 360), (0, 1.75, False, 360), (1, 0, False, 1), (1, 0.1, False, 361), (1, 1.75, True, 360)]


def test_named_keys_are_found_without_the_other_values(spark):
    """As in the whole tree, containers of a name and what they hold among them, keys that need quotes, documents that aren't JSON; long strings are no depth."""
    docs = ['{"a": {"b c": [1, {"z": [{"z": null}, 2]}]}, "z": "[[[{", "y": [[{"z": 1.5}], "z"]}', "nope", None, "[]", '{"k\\"[[": {"z": true}}', '{"s": "' + "[x" * 20_000 + '"}']
    d = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    assert jsontree.depth(d, "doc") == 6
    want = jsontree.named_keys(jsontree.json_tree(d, ["id"], "doc"), ["z"]).collect()
    few = jsontree.json_tree(d, ["id"], "doc", only=["z"])
    assert len(want) == 5 and sorted(map(str, few.collect())) == sorted(map(str, want))


def test_frames_without_contention_are_matched_together(spark):
    """Only frames with several boxes on both sides that contend are solved; what is matched has the most pairs, then the most overlap."""
    box = lambda f, i, x: (f, i, x, 0.0, 0.0, x + 4.0, 1.0, 1.0)
    names = "frame long, id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    p = spark.createDataFrame([box(1, 1, 0.0), box(1, 2, 9.0), box(2, 1, 0.0), box(2, 2, 1.0), box(3, 1, 0.0), box(3, 2, 2.0), box(4, 1, 0.0), box(5, 1, 0.0)], names)
    t = spark.createDataFrame([box(1, 7, 1.0), box(1, 8, 8.0), box(2, 7, 1.0), box(3, 7, 1.0), box(3, 8, 4.0), box(4, 7, 30.0), box(6, 7, 0.0)], names)
    got = sorted((r.frame, r.prediction, r.truth, r.iou) for r in evaluate.match_boxes(p, t, 0.2, ("frame",)).collect())
    assert got == [(1, 1, 7, pytest.approx(0.6)), (1, 2, 8, pytest.approx(0.6)), (2, 2, 7, 1.0), (3, 1, 7, pytest.approx(0.6)), (3, 2, 8, pytest.approx(1 / 3))]
    assert "exists" not in evaluate.match_boxes(p, t, 0.2, ("frame",))._jdf.queryExecution().optimizedPlan().toString()
