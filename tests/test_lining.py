"""Linings, mounting and rotations: exact scenes and brute force."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import lining as ln
from corvane.operators import mounting as mt
from corvane.operators import registration as rg
from corvane.operators import scans
from corvane.plans import QUERIES
from corvane.plans import lining_queries as lq

POINTS = "frame long, point_id long, x double, y double, z double"
C = ln.LiningParams(20.0, 0.05, 40, 3, 0.2, 0.9, 5.0, 1.0, 2.0, 3, 0.4)


def cloud(spark, p, frame=1):
    return spark.createDataFrame([(frame, i, *map(float, r)) for i, r in enumerate(p)], POINTS)


def tunnel(rng, n=900):
    """Two walls and a ceiling with a hole between 20 and 26 metres, an end wall across the track, and an object by the left wall."""
    x = rng.uniform(0, 40, n)
    x = x[(x < 20) | (x > 26)]
    side = rng.integers(0, 3, len(x))
    u = rng.uniform(0, 3, len(x))
    p = np.where((side == 0)[:, None], np.c_[x, np.full(len(x), -2.5), u], np.where((side == 1)[:, None], np.c_[x, np.full(len(x), 2.5), u], np.c_[x, u - 1.5, np.full(len(x), 4.0)]))
    end = np.c_[np.full(80, 41.0), rng.uniform(-2, 2, 80), rng.uniform(0, 3, 80)]
    return p + rng.normal(0, 0.005, p.shape), end


def test_levelling_turns_the_plane_level_and_keeps_distances(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(0, 5, (60, 3))
    planes = spark.createDataFrame([(1, 0.3, -0.2, -1.5), (2, None, 0.0, 0.0)], "frame long, a double, b double, c double")
    got = {r.point_id: r for r in ln.levelled(cloud(spark, p).unionByName(cloud(spark, p, 2)), planes).collect()}
    q = np.array([[got[i].x, got[i].y, got[i].z] for i in range(60)])
    assert len(got) == 60 and np.linalg.norm(q[:, None] - q[None], axis=2) == pytest.approx(np.linalg.norm(p[:, None] - p[None], axis=2))
    normal = np.array([-0.3, 0.2, 1]) / np.linalg.norm([-0.3, 0.2, 1])
    assert q[:, 2] == pytest.approx(p @ normal) and [got[i].height for i in range(60)] == pytest.approx(p[:, 2] - 0.3 * p[:, 0] + 0.2 * p[:, 1] + 1.5)


def test_windows_hold_what_lies_in_them(spark):
    x = [0.0, 4.9, 5.0, 10.0, 10.1, 15.0, 20.0, 23.0]
    got = sorted((r.x, r.window) for r in ln.windows(cloud(spark, [(v, 0, 0) for v in x]), 10.0).collect())
    want = [(v, 0) for v in x] + [(v, k + 1) for v in x for k in range(5) if 5.0 * k < 23.0 and 5.0 * k <= v <= 5.0 * k + 10]
    assert got == sorted(want)


def test_linings_are_walls_and_ceilings_with_strips_where_they_were_seen(spark):
    rng = np.random.default_rng(2)
    lining, end = tunnel(rng)
    m = ln.linings(ln.peeled_planes(ln.windows(cloud(spark, np.r_[lining, end]), C.window), C), C)
    found = m.select("window", "round", "kind", *ln.PLANE).distinct().collect()
    assert {r.kind for r in found} == {"wall", "ceiling"} and sum(r.window == 0 for r in found) == 3
    for r in found:
        n = np.array([r.nx, r.ny, r.nz])
        assert abs(n[1 if r.kind == "wall" else 2]) > 0.999 and abs(r.offset) == pytest.approx(2.5 if r.kind == "wall" else 4.0, abs=0.05)
    s = ln.strips(m, C).collect()
    assert s and not any(20.1 < r.x0 < 25.9 or 20.1 < r.x1 < 25.9 for r in s) and all(r.x1 <= 40.1 for r in s)
    assert ln.peeled_planes(ln.windows(cloud(spark, np.r_[lining, end]).limit(0), C.window), C).count() == 0
    twice = [sorted(map(str, ln.peeled_planes(ln.windows(cloud(spark, lining).repartition(k), C.window), C).collect())) for k in (1, 5)]
    assert twice[0] == twice[1]


def test_collinear_points_have_no_plane():
    plane, on = ln.best_plane(np.c_[np.arange(9.0), np.zeros(9), np.zeros(9)], 0.1, 20, np.random.default_rng(0))
    assert not on.any() and not plane.any()


def test_masks_follow_their_own_scans_strips(spark):
    """Point by point from the definition: any strip of the scan, its margin, the normal's agreement, and what protrudes nearby."""
    rng = np.random.default_rng(3)
    c = ln.ClaimParams(0.2, 0.5, 0.8, 0.4, 1.0, 0.6)
    p = [(f, i, rng.uniform(0, 20), rng.choice([-2.5, -2.4, -1.8, 0.0, 2.5]), rng.uniform(0, 4)) for f in (1, 2) for i in range(200)]
    normals = [(f, i, *(v / np.linalg.norm(v)).tolist()) if i % 9 else (f, i, None, None, None) for f, i, *_ in p for v in [rng.choice([[0, 1, 0.1], [1, 0, 0], [0.1, 0, 1]])]]
    strips_ = [(1, "wall", 0.0, 1.0, 0.0, 2.5, 2.0, 6.0, 0.5, 2.0), (1, "ceiling", 0.0, 0.0, 1.0, -3.0, 9.0, 13.5, -2.0, 2.0), (2, "wall", 0.0, 1.0, 0.0, -2.5, 0.0, 19.0, 0.0, 4.0)]
    found = spark.createDataFrame(strips_, "frame long, kind string, nx double, ny double, nz double, offset double, x0 double, x1 double, t0 double, t1 double")
    got = {(r.frame, r.point_id): (r.masked, r.protects) for r in ln.lining_mask(spark.createDataFrame([(f, i, float(x), float(y), float(z)) for f, i, x, y, z in p], POINTS), spark.createDataFrame(normals, "frame long, point_id long, nx double, ny double, nz double"), found, c, 2.0).collect()}
    turned = {(f, i): (a, b, d) for f, i, a, b, d in normals}
    on, protects = {}, {}
    for f, i, x, y, z in p:
        claims = []
        for g, kind, nx, ny, nz, o, x0, x1, t0, t1 in strips_:
            t = z if kind == "wall" else y
            if g == f and x0 - 0.5 <= x <= x1 + 0.5 and t0 - 0.5 <= t <= t1 + 0.5:
                v = turned[f, i]
                agrees = v[0] is not None and abs(nx * v[0] + ny * v[1] + nz * v[2]) >= 0.8
                far = abs(nx * x + ny * y + nz * z + o)
                claims.append((far < 0.2 and agrees, 0.4 <= far <= 1.0 and not agrees))
        on[f, i], protects[f, i] = any(a for a, _ in claims), any(b for _, b in claims) and not any(a for a, _ in claims)
    at = {(f, i): np.array([x, y, z]) for f, i, x, y, z in p}
    for k in on:
        near = any(protects[j] and j[0] == k[0] and np.linalg.norm(at[j] - at[k]) <= 0.6 for j in on)
        assert got[k] == (on[k] and not near, protects[k])
    assert any(v[0] for v in got.values()) and any(v[1] for v in got.values())


def test_registered_patches_lie_on_what_they_claim(spark, sf):
    """Every plane of the query's members, counted again over its own window."""
    _, members = lq.lining_members(spark, sf)
    rows_ = members.collect()
    assert rows_
    for r in rows_:
        assert abs(r.nx * r.x + r.ny * r.y + r.nz * r.z + r.offset) < lq.LINING.inlier
    size = members.groupBy("frame", "window", "round").count().agg(F.min("count")).first()[0]
    assert size >= lq.LINING.support
    ids = [(r.frame, r.window, r.point_id) for r in rows_]
    assert len(ids) == len(set(ids))


MOUNT = mt.MountParams(0.0, 40.0, 4.0, 0.15, -0.5, 0.5, 0.5, 6, 3, 4, 15.0, 0.05)


def rails(rng, slope, yaw, height, frame, noise=0.002):
    """Heads at +-0.76 of a centre line that turns by yaw and rises by slope, seen from ``height`` above them; the bed lies 0.17 lower."""
    x = np.repeat(np.arange(0.05, 40, 0.1), 2)
    side = np.tile([-1, 1], len(x) // 2)
    z = slope * x - height
    return [(frame, i, float(a), float(yaw * a + s * 0.76 + rng.normal(0, noise)), float(h - (0.1 if k % 6 < 2 else 0)), float(0.17 - (0.1 if k % 6 < 2 else 0)), float(yaw * a), 1.52) for i, (a, s, h, k) in enumerate(zip(x, side, z, range(len(x)), strict=True))]


SCAN = "frame long, point_id long, x double, y double, z double, height double, center double, spacing double"


def test_mounting_finds_tilt_height_and_offset(spark):
    rng = np.random.default_rng(4)
    bent = [(f, i, x, y + 0.004 * x * x, z, h, c + 0.004 * x * x, s) for f, i, x, y, z, h, c, s in rails(rng, 0.0, 0.0, 2.0, 3)]
    rows_ = [*rails(rng, 0.02, 0.01, 2.0, 1), *[r for r in rails(rng, 0.0, 0.0, 2.0, 2) if r[2] < 10], *bent, (4, 0, 500.0, 0.0, 0.0, 0.0, 0.0, 1.52)]
    got = {r.frame: r for r in mt.observe(spark.createDataFrame(rows_, SCAN), MOUNT).collect()}
    r = got[1]
    assert (r.state, r.reason, r.pairs) == ("observed", "supported_heads", 10)
    assert r.height == pytest.approx(2.0 / math.sqrt(1 + 0.02**2), abs=0.005) and r.separation == pytest.approx(1.52, abs=0.01) and abs(r.lateral) < 0.01
    m = np.array([r.forward, r.left, r.up])
    assert m @ m.T == pytest.approx(np.eye(3), abs=1e-9) and np.linalg.det(m) == pytest.approx(1)
    assert r.forward[2] == pytest.approx(0.02, abs=1e-3) and r.forward[1] == pytest.approx(0.01, abs=1e-3)
    assert got[2].reason == "insufficient_paired_bins" and got[3].state == "unsupported_fit" and (got[4].pairs, got[4].state) == (0, "unavailable")


def turn(axis, degrees):
    v = np.asarray(axis, float) / np.linalg.norm(axis)
    h = math.radians(degrees) / 2
    return np.r_[math.cos(h), math.sin(h) * v]


def matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_quaternions_of_matrices_of_all_turns(spark):
    turns = [turn(a, d) for a in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [1, -2, 3]) for d in (0, 1, 90, 179, 180, 181, 270)]
    df = spark.createDataFrame([(i, *matrix(q).tolist()) for i, q in enumerate(turns)], "id long, a array<double>, b array<double>, c array<double>")
    for r in mt.with_quaternion(df, [F.col(x) for x in "abc"]).collect():
        assert abs(np.dot([r.qw, r.qx, r.qy, r.qz], turns[r.id])) == pytest.approx(1)


def test_mean_rotations_equal_brute_force_about_all_axes(spark):
    rng = np.random.default_rng(5)
    rows_ = []
    for key in ("a", "b", None):
        base = turn(rng.normal(size=3), rng.uniform(0, 360))
        for _ in range(30):
            q = turn(rng.normal(size=3), rng.uniform(0, 25))
            w = np.r_[base[0] * q[0] - base[1:] @ q[1:], base[0] * q[1:] + q[0] * base[1:] + np.cross(base[1:], q[1:])]
            rows_.append((key, *(w * rng.choice([-1, 1]) * rng.uniform(0.5, 2)).tolist()))
    odd = [("a", 0.0, 0.0, 0.0, 0.0), ("a", None, 1.0, 0.0, 0.0), ("b", float("nan"), 0.0, 0.0, 1.0), ("only odd", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([*rows_, *odd], "k string, qw double, qx double, qy double, qz double")
    mean = mt.mean_rotations(df, ["k"])
    got = {r.k: np.array([r.qw, r.qx, r.qy, r.qz]) for r in mean.collect()}
    assert set(got) == {"a", "b", None} and {r.n for r in mean.collect()} == {30}
    cost = lambda m, key: sum(1 - (m @ np.array(r[1:]) / np.linalg.norm(r[1:])) ** 2 for r in rows_ if r[0] == key)
    for key, m in got.items():
        assert np.linalg.norm(m) == pytest.approx(1) and m[np.abs(m).argmax()] > 0
        for _ in range(200):  # nothing near it is nearer to all
            other = m + rng.normal(0, 0.02, 4)
            assert cost(m, key) <= cost(other / np.linalg.norm(other), key) + 1e-12
    for r in mt.deviations(df.where("qw <> 0 and not isnan(qw)"), mean, ["k"]).collect():
        q = np.array([r.qw, r.qx, r.qy, r.qz]) / np.linalg.norm([r.qw, r.qx, r.qy, r.qz])
        assert r.deviation == pytest.approx(math.degrees(2 * math.acos(min(1, abs(q @ got[r.k])))), abs=1e-5)


def test_calibration_is_fitted_on_the_prefix_and_judged_on_the_rest(spark):
    rng = np.random.default_rng(6)
    rows_ = [r for f, slope in enumerate([0.02, 0.02, 0.02, 0.02, 0.05, 0.02], 1) for r in rails(rng, slope, 0.0, 2.0, f, 0.0)]
    rows_ += [(7, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.52)]
    o = mt.observe(spark.createDataFrame(rows_, SCAN), MOUNT).withColumn("run", F.lit("r"))
    (c,) = mt.calibrate(o, "run", "frame", 3).collect()
    assert (c.fitted, c.later, c.accepted) == (3, 4, 3) and c.fraction == pytest.approx(0.75)
    assert c.worst == pytest.approx(math.degrees(math.atan(0.05) - math.atan(0.02)), abs=0.02)
    assert c.height_span == pytest.approx(2 / math.sqrt(1 + 0.02**2) - 2 / math.sqrt(1 + 0.05**2), abs=0.01)


def test_scans_are_peeled_as_their_windows_are(spark, monkeypatch):
    """Windows of whole scans, wherever batches end, hold the points that they are copied to by hand; a null scan is a scan."""
    monkeypatch.setattr(scans, "SCAN_ROWS", 60)
    rng = np.random.default_rng(3)
    rows = [(f, i, *map(float, p)) for f in (1, None, 2) for i, p in enumerate(np.c_[rng.uniform(-7, 40, 90), rng.integers(0, 3, 90), rng.uniform(0, 4, 90)])]
    p = spark.createDataFrame(rows, POINTS)
    c = dataclasses.replace(C, window=10.0, support=8)
    told = lambda df: sorted(map(str, df.collect()))
    want = told(ln.peeled_planes(ln.windows(p, c.window), c))
    assert len(want) > 200 and told(ln.peeled_scans(p.repartition("frame"), c)) == want


@pytest.mark.parametrize("pairs", [3, 1 << 20])
def test_mask_finds_its_normals_and_deals_scans_out_once(spark, sf, monkeypatch, pairs):
    """Normals found within the pass mask as a table of the same does; a strip of any length is met, however few pairs are looked at at once."""
    monkeypatch.setattr(scans, "CANDIDATES", pairs)
    rng = np.random.default_rng(5)
    rows = [(f, i, *map(float, p)) for f in (1, None, 2) for i, p in enumerate(np.c_[rng.uniform(0, 9, 80), rng.choice([1.9, 2.0, 0.9], 80), rng.uniform(0, 3, 80)])]
    p = spark.createDataFrame(rows, POINTS)
    found = spark.createDataFrame([(f, "wall", 0.0, 1.0, 0.0, -2.0, 0.5, 8.5, 0.0, 2.5) for f in (1, None)] + [(2, "ceiling", 0.0, 0.0, 1.0, -1.0, 2.0, 3.0, 0.0, 2.0)], "frame long, kind string, nx double, ny double, nz double, offset double, x0 double, x1 double, t0 double, t1 double")
    c = ln.ClaimParams(0.15, 0.2, 0.7, 0.5, 1.5, 0.4)
    n = rg.normals(rg.covariances(p, 1.0, 9), least=4)
    told = lambda normals: {(r.frame, r.point_id): (r.masked, r.protects) for r in ln.lining_mask(p, normals, found, c, 2.0).collect()}
    own, given = told(ln.NormalParams(1.0, 9, 4)), told(n)
    assert len(own) == len(rows) and own == given and not any(any(v) for (f, _), v in own.items() if f is None)
    assert sum(m for m, _ in own.values()) > 5 and sum(o for _, o in own.values()) > 5
    plan = QUERIES["lining_mask"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan
