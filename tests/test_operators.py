"""Exact scenes, edge cases and brute-force checks of the library's operators."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.functions import numeric as fn
from corvane.operators import assign, background, candidates, compare, episodes, evaluate, fits, generate, geometry, motion, registration, segments, spatial, tracking
from corvane.plans import QUERIES, spatial_queries
from corvane.plans import geometry_queries as gq
from corvane.plans import model_queries as mq
from corvane.sources import clouds
from pyspark.sql import functions as F

POINTS = "frame long, point_id long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def test_bands_at_their_edges_and_unusual_values(spark):
    p = cloud(spark, [(1, 1, 3.0, 4.0, 0.0), (1, 2, 6.0, 8.0, 0.0), (1, 3, float("nan"), 0.0, 0.0), (1, 4, float("inf"), 0.0, 0.0), (1, 5, None, 0.0, 0.0)])
    assert [r.point_id for r in spatial.radial_band(p, 5.0, 10.0).orderBy("point_id").collect()] == [1, 2]
    assert spatial.radial_band(p, 5.0, 10.0, closed=False).count() == 0


def test_voxel_first_takes_the_first_point_and_numbers_cells_in_order(spark):
    p = cloud(spark, [(1, 2, 0.1, 0.1, 0.1), (1, 1, 0.2, 0.2, 0.2), (1, 3, -0.1, 0.0, 0.0), (1, 4, 1.0, 0.0, 0.0)])
    got = spatial.voxel_first(p, 1.0).orderBy("reduced_id").collect()
    assert [(r.kx, r.point_id) for r in got] == [(-1, 3), (0, 1), (1, 4)]


def test_cell_edges_fall_as_in_double_precision(spark):
    assert spark.range(1).select(fn.cell(F.lit(0.3), 0.1)).first()[0] == 2


def test_mutual_radius_is_closed_and_uses_the_smaller_radius(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 1.0), (1, 2, 1.0, 0.0, 0.0, 1.0), (1, 3, 1.75, 0.0, 0.0, 0.5), (2, 4, 0.5, 0.0, 0.0, 1.0)], POINTS + ", radius double")
    assert [(r.src, r.dst) for r in spatial.mutual_radius_edges(p, 1.0).collect()] == [(1, 2)]


def test_every_point_has_its_nearest_others(spark, sf):
    """Points at one place are near each other and not near themselves; in the tables, all points are asked for, of whatever ring."""
    rows = [(f, i, float(i // 8), float(i % 2), 0.0) for f in (1, 2) for i in range(24)]
    p = spark.createDataFrame(rows, "frame long, point_id long, x double, y double, z double")
    got = {(r.frame, r.point_id, r.rank): (r.nearest_id, r.d2) for r in spatial.nearest(p, p, 1.0, k=5, others=True).collect()}
    near = {a: sorted(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, b[1]) for b in rows if b[0] == a[0] and b[1] != a[1]) for a in rows}
    assert got == {(*a[:2], k + 1): (i, d) for a, found in near.items() for k, (d, i) in enumerate([x for x in found if x[0] <= 1][:5])}
    asked = spatial_queries.points(spark, sf).join(QUERIES["knn"](spark, sf).where("rank = 1"), ["frame", "point_id"])
    assert {r.ring for r in asked.select("ring").distinct().collect()} == set(range(1, 8))


def test_components_of_a_cycle_and_of_no_edges(spark):
    n = cloud(spark, [(f, i, 0.0, 0.0, 0.0) for f in (1, 2) for i in range(5)])
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (1, 3, 4)], "frame long, src long, dst long")
    got = {(r.frame, r.point_id): r.label for r in spatial.components(n, e).collect()}
    assert [got[1, i] for i in range(5)] == [0, 0, 0, 1, 1] and [got[2, i] for i in range(5)] == [0, 1, 2, 3, 4]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    got = assign.assign(cost)
    small = min(n, m)
    best = min(sum(cost[i, j] for i, j in zip(a, b, strict=True)) for a in itertools.permutations(range(n), small) for b in itertools.permutations(range(m), small))
    assert len(got) == small and sum(cost[i, j] for i, j in got) == best


def test_invalid_pairs_do_not_steal_matches(spark):
    box = "bag long, frame long, id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    p = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, 2.0, 1.0, 1.0), (1, 1, 2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], box)
    t = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 2, 8, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], box)
    assert [(r.prediction, r.truth, r.iou) for r in evaluate.match_boxes(p, t, 0.5).collect()] == [(2, 7, 1.0)]


def test_oriented_iou_of_known_boxes():
    eye, s = np.eye(3), math.sqrt(0.5)
    turn = np.array([[s, -s, 0], [s, s, 0], [0, 0, 1]])
    one = (np.zeros(3), np.ones(3), eye)
    assert assign.oriented_iou(one, one) == pytest.approx(1)
    assert assign.oriented_iou(one, (np.array([0.5, 0, 0]), np.ones(3), eye)) == pytest.approx(1 / 3)
    octagon = 2 * (math.sqrt(2) - 1)
    assert assign.oriented_iou(one, (np.zeros(3), np.ones(3), turn)) == pytest.approx(octagon / (2 - octagon))
    assert assign.oriented_iou(one, (np.array([5.0, 0, 0]), np.ones(3), eye)) == 0


def test_peaks_by_prominence_and_distance():
    assert assign.peaks(np.array([0, 3, 0, 1, 0, 5, 5, 0, 4, 0]), 2, 1).tolist() == [1, 5, 8]
    assert assign.peaks(np.array([0, 3, 0, 5, 0]), 2, 3).tolist() == [3]


def test_nearest_source_by_path_length():
    d, own = assign.shortest_from(5, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], [0, 3])
    assert own.tolist() == [0, 0, 3, 3, -1] and d[:4].tolist() == [0, 1, 1, 0] and math.isinf(d[4])


def test_gap_is_strict_and_duplicates_and_backward_stamps_are_flagged(spark):
    s = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 21), (1, 4, 21)], "bag long, frame long, ns long")
    got = episodes.gap_flags(s, 10).orderBy("ns", "nonincreasing").collect()
    assert [(r.gap, r.nonincreasing) for r in got] == [(False, False), (False, False), (True, False), (False, True)]


def test_alarm_time_goes_to_the_earlier_scan_and_gaps_are_excluded(spark):
    s = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 5, "n"), (1, 3, 8, "a"), (1, 4, 100, "a")], "bag long, frame long, ns long, status string")
    r = episodes.alarm_accounting(s, F.col("status") == "a", 10).first()
    assert (r.frames, r.alarm_frames, r.alarm_episodes, r.observed_ns, r.excluded_ns, r.alarm_ns) == (4, 3, 3, 8, 92, 5)


def test_deep_difference_tolerates_small_floats_only(spark):
    kind = "k long, a double, s struct<b: double, c: string>, l array<double>"
    x = spark.createDataFrame([(1, 1.0, (2.0, "u"), [1.0]), (2, None, (2.0, None), [1.0, 2.0]), (3, 1.0, (1.0, "v"), None)], kind)
    y = spark.createDataFrame([(1, 1.0 + 1e-12, (2.0 + 1e-6, "u"), [1.0 + 1e-13]), (2, None, (2.0, "w"), [1.0, 3.0]), (3, None, (1.0, "v"), None)], kind)
    got = sorted((r.k, r.path) for r in compare.deep_difference(x, y, ["k"]).collect())
    assert got == [(1, "s.b"), (2, "l"), (2, "s.c"), (3, "a")]


def test_interpolation_clamps_and_serves_few_anchors(spark):
    arr = lambda *p: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in p])
    row = spark.range(1).select(*[fn.interpolate(F.lit(v), arr((1, 10), (3, 20)), "x", "y").alias(f"v{i}") for i, v in enumerate((0.0, 1.0, 2.0, 3.0, 9.0))], fn.interpolate(F.lit(5.0), arr((1, 7)), "x", "y").alias("one"), geometry.reach(F.lit(5.0), fn.bracket(F.lit(5.0), arr((1, 7)), "x")).alias("r")).first()
    assert tuple(row) == (10.0, 10.0, 15.0, 20.0, 20.0, 7.0, 4.0)


def test_scans_without_geometry_have_context_only(spark):
    g = geometry.geometry_table(spark, [{"frame": 1, "plane": None, "ground": [], "rail": [], "rail_head": None}, {"frame": 2, "plane": gq.PLANE, "ground": gq.GROUND, "rail": gq.RAIL[:1], "rail_head": 0.2}])
    got = geometry.classify(cloud(spark, [(1, 1, 20.0, 0.0, 1.0), (2, 2, 20.0, 0.0, 1.0)]), g, gq.LIMITS).orderBy("frame").collect()
    assert all(not (r.core or r.boundary or r.overlap or r.observed) and r.lateral is None for r in got) and got[0].context


def test_width_bounds_see_both_sides_of_a_step(spark):
    env = ((0.0, 1.0, 0.9, 1.1), (1.0, 3.0, 1.4, 1.4))
    lo, hi = geometry.width_bounds(F.lit(0.5), F.lit(1.5), env)
    r = spark.range(1).select(lo, hi).first()
    assert r[0] == pytest.approx(1.0) and r[1] == pytest.approx(1.4)


def test_continuation_recovers_a_curve_and_drops_noise_curvature():
    x = np.arange(0.0, 31.0, 2.0)
    curve = geometry.continuation(np.c_[x, 0.001 * (x - 30) ** 2, x * 0, x * 0], True)
    assert curve[3] == pytest.approx(0.001, rel=1e-6)
    noisy = np.c_[x, 0.01 * np.random.default_rng(1).standard_normal(len(x)), x * 0, x * 0]
    assert geometry.continuation(noisy, True)[3] == 0.0
    assert geometry.continuation(np.array([[0.0, 0.0, 0, 0], [10.0, 0.5, 0, 0]]), True)[2] == pytest.approx(0.05)


def test_scene_geometry_is_recovered(spark, sf):
    g = fits.fit_geometry(mq.scene(spark, sf), mq.PLANE, mq.BED, mq.RAIL).collect()
    assert len(g) == 5 and all(r.reason == "supported_track_bed" for r in g)
    assert all(abs(r.plane[2] + mq.TUNNEL.ground_z * -1) < 0.1 and len(r.ground) >= 3 for r in g)
    assert all(abs(a.gauge - 1.52) < 0.15 and abs(a.center) < 0.2 for r in g for a in r.rail)


def test_scenes_do_not_depend_on_partitioning(spark, sf):
    a = mq.scene(spark, sf).agg(F.count("*"), F.sum(F.xxhash64("frame", "point_id", "x", "y", "z").cast("decimal(38,0)"))).first()
    b = mq.scene(spark, sf).repartition(7).agg(F.count("*"), F.sum(F.xxhash64("frame", "point_id", "x", "y", "z").cast("decimal(38,0)"))).first()
    assert a == b


def test_empty_tunnel_holds_no_object(spark, sf):
    hits = {r.hit for r in mq.scene(spark, sf).where("frame = 0").select("hit").distinct().collect()}
    assert "object" not in hits and {"floor", "wall", "ceiling", "rail"} <= hits


PARAMS = tracking.TrackParams(0.1, 0.1, 1.0, 16.0, 1.0, 1.0, 0.5, 3, 5, 2.0, 24, 2)


def objects(stamp, *rows):
    return pd.DataFrame([(i, x, y, 0.0, 1.0, 1.0, 1.0, rel, 10, 4, False) for i, x, y, rel in rows], columns=["id", "cx", "cy", "cz", "ex", "ey", "ez", "relation", "support", "certain", "immediate"])


def test_tracker_keeps_identity_confirms_and_resets_at_gaps():
    t = tracking.Tracker(PARAMS)
    seen = []
    for k in range(5):
        rows, gap = t.step(k * 0.1, objects(k, (1, 10 - 0.1 * k, 0.0, "intersecting"), (2, 20.0, 3.0, "adjacent")))
        seen.append(rows)
        assert not gap
    assert {r[0][1] for r in seen} == {1} and {r[1][1] for r in seen} == {2}
    assert [r[0][4] for r in seen] == [False, False, True, True, True] and seen[-1][0][6] and not seen[-1][1][6]
    rows, gap = t.step(1.0, objects(9, (1, 9.5, 0.0, "intersecting")))
    assert gap and rows[0][1] == 3 and not rows[0][4]


@pytest.mark.parametrize("rows", [1, 7, 20_000])
def test_stream_tracks_equal_batch_tracks(spark, sf, monkeypatch, rows):
    """However often recordings are split at gaps."""
    monkeypatch.setattr(tracking, "PART_ROWS", rows)
    cols = ["bag", "frame", "id", "track_id", "hits", "confirmed", "gap_reset"]
    a, b = (sorted(map(tuple, q(spark, sf).select(*cols).collect())) for q in (mq.tracker, mq.track_stream))
    assert a == b and any(r[-1] for r in a)


def test_profile_motion_finds_a_shift():
    rng = np.random.default_rng(3)
    base = rng.poisson(3, 400).astype(float)
    c = motion.ProfileParams(0.0, 100.0, 0.5, 21, (0.25, 0.5, 0.25), 1.0, 10.0, 20.0, 2.0, 1.0, 0.0, 5, 3)
    s = motion.signatures(np.stack([base[:200], base[6:206]]), c)
    corr = motion.correlations(s[:1], s[1:], 9)[0]
    assert motion.best_shift(corr, None, c) == pytest.approx(3.0, abs=0.3)
    # Bin by bin, from the definition.
    trend = [sum(base[max(0, i - 10) : min(200, i + 11)]) / 21 for i in range(200)]
    flat = np.array([(base[i] - trend[i]) / math.sqrt(trend[i] + 1) for i in range(200)])
    smooth = np.array([sum(w * flat[i + d] for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)) if 0 <= i + d < 200) for i in range(200)])
    assert s[0] == pytest.approx(smooth / np.linalg.norm(smooth))
    for o in range(9):
        a, b = s[0][o:], s[1][: 200 - o]
        assert corr[o] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_motion_starts_anew_after_a_gap(spark):
    rng = np.random.default_rng(3)
    base = rng.poisson(3, 400).astype(float)
    c = motion.ProfileParams(0.0, 100.0, 0.5, 21, (0.25, 0.5, 0.25), 1.0, 10.0, 20.0, 2.0, 1.0, 0.1, 5, 3)
    at = [0, 2, 4, 6, 8, 10, 40, 43, 46]
    ns = [int(1e9) * t for t in (0, 1, 2, 3, 4, 5, 60, 61, 62)]
    rows = [(bag, i, n, base[a : a + 200].tolist()) for bag in (1, 2) for i, (a, n) in enumerate(zip(at, ns, strict=True))]
    got = motion.profile_motion(spark.createDataFrame(rows, "bag long, frame long, ns long, counts array<double>"), c).where("bag = 2").orderBy("frame").collect()
    assert [r.step is None for r in got] == [True] + [False] * 5 + [True] + [False] * 2
    assert [r.position for r in got] == pytest.approx([0, 1, 2, 3, 4, 5, 5, 6.5, 8], abs=0.5)


def test_planes_and_rails_of_exact_scenes():
    rng = np.random.default_rng(6)
    x, y = rng.uniform(1, 50, 8000), rng.uniform(-1.4, 1.4, 8000)
    bed = np.c_[x, y, -1.8 + 0.01 * x + rng.normal(0, 0.005, 8000)]
    clutter = np.c_[rng.uniform(1, 50, 2000), rng.uniform(-1.4, 1.4, 2000), rng.uniform(-2.4, -1.1, 2000)]
    fit = fits.robust_plane(np.r_[bed, clutter], mq.PLANE)
    assert fit.reason == "supported_track_bed" and fit.abc == pytest.approx([0.01, 0, -1.8], abs=0.01) and fit.fraction > 0.7
    assert fits.robust_plane(bed[:10], mq.PLANE).reason == "insufficient_track_bed_points"
    assert fits.robust_plane(np.c_[bed[:, 0], bed[:, 1], -2.0 + 0.9 * bed[:, 1]], mq.PLANE).reason in ("weak_track_bed_plane", "no_upright_track_bed_plane")
    along = np.arange(1, 55, 0.05)
    centre = lambda v: 0.1 + 0.001 * v * v / 2
    rails = np.concatenate([np.c_[along, centre(along) + s * 0.76 + rng.normal(0, 0.01, len(along)), np.full(len(along), 0.2)] for s in (-1, 1)])
    found = fits.rail_anchors(rails, rails[:, 2], mq.RAIL)
    assert len(found) >= 10 and all(abs(c - centre(a)) < 0.06 and abs(g - 1.52) < 0.03 for a, c, g, _ in found)
    straight = rails - np.c_[np.zeros(len(rails)), centre(rails[:, 0]), np.zeros(len(rails))]
    twice = np.r_[straight + [0, 0.2, 0], straight - [0, 0.2, 0]]  # two tracks, neither likelier
    assert fits.rail_anchors(twice, twice[:, 2], mq.RAIL) == [] and len(fits.rail_anchors(straight, straight[:, 2], mq.RAIL)) >= 10
    e = fits.Expected(0.1, 0.0, 0.5)
    pairs = fits.rail_pairs(rails[:, 0], rails[:, 1], mq.RAIL, e)
    count = fits.lateral_profile(rails[:, 0], rails[:, 1], mq.RAIL)
    cells = {(math.floor(a / 0.3), math.floor((b + 4) / 0.04) + 2) for a, b, _ in rails}
    assert count.tolist() == [sum(k == i for _, k in cells) for i in range(len(count))] and (np.diff(pairs[:, 0]) <= 0).all()
    assert fits.without_stray_end([(5, 0, 1.5, 9), (9, 0, 1.5, 9), (13, 2, 1.5, 9)], mq.RAIL) == [(5, 0, 1.5, 9), (9, 0, 1.5, 9)]


def allowed_pairs(far, shape, gate, shape_gate):
    i, j = np.nonzero((far <= gate) & (shape <= shape_gate))
    return np.stack([i, j], 1), (far + shape)[i, j]


def test_pairing_equals_all_pairings():
    rng = np.random.default_rng(2)
    for n, m in ((1, 3), (3, 3), (4, 2), (3, 4)):
        for _ in range(20):
            far, shape = rng.uniform(0, 8, (n, m)), rng.uniform(0, 1.5, (n, m))
            every = [list(zip(rows, cols, strict=True)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k)]
            cost = lambda p: sum(far[x] + shape[x] for x in p) + 7 * (n - len(p))  # noqa: B023, E731
            best = min(cost(p) for p in every if all(far[x] <= 5 and shape[x] <= 1 for x in p))
            got = assign.match_or_leave(*allowed_pairs(far, shape, 5.0, 1.0), 7.0)
            assert cost([(i, j) for j, i in got.items()]) == pytest.approx(best)


def test_pairing_by_components_equals_one_large_assignment():
    """Sparse and dense graphs, ties, left nodes that had better stay alone: as cheap as the whole matrix with a column for each left node."""
    rng = np.random.default_rng(4)
    for n, m, share in ((30, 40, 0.05), (25, 25, 0.15), (12, 9, 0.6), (1, 1, 1.0), (40, 3, 0.5)):
        for ties in (False, True):
            cost = rng.integers(0, 4, (n, m)).astype(float) if ties else rng.uniform(0, 12, (n, m))
            allowed = rng.random((n, m)) < share
            pairs = np.argwhere(allowed)
            got = assign.match_or_leave(pairs, cost[allowed], 9.0)
            assert len(set(got.values())) == len(got) and all(allowed[i, j] for j, i in got.items())
            whole = np.hstack([np.where(allowed, cost, 1e6), np.full((n, n), 9.0)])
            best = sum(whole[i, j] for i, j in assign.assign(whole))
            assert sum(cost[i, j] for j, i in got.items()) + 9 * (n - len(got)) == pytest.approx(best)
    assert assign.match_or_leave(np.zeros((0, 2), int), np.zeros(0), 1.0) == {}


def test_fragments_never_change_what_others_get():
    """Two tracks and two objects, where a fragment beside them would take one of them in a common matrix."""
    first = objects(0, (1, 10.0, 0.0, "adjacent"), (2, 10.9, 0.0, "adjacent"))
    second = objects(1, (1, 10.3, 0.0, "adjacent"), (2, 11.0, 0.0, "adjacent"))
    extra = objects(1, (1, 10.3, 0.0, "adjacent"), (2, 11.0, 0.0, "adjacent"), (3, 10.02, 0.0, "adjacent"))

    def ids(*scans):
        t = tracking.Tracker(PARAMS)
        return [[r[1] for r in t.step(0.1 * k, s)[0]] for k, s in enumerate(scans)]

    assert ids(first, second) == [[1, 2], [1, 2]]
    assert ids(first, extra)[1] != [1, 2, 3]  # one matrix: the third object takes a track
    assert ids(first, extra.assign(fragment=[False, False, True]))[1] == [1, 2, 3]
    assert ids(first, extra.assign(fragment=[False, False, True]), objects(2, (1, 10.03, 0.0, "adjacent")).assign(fragment=[True]))[2] == [3]


def test_pairs_are_those_of_the_squared_distance():
    rng = np.random.default_rng(5)
    m = tracking.Motion(PARAMS)
    a = rng.standard_normal((7, 6, 6))
    state, cov, extent, centre, size = rng.standard_normal((7, 6)), a @ a.transpose(0, 2, 1), rng.uniform(0.5, 2, (7, 3)), rng.standard_normal((9, 3)), rng.uniform(0.5, 2, (9, 3))
    pairs, cost = m.pairs(state, cov, extent, centre, size, 3.0, 1.0)
    want = {}
    for i in range(7):
        for j in range(9):
            off = centre[j] - state[i, :3]
            far, shape = off @ np.linalg.solve(cov[i, :3, :3] + m.measured, off), np.linalg.norm(np.log((size[j] + 0.1) / (extent[i] + 0.1)))
            if far <= 3 and shape <= 1:
                want[i, j] = far + shape
    assert {tuple(x) for x in pairs.tolist()} == set(want) and cost == pytest.approx([want[tuple(x)] for x in pairs.tolist()])


def test_density_labels_keep_a_thin_chain_apart(spark):
    blob = lambda x0, i0: [(1, i0 + k, x0 + 0.1 * (k % 3), 0.1 * (k // 3), 0.0) for k in range(9)]
    chain = [(1, 100, 0.62, 0.1, 0.0), (1, 101, 1.02, 0.1, 0.0), (1, 102, 1.42, 0.1, 0.0)]
    p = cloud(spark, blob(0.0, 0) + chain + blob(1.8, 50))
    got = {r.point_id: r for r in segments.density_labels(p, segments.DensityParams(0.42, 0.0, 0.42, 1.0, 5.0, 5.0, 30.0)).collect()}
    assert got[0].label != got[50].label and not got[101].core


def test_events_follow_lateral_place(spark):
    c = spark.createDataFrame([(1, f, f, 0.0 if f % 2 else 5.0, 0.0, 50.0 - f) for f in range(6)], "bag long, frame long, id long, y double, z double, distance double")
    got = sorted((r.first_frame, r.last_frame, r.frames) for r in tracking.group_events(c, 3, 0.5, 0.5).collect())
    assert got == [(0, 4, 3), (1, 5, 3)]


def test_events_equal_the_greedy_rule_however_recordings_lie(spark):
    """Against the rule on whole recordings: pauses, several bags, a null one, ties; a long recording without a pause streams through its task."""
    rng = np.random.default_rng(7)
    rows = [(bag, int(f), i, float(rng.integers(0, 6)) / 2, float(rng.integers(0, 3)) / 2, float(rng.uniform(5, 90))) for bag in (1, 2, None) for f in np.cumsum(rng.choice([0, 1, 2, 3, 9], 150)) for i in range(int(rng.integers(1, 4)))]
    rows = [(b, f, k, *rest) for k, (b, f, _, *rest) in enumerate(rows)]
    got = sorted((r.bag or 0, r.event, r.first_frame, r.last_frame, r.frames, r.min_distance) for r in tracking.group_events(spark.createDataFrame(rows, "bag long, frame long, id long, y double, z double, distance double"), 3, 0.5, 0.5).collect())
    want = []
    for bag in (1, 2, None):
        events = []
        for _, f, _, y, z, d in sorted((r for r in rows if r[0] == bag), key=lambda r: (r[1], r[2])):
            fit = [e for e in events if 0 < f - e[1] <= 3 and abs(y - e[2]) <= 0.5 and abs(z - e[3]) <= 0.5]
            e = max(fit, key=lambda e: (e[1], -events.index(e)), default=None)
            if e is None:
                e = [f, f, y, z, 0, d]
                events.append(e)
            e[1:4], e[4], e[5] = [f, y, z], e[4] + 1, min(e[5], d)
        want += [(bag or 0, n, e[0], e[1], e[4], e[5]) for n, e in enumerate(events)]
    assert got == sorted(want)
    long = spark.range(120_000).select(F.lit(1).alias("bag"), (F.col("id") / 2).cast("long").alias("frame"), F.col("id"), (F.col("id") % 2 * 5).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("distance"))
    assert sorted(r.frames for r in tracking.group_events(long, 3, 0.5, 0.5).collect()) == [60_000, 60_000]
    assert tracking.group_events(long.limit(0), 3, 0.5, 0.5).count() == 0


def test_decoding_flags_invalid_attributes_and_drops_invalid_points(spark):
    layout = clouds.Layout((("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("intensity", 12, 7), ("ring", 16, 4), ("time", 18, 8)), 26)
    a = np.zeros(4, layout.dtype())
    a["x"], a["intensity"], a["ring"], a["time"] = [1, np.nan, 0, 2], [5, 1, 1, np.inf], [3, 1, 1, 7], [10, 11, 11, 14]
    m = spark.createDataFrame([(1, 2, a.tobytes()), (1, 3, b"")], "bag long, frame long, data binary")
    got = clouds.decode_clouds(m, layout).orderBy("point_id").collect()
    assert [(r.source_index, r.x, r.intensity, r.ring, r.time) for r in got] == [(0, 1.0, 5.0, 3, 0.0), (3, 2.0, None, 7, 1.0)]


def test_result_lines_round_trip_without_inference(spark, tmp_path):
    rows = [{"bag": "a", "frame": 1, "status": "obstacle", "objects": [{"track_id": 3, "bbox_min": [1.0, 2.0, 3.0]}], "geometry": {"valid": True}}, {"bag": "a", "frame": 2, "status": "unknown"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "in" / "a-timing.jsonl").write_text(json.dumps(rows[0]))
    r = clouds.read_results(spark, str(tmp_path / "in"))
    clouds.write_results(r, str(tmp_path / "out"))
    again = clouds.read_results(spark, str(tmp_path / "out"), spark.createDataFrame([("a", 1)], "bag string, frame long")).collect()
    assert r.count() == 2 and len(again) == 1 and again[0].objects[0].track_id == 3 and again[0].motion is None
    with pytest.raises(Exception, match="exist"):
        clouds.write_results(r, str(tmp_path / "out"))


def test_label_files_and_duplicate_frames(spark, tmp_path):
    one = [{"obj_id": "1", "obj_type": "Person", "psr": {"position": {"x": 1, "y": 2, "z": 3}, "rotation": {"x": 0, "y": 0, "z": 0}, "scale": {"x": 1, "y": 1, "z": 2}}}]
    (tmp_path / "7.json").write_text(json.dumps(one))
    (tmp_path / "8.json").write_text("[]")
    got = clouds.read_labels(spark, str(tmp_path)).collect()
    assert [(r.frame, r.obj_type, r.psr.scale.z) for r in got] == [(7, "Person", 2.0)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "07.json").write_text(json.dumps(one))
    with pytest.raises(ValueError, match="two files"):
        clouds.read_labels(spark, str(tmp_path))


def test_circle_ignores_outliers_and_lines_have_none():
    a = np.linspace(0, 1, 30)
    x, y = 3 + 50 * np.cos(a), -2 + 50 * np.sin(a)
    y[4] += 5
    cx, cy, r = fits.circle(x, y)
    assert (cx, cy, r) == pytest.approx((3, -2, 50), abs=1.0) and fits.circle(np.arange(5.0), np.arange(5.0)) is None


def test_penalised_spline_follows_a_line_exactly():
    x = np.linspace(0, 40, 30)
    assert fits.penalised_spline(x, 0.2 * x + 1, 5.0, 10.0, np.array([7.0, 33.0])) == pytest.approx([2.4, 7.6], abs=1e-4)


def test_structure_needs_length_and_outward_reach(spark):
    wall = [(1, i, float(i), 2.05, 1.05) for i in range(12)]
    box = [(1, 100 + i, 5.0 + 0.1 * i, 0.05, 1.05) for i in range(8)]
    p = spatial.structural(cloud(spark, wall + box), F.lit(1.6), 0.4, 0.1, 1.0, 5.0, 3, 0.3)
    got = {r.point_id: r.structural for r in p.collect()}
    assert all(got[i] for i in range(12)) and not any(got[100 + i] for i in range(8))


def test_exchange_formats():
    xyz, i = np.array([[1.0, 2.0, 3.0]]), np.array([0.5])
    assert clouds.pcd_bytes(xyz, i).endswith(np.array([1, 2, 3, 0.5], "<f4").tobytes()) and len(clouds.kitti_bytes(xyz, i)) == 16
    assert clouds.kitti_pose(np.eye(4)) == "1 0 0 0 0 1 0 0 0 0 1 0"


def test_rotation_mean_of_opposite_turns():
    q = lambda a: [math.cos(a / 2), 0, 0, math.sin(a / 2)]
    assert assign.mean_rotation(np.array([q(0.2), q(-0.2), [-v for v in q(0.0)]])) == pytest.approx([1, 0, 0, 0])


def test_hash_noise_is_standard_normal(spark):
    r = spark.range(20000).select(generate.gaussian(5, F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03


def test_components_equal_a_plain_search():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (5, 3), (60, 40), (60, 200)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        near = {i: {i} for i in range(n)}
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            merged = near[i] | near[j]
            for k in merged:
                near[k] = merged
        roots = sorted({min(x) for x in near.values()})
        assert assign.union_find(n, a, b).tolist() == [roots.index(min(near[i])) for i in range(n)]


def test_candidates_are_compact_and_alone(spark):
    block = lambda label, x0, y0, n=3: [(0, label, x0 + 0.3 * i, y0 + 0.3 * j, 0.5 + 0.3 * k, True) for i in range(n) for j in range(n) for k in range(n)]
    rows = block(1, 20.0, 0.0) + [(0, 2, 10 + 0.5 * i, 5.0, 0.5 + 0.4 * (i % 2), True) for i in range(160)]
    rows += [r for i in range(6) for r in block(10 + i, 10.0 + 12 * i, -5.0)] + block(30, 50.0, 10.0, 5)
    rows += [(0, 40, 30.0, 15.0, 0.5, False)] * 9
    c = candidates.CompactParams(3, (0.2, 6.0), 0.73, 7.0, 60.0, 9.0, 100)
    found = {r.label: r for r in candidates.clusters(spark.createDataFrame(rows, "frame long, label long, x double, y double, z double, inside boolean"), c).collect()}
    assert found[2].long and found[2].continuous and all(found[10 + i].periodic and found[10 + i].repeats == 5 for i in range(6))
    assert found[30].attached and not found[30].periodic and 40 not in found
    assert [r.label for r in candidates.compact(candidates.clusters(spark.createDataFrame(rows, "frame long, label long, x double, y double, z double, inside boolean"), c)).collect()] == [1]


def test_objects_that_stand_on_the_bed_come_apart(spark):
    body = lambda x0: [(x0 + 0.2 * i, 0.2 * j, 0.2 * k) for i in range(2) for j in range(2) for k in range(1, 8)]
    bed = [(0.2 * i, 0.0, 0.0) for i in range(40)]
    xyz = np.array(body(1.0) + body(5.0)[:20] + bed)
    src, dst = np.nonzero(np.triu(np.linalg.norm(xyz[:, None] - xyz[None], axis=2) < 0.3, 1))
    c = candidates.SurfaceParams(0.1, 6, 0.8, 0.3)
    part = candidates.surface_parts(xyz, xyz[:, 2], src, dst, c)
    assert set(part[:28]) == {0} and set(part[28:48]) == {1}
    left = np.abs(xyz[48:, 0] - 1.1) < np.abs(xyz[48:, 0] - 5.1)
    assert (part[48:][np.abs(xyz[48:, 0] - 3.1) > 0.5] == np.where(left, 0, 1)[np.abs(xyz[48:, 0] - 3.1) > 0.5]).all()
    assert not candidates.surface_parts(xyz, xyz[:, 2] + 1, src, dst, c).any()  # nothing stands on the bed
    p = spark.createDataFrame([(0, i, i // 1000, *map(float, v), float(v[2])) for i, v in enumerate(xyz)], "frame long, point_id long, label long, x double, y double, z double, height double")
    e = spark.createDataFrame([(0, int(i), int(j)) for i, j in zip(src, dst, strict=True)], "frame long, src long, dst long")
    assert [r.part for r in candidates.split_surface(p, e, c).orderBy("point_id").collect()] == part.tolist()


def test_normals_of_planes_and_lines(spark):
    rng = np.random.default_rng(1)
    flat = [(0, i, float(x), float(y), float(0.5 * x + 3)) for i, (x, y) in enumerate(rng.uniform(0, 2, (60, 2)))]
    line = [(1, i, 0.1 * i, 0.0, 0.0) for i in range(20)]
    got = registration.normals(registration.covariances(cloud(spark, flat + line), 1.0, 20)).collect()
    n = np.array([0.5, 0, -1]) / math.sqrt(1.25)
    assert all(abs(abs(r.nx * n[0] + r.ny * n[1] + r.nz * n[2]) - 1) < 1e-6 and r.planarity > 0.999 for r in got if r.frame == 0 and r.nx is not None)
    assert all(r.nx is None and r.planarity is None for r in got if r.frame == 1)
    weak = registration.weak_axes(spark.createDataFrame([(0, 0.0, 0.0, 1.0), (0, 0.0, 1.0, 0.0)], "frame long, nx double, ny double, nz double"), 0.2).first()
    assert weak.information == [0.0, 0.5, 0.5] and weak.weak == ["x"]


def test_quality_of_shifted_scans(spark):
    a = [(0, i, float(i), 0.0, 0.0) for i in range(10)]
    b = [(0, i, i + 0.2, 0.0, 0.0) for i in range(5)]
    r = registration.registration_quality(cloud(spark, a), cloud(spark, b), 0.2).first()
    assert (r.n, r.overlap) == (10, 0.5) and r.residual == pytest.approx(0.2)


def stream_of(spark, tmp_path, batches, schema):
    import os

    for i, rows in enumerate(batches):
        at = str(tmp_path / f"{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(at)
        (f,) = [x for x in os.listdir(at) if x.endswith(".parquet")]
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(f"{at}/{f}", tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_scans_reset_and_say_unknown(spark, tmp_path):
    from corvane.streaming import live

    s = 10**9
    batches = [[(1, 1, 1 * s, 50.0), (1, 2, 2 * s, 50.0)], [(1, 3, 1 * s, 50.0), (1, 4, 2 * s, 50.0), (1, 5, 3 * s, 5.0)], [(1, 6, 30 * s, 50.0), (2, 7, 1 * s, 50.0)]]
    m = live.run_available(live.monitor(stream_of(spark, tmp_path, batches, "bag long, frame long, ns long, returns double"), 10 * s, 20), str(tmp_path / "out"))
    got = {r.frame: (r.outcome, r.status, r.reset, r.processed) for r in m.collect()}
    assert got == {
        1: ("processed", "seen", None, 1), 2: ("processed", "seen", None, 2), 3: ("out_of_order", "unknown", "late", 2), 4: ("duplicate", "seen", None, 2),
        5: ("processed", "unknown", "insufficient_returns", 3), 6: ("processed", "seen", "gap", 4), 7: ("processed", "seen", None, 1),
    }


def test_a_late_scan_clears_tracks_and_ids_go_on(spark, tmp_path):
    from corvane.streaming import live

    row = lambda f, t: (1, f, t * 10**8, 1, 10.0, 0.0, 0.0, 1.0, 1.0, 1.0, "adjacent", 10, 4, False)
    schema = "bag long, frame long, ns long, id long, cx double, cy double, cz double, ex double, ey double, ez double, relation string, support long, certain long, immediate boolean"
    out = live.run_available(live.track_stream(stream_of(spark, tmp_path, [[row(1, 1), row(2, 2)], [row(3, 1), row(4, 3)], [row(5, 3), row(6, 4)]], schema), PARAMS), str(tmp_path / "out"))
    assert sorted((r.frame, r.track_id) for r in out.collect()) == [(1, 1), (2, 1), (4, 2), (6, 2)]


def test_silence_is_unknown(spark, tmp_path):
    import time

    from corvane.streaming import live

    w = live.watchdog(stream_of(spark, tmp_path, [[(1, 1, 5)], [(1, 2, 7)]], "bag long, frame long, ns long"), 500)
    q = w.writeStream.format("memory").queryName("silence").outputMode("append").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.sql("SELECT 1 FROM silence WHERE status = 'unknown'").count():
            time.sleep(0.5)
        rows = [(r.ns, r.status) for r in spark.sql("SELECT * FROM silence").collect()]
    finally:
        q.stop()
    assert (7, "seen") in rows and (7, "unknown") in rows


def test_lines_are_numbered_in_order_over_ranges(spark):
    rows = [(int(x), f"v{x}") for x in np.random.default_rng(1).permutation(500)]
    run = spark.createDataFrame(rows, "frame long, v string").repartition(5)
    assert [(r.line, r.frame) for r in compare.numbered(run, ["frame"]).orderBy("line").collect()] == [(i + 1, i) for i in range(500)]
    m = compare.positional_merge(compare.numbered(run, ["frame"]), compare.numbered(run.where("frame <> 3"), ["frame"]), ["frame"]).orderBy("line").collect()
    assert [r.same for r in m] == [True] * 3 + [False] * 497 and m[-1].after is None and m[3].after.frame == 4


def test_masks_leave_what_protrudes(spark):
    rng = np.random.default_rng(3)
    wall = [(0, i, float(x), 2.0, float(z)) for i, (x, z) in enumerate(rng.uniform(0, 6, (800, 2)))]
    post = [(0, 2000 + i, 3.0 + 0.02 * (i % 5), 1.2 + 0.05 * (i // 20), 2.0 + 0.1 * (i % 20)) for i in range(200)]
    p = cloud(spark, wall + post)
    n = registration.normals(registration.covariances(p, 0.5, 20), least=5)
    patches = [(-1.0, 7.0, (0.0, 1.0, 0.0), -2.0)]
    got = {r.point_id: r for r in background.mask(p, n, patches, background.MaskParams(0.1, 0.8, 0.2, 1.0, 0.4)).collect()}
    protects = [i for i, r in got.items() if r.protects]
    assert len(got) == 1000 and protects and all(i >= 2000 for i in protects)
    where = {i: np.array(v) for _, i, *v in wall + post}
    normal = {r.point_id: r for r in n.collect()}
    for _, i, x, y, z in wall:
        near = any(np.linalg.norm(where[j] - where[i]) <= 0.4 for j in protects)
        agrees = normal[i].ny is not None and abs(normal[i].ny) >= 0.8
        assert got[i].masked == (agrees and not near)


def test_traces_follow_the_nearest_place(spark):
    rows = [(0, s, v) for s in range(6) for v in (0.1 * s, 2.0 - 0.05 * s)] + [(0, 8, 0.5), (0, 2, 5.0), (1, 0, 1.0)]
    got = {(r.frame, r.step, r.value): r.trace for r in background.chain_traces(spark.createDataFrame(rows, "frame long, step long, value double"), 0.35).collect()}
    assert len({got[0, s, 0.1 * s] for s in range(6)}) == 1 == len({got[0, s, 2.0 - 0.05 * s] for s in range(6)})
    assert len({got[0, 0, 0.0], got[0, 0, 2.0], got[0, 8, 0.5], got[0, 2, 5.0]}) == 4 and got[1, 0, 1.0] == 0


def test_one_curvature_for_all_traces(spark):
    rng = np.random.default_rng(7)
    rows = [(0, t, float(x), float(a + b * x + 0.004 * x * x + rng.normal(0, 0.01))) for t, (a, b) in enumerate([(1, 0.1), (-2, 0.0), (5, -0.2)]) for x in rng.uniform(0, 40, 60)]
    got = background.shared_curvature(spark.createDataFrame(rows, "frame long, trace long, x double, y double"), ["frame"], "trace").first()
    m = np.array([[x * x, *[float(t == k) for k in range(3)], *[x * (t == k) for k in range(3)]] for _, t, x, _ in rows])
    assert got.traces == 3 and got.curvature == pytest.approx(np.linalg.lstsq(m, np.array([r[3] for r in rows]), rcond=None)[0][0], rel=1e-6)


def test_a_box_hides_what_is_behind_it(spark):
    p = cloud(spark, [(0, 0, 20.0, 0.0, 0.0), (0, 1, 5.0, 0.0, 0.0), (0, 2, 20.0, 10.0, 0.0), (0, 3, -20.0, 0.0, 0.0), (0, 4, 10.5, 0.2, 0.1)])
    got = {r.point_id: (r.inserted, round(r.x, 6)) for r in background.insert_box(p, [10.0, -1.0, -1.0], [11.0, 1.0, 1.0]).collect()}
    assert got == {0: (True, 10.0), 1: (False, 5.0), 2: (False, 20.0), 3: (False, -20.0), 4: (True, 10.0)}


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 3)), min_size=1, max_size=40))
@settings(max_examples=5, deadline=None)
def test_distinct_values_in_a_window_equal_brute_force(spark, scans):
    rows = [(1, i, t, None if v == 3 else v) for i, (t, v) in enumerate(scans)]
    got = {r.frame: r.distinct for r in episodes.distinct_in_window(spark.createDataFrame(rows, "bag long, frame long, ns long, k long"), "k", 10).collect()}
    assert got == {f: len({v for _, _, u, v in rows if v is not None and t - 10 <= u <= t}) for _, f, t, _ in rows}


def _empty_scene(spark, tunnel):
    from corvane.operators import generate

    frames = spark.createDataFrame([(0,) + (None,) * 6], "frame long, ox double, oy double, oz double, sx double, sy double, sz double")
    return generate.scan_scene(spark, frames, tunnel, generate.Beams()).toPandas()


@pytest.mark.parametrize("radius", [300.0, -80.0])
def test_curved_scene_lies_on_its_surfaces(spark, radius):
    from corvane.operators.generate import Tunnel

    t = Tunnel(radius=radius)
    got = _empty_scene(spark, t)
    r = abs(radius)
    off = np.hypot(got.x, got.y - radius) - r
    for hit, seen in {"wall": np.abs(np.abs(off) - t.half_width), "floor": np.abs(got.z - t.ground_z), "ceiling": np.abs(got.z - t.ceiling_z)}.items():
        assert seen[got.hit == hit].max() < 1e-6
    rail = got.hit == "rail"
    assert rail.sum() > 20
    assert (np.abs(np.abs(off[rail]) - t.rail_gauge / 2) <= t.rail_width / 2 + 1e-6).all()
    assert got.z[rail].between(t.ground_z - 1e-6, t.ground_z + t.rail_height + 1e-6).all()
    assert (np.abs(off) <= t.half_width + 1e-6).all() and got.z.between(t.ground_z - 1e-6, t.ceiling_z + 1e-6).all()


def test_a_very_wide_curve_is_a_straight_tunnel(spark):
    from corvane.operators.generate import Tunnel

    a, b = _empty_scene(spark, Tunnel()).set_index("point_id"), _empty_scene(spark, Tunnel(radius=1e6)).set_index("point_id")
    both = a.join(b, rsuffix="_b", how="inner")
    assert len(both) == len(a) == len(b)
    assert (both.hit == both.hit_b).mean() > 0.99
    same = both[both.hit == both.hit_b]
    # A circle leaves its tangent by x^2 / 2r sideways, which a ray that grazes a wall at slope y / x meets x / y times as far along.
    bound = 1e-3 + 1.1 * same.x**2 / 2e6 * np.maximum(1, same.x / same.y.abs())
    assert (np.abs(same[["x", "y", "z"]].to_numpy() - same[["x_b", "y_b", "z_b"]].to_numpy()).max(axis=1) <= bound).all()


def test_curves_too_tight_are_refused(spark):
    from corvane.operators.generate import Tunnel

    with pytest.raises(ValueError, match="quarter turn"):
        _empty_scene(spark, Tunnel(radius=20.0))
