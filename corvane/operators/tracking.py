"""Tracking of objects over a recording: constant-velocity filter, gated assignment, windowed confirmation.

The step works on one scan's objects (hundreds, never points) and a small state, so a recording is one ordered
group in batch and one key in a stream; both call the same class.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import shared_folder, written
from .assign import FEW, match_few, match_or_leave
from .ranges import affine_scan
from .scans import whole_scans


#: Rows of a recording that are tracked as one group, about.
PART_ROWS = 20_000


@dataclass(frozen=True)
class TrackParams:
    position_sigma: float
    pose_sigma: float
    acceleration_sigma: float
    gate: float
    extent_gate: float
    max_track_gap_s: float
    max_frame_gap_s: float
    hits: int
    window: int
    evidence_window_s: float
    evidence_min: int
    claim_min: int


@dataclass
class Track:
    """All axes have the same start, push and measurement, so one variance of place, one of speed and one covariance hold for each of them."""

    at: tuple[float, float, float]
    speed: tuple[float, float, float]
    spread: tuple[float, float, float]  # var(place), cov(place, speed), var(speed)
    stamp: float
    first: float
    extent: tuple[float, float, float]
    seen: list[int] = field(default_factory=list)
    interior: list[int] = field(default_factory=list)
    evidence: deque[tuple[float, int]] = field(default_factory=deque)
    total: int = 0
    fragment: bool = False


INPUT = ["ns", "frame", "id", "cx", "cy", "cz", "ex", "ey", "ez", "relation", "support", "certain", "immediate"]
COLUMNS = ["id", "track_id", "hits", "accumulated", "confirmed", "presence_confirmed", "intersection_confirmed", "confirmation", "vx", "track_age_s"]


def _logs(extent: tuple[float, ...]) -> list[float]:
    return [math.log(v + 0.1) if v > -0.1 else -math.inf if v == -0.1 else math.nan for v in extent]


class Motion:
    """Constant velocity along each axis, pushed by chance accelerations."""

    def __init__(self, p: TrackParams):
        self.push, self.noise = p.acceleration_sigma**2, p.position_sigma**2 + p.pose_sigma**2

    @property
    def measured(self) -> np.ndarray:
        return np.eye(3) * self.noise

    def ahead(self, t: Track, dt: float) -> tuple[tuple, tuple]:
        """A track's place and spread after dt seconds."""
        a, b, c = t.spread
        q = self.push * dt * dt
        (x, y, z), (u, v, w) = t.at, t.speed
        return (x + dt * u, y + dt * v, z + dt * w), (a + 2 * dt * b + dt * dt * c + q * dt * dt / 4, b + dt * c + q * dt / 2, c + q)

    def few_pairs(self, places: list[tuple], spreads: list[tuple], extents: list[tuple], centres: list[tuple], sizes: list[tuple], gate: float, shape_gate: float) -> list[tuple[int, int, float]]:
        """``pairs`` of few tracks and objects, as (track, object, cost)."""
        out, logs = [], [_logs(s) for s in sizes]
        for i, ((x, y, z), spread, extent) in enumerate(zip(places, spreads, extents, strict=True)):
            (e, f, g), unit = _logs(extent), spread[0] + self.noise
            for j, ((u, v, w), (k, m, n)) in enumerate(zip(centres, logs, strict=True)):
                shape = math.sqrt((k - e) * (k - e) + (m - f) * (m - f) + (n - g) * (n - g))
                far = ((u - x) * (u - x) + (v - y) * (v - y) + (w - z) * (w - z)) / unit
                if shape <= shape_gate and far <= gate:
                    out.append((i, j, far + shape))
        return out

    def pairs(self, state: np.ndarray, cov: np.ndarray, extent: np.ndarray, centre: np.ndarray, size: np.ndarray, gate: float, shape_gate: float) -> tuple[np.ndarray, np.ndarray]:
        """(track, object) that may be one, and what each pair costs: squared distance in units of the prediction's spread, and of log extents."""
        shape = np.sqrt(((np.log(size + 0.1)[None] - np.log(extent + 0.1)[:, None]) ** 2).sum(2))
        i, j = np.nonzero(shape <= shape_gate)
        # The spread's Cholesky factor turns an offset into one of unit spread.
        unit = np.linalg.inv(np.linalg.cholesky(cov[:, :3, :3] + self.measured))
        far = ((unit[i] @ (centre[j] - state[i, :3])[:, :, None])[:, :, 0] ** 2).sum(1)
        near = far <= gate
        return np.stack([i[near], j[near]], 1), (far + shape[i, j])[near]

    def corrected(self, t: Track, at: tuple, spread: tuple, centre: tuple) -> None:
        """Sets a track, predicted at ``at``, after its object was seen at ``centre`` (Joseph form)."""
        a, b, c = spread
        k, m, r = a / (a + self.noise), b / (a + self.noise), self.noise
        off = [s - p for s, p in zip(centre, at, strict=True)]
        t.at = tuple(p + k * o for p, o in zip(at, off, strict=True))
        t.speed = tuple(v + m * o for v, o in zip(t.speed, off, strict=True))
        t.spread = (1 - k) * (1 - k) * a + k * k * r, (1 - k) * (b - m * a) + k * m * r, m * m * a - 2 * m * b + c + m * m * r


class Tracker:
    def __init__(self, p: TrackParams):
        self.p, self.tracks, self.next_id, self.frame, self.last = p, {}, 1, 0, None
        self.motion = Motion(p)

    def reset(self) -> None:
        """Clears tracks but keeps ids and the acquisition time, so a late scan stays late."""
        self.tracks = {}

    def step(self, stamp: float, o: dict[str, np.ndarray] | pd.DataFrame) -> tuple[list[tuple], bool]:
        """Rows in COLUMNS order for the scan's objects, and whether a gap reset came before it.

        ``o``: columns id (ascending), cx, cy, cz, ex, ey, ez, relation, support, certain (claim evidence), immediate, and, if there, fragment: objects
        that were split off another are a pool of their own, with the tracks that were last such an object, so they never change what the others get.
        """
        p, motion = self.p, self.motion
        gap = self.last is not None and stamp - self.last > p.max_frame_gap_s
        if gap:
            self.reset()
        self.last, self.frame = stamp, self.frame + 1
        self.tracks = {k: t for k, t in sorted(self.tracks.items()) if stamp - t.stamp <= p.max_track_gap_s}
        o = {c: v.tolist() if hasattr(v, "tolist") else v for c, v in o.items()}
        centre, extent = (list(zip(*(map(float, o[c]) for c in names), strict=True)) for names in (("cx", "cy", "cz"), ("ex", "ey", "ez")))
        pool = o.get("fragment") or [False] * len(centre)
        keys, owner, ahead = list(self.tracks), {}, []
        if keys and centre:
            known = list(self.tracks.values())
            ahead = [motion.ahead(t, stamp - t.stamp) for t in known]
            places, spreads, extents, alone = [a for a, _ in ahead], [s for _, s in ahead], [t.extent for t in known], p.gate + p.extent_gate + 1
            if len(known) * len(centre) <= FEW:
                few = motion.few_pairs(places, spreads, extents, centre, extent, p.gate, p.extent_gate)
                owner = match_few([e for e in few if known[e[0]].fragment == pool[e[1]]], alone)
            else:
                state, cov = np.column_stack([np.array(places), np.zeros((len(known), 3))]), np.eye(3)[None] * np.array(spreads)[:, 0, None, None]
                pairs, cost = motion.pairs(state, cov, np.array(extents), np.array(centre), np.array(extent), p.gate, p.extent_gate)
                alike = np.array([t.fragment for t in known], bool)[pairs[:, 0]] == np.array(pool, bool)[pairs[:, 1]]
                owner = match_or_leave(pairs[alike], cost[alike], alone)
        rows = []
        for j in range(len(centre)):
            if j in owner:
                k = keys[owner[j]]
                t = self.tracks[k]
                motion.corrected(t, *ahead[owner[j]], centre[j])
            else:
                k, self.next_id = self.next_id, self.next_id + 1
                t = self.tracks[k] = Track(centre[j], (0.0, 0.0, 0.0), (p.position_sigma**2, 0.0, 1.0), stamp, stamp, extent[j])
            t.stamp, t.extent, t.fragment = stamp, extent[j], bool(pool[j])
            rows.append((int(o["id"][j]), int(k), *self.decide(t, stamp, o["relation"][j] == "intersecting", int(o["support"][j]), int(o["certain"][j]), bool(o["immediate"][j]))))
        return rows, gap

    def decide(self, t: Track, stamp: float, inside: bool, support: int, certain: int, immediate: bool) -> tuple:
        """What is known of a track after this scan: COLUMNS from ``hits`` on."""
        p, oldest = self.p, self.frame - self.p.window
        t.seen = [f for f in t.seen if f > oldest] + [self.frame]
        t.interior = [f for f in t.interior if f > oldest] + [self.frame] * inside
        while t.evidence and stamp - t.evidence[0][0] > p.evidence_window_s:
            t.total -= t.evidence.popleft()[1]
        t.evidence.append((stamp, support))
        t.total += support
        steady = len(t.seen) >= p.hits and t.total >= p.evidence_min
        confirmed = immediate or (steady and certain >= p.claim_min)
        intersects = inside and confirmed and (immediate or len(t.interior) >= p.hits)
        how = "immediate_interior_geometry" if immediate else "temporal_evidence" if confirmed else "pending"
        return len(t.seen), t.total, confirmed, immediate or steady, intersects, how, t.speed[0], float(stamp - t.first)


OUT = "bag long, frame long, gap_reset boolean, id long, track_id long, hits int, accumulated int, confirmed boolean, presence_confirmed boolean, intersection_confirmed boolean, confirmation string, vx double, track_age_s double"


def run_columns(tracker: Tracker, bag: int, cols: dict[str, list]) -> Iterator[tuple]:
    """Every row of a recording's objects, scan by scan; ``cols`` are in the order of ns, frame and id."""
    ns, frame = cols["ns"], cols["frame"]
    rest = {c: v for c, v in cols.items() if c not in ("ns", "frame")}
    a, n = 0, len(ns)
    while a < n:
        b = a + 1
        while b < n and ns[b] == ns[a] and frame[b] == frame[a]:
            b += 1
        rows, gap = tracker.step(ns[a] / 1e9, {c: v[a:b] for c, v in rest.items()})
        for r in rows:
            yield (bag, int(frame[a]), gap, *r)
        a = b


def run_scans(tracker: Tracker, bag: int, g: pd.DataFrame) -> Iterator[tuple]:
    """``run_columns`` of a table in any order."""
    order = np.lexsort((g["id"].to_numpy(), g["frame"].to_numpy(), g["ns"].to_numpy()))
    return run_columns(tracker, bag, {c: g[c].to_numpy()[order].tolist() for c in [*INPUT, *(c for c in ("fragment",) if c in g)]})


def track(objects: DataFrame, params: TrackParams) -> DataFrame:
    """Tracks each recording's objects (bag, frame, ns, id, c*, e*, relation, support, certain, immediate) in order.

    A gap clears all tracks, so a recording is split at the first gap after every ``PART_ROWS`` rows or so; each part is a group, and its tracks'
    numbers go on from those of the parts before.
    """
    order = W.partitionBy("bag").orderBy("ns", "frame", "id")
    late = F.coalesce((F.col("ns") / 1e9 - F.lag("ns").over(order) / 1e9) > params.max_frame_gap_s, F.lit(False))
    rows = objects.withColumns({"late": late, "at": F.row_number().over(order)})
    since = F.max(F.when(F.col("late"), F.col("at"))).over(order.rowsBetween(W.unboundedPreceding, 0))  # the first row after the latest gap
    parts = rows.withColumn("part", F.floor(F.coalesce(since, F.lit(0)) / PART_ROWS)).drop("late", "at")

    schema = T.StructType.fromDDL(OUT + ", part long")
    names, out = [*INPUT, *(c for c in ("fragment",) if c in objects.columns)], to_arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in whole_scans(batches, 2):
            cols = {c: t.column(c).to_numpy().tolist() for c in ("bag", "part", *names)}
            first, rows = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist(), []
            for a, b in zip(first, [*first[1:], len(of)], strict=True):
                part, head = cols["part"][a], cols["frame"][a]  # the scan that a gap came before
                rows += [(r[0], r[1], r[2] or (part > 0 and r[1] == head), *r[3:], part) for r in run_columns(Tracker(params), int(cols["bag"][a]), {c: cols[c][a:b] for c in names})]
            yield from pa.table([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out).to_batches(max_chunksize=1 << 16)

    spark = objects.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/tracks-{uuid.uuid4().hex}"
    # Few bytes make much work here, so Spark isn't left to join small partitions to one task. Parts stream through it in order, many in a table.
    dealt = parts.select("bag", "part", *names).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bag", "part")
    solved = dealt.sortWithinPartitions("bag", "part", "ns", "frame", "id").mapInArrow(solve, schema)
    solved.write.parquet(at)  # read twice below
    found = spark.read.schema(solved.schema).parquet(at)
    made = found.groupBy("bag", "part").agg(F.max("track_id").alias("made"))
    before = F.coalesce(F.sum("made").over(W.partitionBy("bag").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    made = made.select(F.col("bag").alias("b"), F.col("part").alias("p"), before.alias("before"))
    joined = found.join(made, F.col("bag").eqNullSafe(F.col("b")) & (F.col("part") == F.col("p")))
    return joined.withColumn("track_id", F.col("track_id") + F.col("before")).drop("part", "b", "p", "before")


def greedy_events(batches: Iterator[pd.DataFrame], max_frame_gap: int, tol_y: float, tol_z: float) -> Iterator[pd.DataFrame]:
    """Events of candidates (bag, part, frame, y, z, distance) in order, a table for each batch of them."""
    at, events, made, done = None, [], 0, []
    columns = ["bag", "part", "event", "first_frame", "last_frame", "frames", "min_distance", "drift"]

    def close(ended: list[dict]) -> None:
        done.extend((*at, e["event"], e["first"], e["last"], e["frames"], e["least"], e["hi"] - e["lo"]) for e in ended)

    for b in batches:
        for bag, frame, y, z, distance, part in zip(*(b[x].tolist() for x in ("bag", "frame", "y", "z", "distance", "part")), strict=True):
            if at is None or part != at[1] or (bag != at[0] and not (pd.isna(bag) and pd.isna(at[0]))):
                close(events)
                at, events, made = (bag, part), [], 0
            if any(frame - e["last"] > max_frame_gap for e in events):
                close([e for e in events if frame - e["last"] > max_frame_gap])
                events = [e for e in events if frame - e["last"] <= max_frame_gap]
            fits = [e for e in events if frame > e["last"] and abs(y - e["y"]) <= tol_y and abs(z - e["z"]) <= tol_z]
            e = max(fits, key=lambda e: (e["last"], -e["event"]), default=None)
            if e is None:
                e = {"event": made, "first": frame, "frames": 0, "least": distance, "lo": y, "hi": y}
                events.append(e)
                made += 1
            e |= {"last": frame, "y": y, "z": z, "frames": e["frames"] + 1, "least": min(e["least"], distance), "lo": min(e["lo"], y), "hi": max(e["hi"], y)}
        # A table for a batch of candidates, however many parts it holds: parts may be of one candidate each.
        if done:
            yield pd.DataFrame(done, columns=columns)
            done.clear()
    close(events)
    if done:
        yield pd.DataFrame(done, columns=columns)


def group_events(candidates: DataFrame, max_frame_gap: int, tol_y: float, tol_z: float) -> DataFrame:
    """Events of (bag, frame, id, y, z, distance): an object keeps its lateral and vertical place while x changes.

    Greedy in frame order; among fitting events the one seen last wins, then the older one. No event outlives a pause of more than ``max_frame_gap`` frames, so a
    recording is split there, wherever it lies (the pauses are counted range by range), and its events' numbers are joined up again. Parts
    stream through their task in order; an event leaves it when no candidate can follow: what is held are the open events.
    """
    kind = candidates.schema["bag"].dataType.simpleString()
    c = candidates.select("bag", "frame", "id", *[F.col(x).cast("double").alias(x) for x in ("y", "z", "distance")])
    parts = affine_scan(c, ["bag"], ["frame", "id"], ["frame"], lambda before: ([[1.0]], [(F.col("frame") - before("frame") > max_frame_gap).cast("double")]), ["part"])
    dealt = parts.repartition("bag", "part").sortWithinPartitions("bag", "part", "frame", "id")

    found = written(dealt.mapInPandas(lambda batches: greedy_events(batches, max_frame_gap, tol_y, tol_z), f"bag {kind}, part double, event long, first_frame long, last_frame long, frames long, min_distance double, drift double"), "events")  # read twice
    order = W.partitionBy("bag").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    made = found.groupBy("bag", "part").agg((F.max("event") + 1).alias("made")).select(F.col("bag").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("made").over(order), F.lit(0)).alias("before"))
    joined = found.join(made, F.col("bag").eqNullSafe(F.col("b")) & (F.col("part") == F.col("p")))
    return joined.select("bag", (F.col("event") + F.col("before")).alias("event"), "first_frame", "last_frame", "frames", "min_distance", "drift")
