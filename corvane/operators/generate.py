"""Synthetic scenes with exact labels: ray casting as DataFrame expressions, noise from hashes.

Every random number is a hash of (seed, frame, beam), so a scene is the same however it is partitioned or recomputed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ray_box, ray_cylinder


@dataclass(frozen=True)
class Tunnel:
    ground_z: float = -1.8
    rail_height: float = 0.18
    rail_gauge: float = 1.52
    rail_width: float = 0.08
    half_width: float = 2.6
    ceiling_z: float = 3.2
    end: float = 90.0
    #: Signed radius of a circular centre line, bending to positive y; none: straight. ``end`` is then an arc length, under a quarter turn.
    radius: float | None = None


@dataclass(frozen=True)
class Beams:
    azimuths: int = 90
    azimuth_span_deg: float = 60.0
    elevations_deg: tuple[float, float, int] = (-16.0, 12.0, 40)


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) from the hash of the key."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def gaussian(seed: int, *key: Column) -> Column:
    """A standard normal number from two hashes (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *key))) * F.cos(2 * math.pi * uniform(seed + 1, *key))


def beam_table(spark: SparkSession, beams: Beams) -> DataFrame:
    """(beam, ring, dx, dy, dz): unit directions."""
    lo, hi, n = beams.elevations_deg
    a = F.radians(-beams.azimuth_span_deg / 2 + beams.azimuth_span_deg * (F.col("id") % beams.azimuths) / max(1, beams.azimuths - 1))
    ring = F.floor(F.col("id") / beams.azimuths)
    e = F.radians(lo + (hi - lo) * ring / max(1, n - 1))
    return spark.range(beams.azimuths * n).select(F.col("id").alias("beam"), ring.cast("int").alias("ring"), (F.cos(e) * F.cos(a)).alias("dx"), (F.cos(e) * F.sin(a)).alias("dy"), F.sin(e).alias("dz"))


def ahead(rate: Column, distance: float) -> Column:
    """How far along a ray, which nears a plane at ``rate``, the plane at that signed distance is; null if it lies behind or beside."""
    return F.when(rate * distance > 0, F.lit(distance) / rate)


def straight_hits(d: list[Column], tunnel: Tunnel) -> dict[str, Column]:
    """Distance from the origin along (dx, dy, dz) to each surface of a straight tunnel."""
    hits = {
        "floor": ahead(d[2], tunnel.ground_z), "ceiling": ahead(d[2], tunnel.ceiling_z), "end": ahead(d[0], tunnel.end),
        "wall": F.coalesce(ahead(d[1], tunnel.half_width), ahead(d[1], -tunnel.half_width)),
    }
    for s in (-1, 1):
        y = s * tunnel.rail_gauge / 2
        hits[f"rail{s}"] = ray_box([F.lit(0.0)] * 3, d, [F.lit(0.0), F.lit(y - tunnel.rail_width / 2), F.lit(tunnel.ground_z)], [F.lit(tunnel.end), F.lit(y + tunnel.rail_width / 2), F.lit(tunnel.ground_z + tunnel.rail_height)])
    return hits


def curved_hits(d: list[Column], tunnel: Tunnel) -> dict[str, Column]:
    """The same for a tunnel on a circle: walls and rail sides are vertical cylinders, rail heads are rings, the end is a radial plane."""
    r = abs(tunnel.radius)
    angle = tunnel.end / r
    if r <= tunnel.half_width or angle >= math.pi / 2:
        raise ValueError("the curve must be wider than the tunnel and end before a quarter turn")
    dx, dy, dz = d[0], d[1] * math.copysign(1.0, tunnel.radius), d[2]
    first = lambda ts: F.try_element_at(ts, F.lit(1))
    hits = {
        "floor": ahead(dz, tunnel.ground_z), "ceiling": ahead(dz, tunnel.ceiling_z),
        "end": ahead(dx * math.cos(angle) + dy * math.sin(angle), r * math.sin(angle)),
        "wall": F.least(*[first(ray_cylinder(dx, dy, r, r + s * tunnel.half_width)) for s in (-1, 1)]),
    }
    low, top = tunnel.ground_z, tunnel.ground_z + tunnel.rail_height
    for s in (-1, 1):
        inner, outer = (r + s * tunnel.rail_gauge / 2 + e * tunnel.rail_width / 2 for e in (-1, 1))
        sides = [first(F.filter(ray_cylinder(dx, dy, r, edge), lambda t: (t * dz >= low) & (t * dz <= top))) for edge in (inner, outer)]
        head = ahead(dz, top)
        hits[f"rail{s}"] = F.least(*sides, F.when(F.hypot(head * dx, head * dy - r).between(inner, outer), head))
    return hits


def scan_scene(spark: SparkSession, frames: DataFrame, tunnel: Tunnel, beams: Beams, noise: float = 0.0, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """(frame, point_id, ring, x, y, z, hit) of each frame's scan; ``hit`` says floor, wall, ceiling, rail, end or object.

    ``frames``: (frame, ox, oy, oz, sx, sy, sz) with the object's near lower corner and size, all null without an object.
    Each frame meets the fixed beam pattern by an exploded array, so no cross join is planned.
    """
    pattern = beam_table(spark, beams)
    rows = [tuple(r) for r in pattern.orderBy("beam").collect()]  # the sensor's fixed pattern
    side = spark.createDataFrame(rows, pattern.schema).withColumn("slot", F.col("beam") % 64)
    grid = frames.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>"))).join(F.broadcast(side), "slot").drop("slot")
    d = [F.col("dx"), F.col("dy"), F.col("dz")]
    zero = [F.lit(0.0)] * 3
    ahead = lambda c, v: F.when(c * v > 0, F.lit(v) / c)
    hits = straight_hits(d, tunnel) if tunnel.radius is None else curved_hits(d, tunnel)
    low = [F.col(f"o{c}") for c in "xyz"]
    hits["object"] = F.when(F.col("ox").isNotNull(), ray_box(zero, d, low, [a + F.col(f"s{c}") for a, c in zip(low, "xyz", strict=True)]))
    nearest = F.array_min(F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(t.alias("t"), F.lit(k.rstrip("-1")).alias("hit"))) for k, t in hits.items()])))
    key = (F.col("frame"), F.col("beam"))
    cast = grid.withColumn("h", nearest).where(F.col("h").isNotNull())
    if dropout:
        cast = cast.where(uniform(seed + 7, *key) >= dropout)
    t = F.col("h.t") + (F.lit(noise) * gaussian(seed, *key) if noise else 0.0)
    return cast.select("frame", F.col("beam").alias("point_id"), "ring", *[(t * v).alias(c) for v, c in zip(d, "xyz", strict=True)], F.col("h.hit").alias("hit"))
