"""How a sensor stands over its track: support plane and centre line of paired rail heads, orientation, and what holds later of what was fitted before.

Everything but the eigenvectors of mean rotations is aggregates and closed forms; those are solved for whole batches of 4 x 4 matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

KEYS = ("frame",)
QUATERNION = ("qw", "qx", "qy", "qz")


@dataclass(frozen=True)
class MountParams:
    near: float
    far: float  # stretch of track that is used: near <= x < far
    bin: float
    half_width: float  # of a rail
    low: float
    high: float  # heights above the bed that a rail may have, both excluded
    quantile: float  # a head's points are those of a bin and side from this quantile of height on
    points: int  # least points of a bin and side
    upper: int  # and of its head
    pairs: int  # least bins with both sides
    span: float  # and their least stretch
    residual: float  # most that a head may lie off the plane, or a middle off the line


def heads(points: DataFrame, c: MountParams, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, bin, side, n, hx, hy, hz): medians of the upper points of each rail, bin by bin. ``points``: keys, x, y, z, height, center, spacing."""
    p = points.where((F.col("x") >= c.near) & (F.col("x") < c.far) & (F.col("height") > c.low) & (F.col("height") < c.high))
    off = F.col("y") - F.col("center")
    side = F.when(F.abs(off + F.col("spacing") / 2) < c.half_width, -1).when(F.abs(off - F.col("spacing") / 2) < c.half_width, 1)
    p = p.withColumns({"bin": F.floor((F.col("x") - c.near) / c.bin), "side": side}).where("side is not null")
    own = W.partitionBy(*keys, "bin", "side")  # a stretch of one rail of one scan
    p = p.withColumns({"__n": F.count("*").over(own), "__from": F.percentile("height", F.lit(c.quantile)).over(own)}).where((F.col("__n") >= c.points) & (F.col("height") >= F.col("__from")))
    return p.groupBy(*keys, "bin", "side").agg(F.count("*").alias("n"), *[F.median(a).alias(f"h{a}") for a in "xyz"]).where(F.col("n") >= c.upper)


def observe(points: DataFrame, c: MountParams, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, state, reason, pairs, stretch, height, lateral, plane_residual, line_residual, separation, forward, left, up) of every scan.

    One least squares of z on (x, y) over all heads gives the support plane, one of y on x over the pairs' middles the centre line; both come from a scan's
    second moments. Height and lateral offset are those of the origin above the plane and to the left of the line. ``state`` is ``observed``,
    ``unsupported_fit`` (a residual is too large) or ``unavailable``, where the rest but counts may be null.
    """
    h = heads(points, c, keys)
    both = h.groupBy(*keys, "bin").agg(*[F.max(F.when(F.col("side") == s, F.struct("hx", "hy", "hz"))).alias(n) for s, n in ((-1, "r"), (1, "l"))]).where("r is not null and l is not null")
    both = both.withColumns({"mx": (F.col("r.hx") + F.col("l.hx")) / 2, "my": (F.col("r.hy") + F.col("l.hy")) / 2})
    q = both.select(*keys, "bin", "mx", "my", "r", "l", F.explode(F.array("r", "l")).alias("h"))
    x, y, z = (F.col(f"h.h{a}") for a in "xyz")
    m = q.groupBy(*keys).agg(
        (F.count("*") / 2).cast("long").alias("pairs"), (F.max("mx") - F.min("mx")).alias("stretch"), F.avg(x).alias("ax"), F.avg(y).alias("ay"), F.avg(z).alias("az"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"),
        F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"), F.var_pop("mx").alias("mm"), F.covar_pop("mx", "my").alias("ml"), F.avg("mx").alias("bx"), F.avg("my").alias("by"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solid = (det > 1e-12 * F.col("xx") * F.col("yy")) & (F.col("mm") > 0)
    m = m.withColumns({"a": F.when(solid, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det), "b": F.when(solid, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det), "s": F.when(solid, F.col("ml") / F.col("mm"))})
    m = m.withColumns({"c": F.col("az") - F.col("a") * F.col("ax") - F.col("b") * F.col("ay"), "o": F.col("by") - F.col("s") * F.col("bx"), "size": F.sqrt(1 + F.col("a") * F.col("a") + F.col("b") * F.col("b"))})
    unit = lambda v: [x / F.sqrt(sum((e * e for e in v), F.lit(0.0))) for x in v]
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    up, forward = unit([-a, -b, F.lit(1.0)]), unit([F.lit(1.0), s, a + b * s])
    left = [up[1] * forward[2] - up[2] * forward[1], up[2] * forward[0] - up[0] * forward[2], up[0] * forward[1] - up[1] * forward[0]]
    m = m.withColumns({"up": F.array(*up), "forward": F.array(*forward), "left": F.array(*left)})
    m = m.withColumns({"height": -F.col("c") / F.col("size"), "lateral": -(F.col("left")[1] * F.col("o") + F.col("left")[2] * (b * F.col("o") + F.col("c")))})
    # Residuals and the heads' distance need the fit, so they are a second aggregate over a row for each bin.
    off = lambda e: F.abs(F.col(f"{e}.hz") - a * F.col(f"{e}.hx") - b * F.col(f"{e}.hy") - F.col("c")) / F.col("size")
    apart = sum(((F.col(f"l.h{e}") - F.col(f"r.h{e}")) * F.col("left")[i] for i, e in enumerate("xyz")), F.lit(0.0))
    fit = both.select(*keys, "r", "l", "mx", "my").join(m.select(*keys, "a", "b", "c", "s", "o", "size", "left"), list(keys))
    fit = fit.groupBy(*keys).agg(F.max(F.greatest(off("r"), off("l"))).alias("plane_residual"), F.max(F.abs(F.col("my") - s * F.col("mx") - F.col("o"))).alias("line_residual"), F.median(apart).alias("separation"))
    out = points.select(*keys).distinct().join(m, list(keys), "left").join(fit, list(keys), "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    reason = F.when(F.col("pairs") < c.pairs, "insufficient_paired_bins").when(F.col("stretch") < c.span, "insufficient_paired_stretch").when(F.col("a").isNull(), "degenerate_heads")
    reason = reason.when(F.greatest("plane_residual", "line_residual") > c.residual, "not_straight_or_planar").otherwise("supported_heads")
    state = F.when(reason == "supported_heads", "observed").when(reason == "not_straight_or_planar", "unsupported_fit").otherwise("unavailable")
    return out.select(*keys, state.alias("state"), reason.alias("reason"), "pairs", "stretch", "height", "lateral", "plane_residual", "line_residual", "separation", "forward", "left", "up")


def with_quaternion(df: DataFrame, rows: list[Column]) -> DataFrame:
    """``df`` with the quaternion (qw .. qz) of the rotation matrix whose rows are these arrays, from its largest component: no division is by something small."""
    names = [f"__m{i}{j}" for i in range(3) for j in range(3)]
    a, b, c, d, e, f, g, h, i = (F.col(n) for n in names)
    out = df.withColumns({n: rows[k // 3][k % 3] for k, n in enumerate(names)})
    out = out.withColumn("__squares", F.array(1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i))
    out = out.withColumn("__most", F.array_position("__squares", F.array_max("__squares"))).withColumn("__root", 2 * F.sqrt(F.array_max("__squares")))
    # The four products of the largest component with each; row k of the table is for component k.
    table = F.array(*[F.array(*x) for x in ([F.col("__squares")[0], h - f, c - g, d - b], [h - f, F.col("__squares")[1], b + d, c + g], [c - g, b + d, F.col("__squares")[2], f + h], [d - b, c + g, f + h, F.col("__squares")[3]])])
    out = out.withColumn("__line", F.try_element_at(table, F.col("__most").cast("int")))
    return out.withColumns({n: F.col("__line")[k] / F.col("__root") for k, n in enumerate(QUATERNION)}).drop(*names, "__squares", "__most", "__root", "__line")


def mean_rotations(rotations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, qw, qx, qy, qz): the mean of unit quaternions (qw .. qz) of each key, whatever their signs; its largest component is positive.

    The mean is the leading eigenvector of the summed outer products: ten sums for each key, whose 4 x 4 matrices are solved a batch at a time. Quaternions
    are taken at unit length; null, zero and non-finite ones take no part, and keys without any have no row.
    """
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in QUATERNION), F.lit(0.0)))
    r = rotations.withColumn("__s", size).where((F.col("__s") > 0) & (F.col("__s") < float("inf")))
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = r.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(QUATERNION[i]) * F.col(QUATERNION[j]) / F.col("__s") / F.col("__s")).alias(f"s{i}{j}") for i, j in pairs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.zeros((len(b), 4, 4))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = b[f"s{i}{j}"]
            v = np.linalg.eigh(m)[1][:, :, -1]
            v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None]
            yield pd.concat([b[[*keys, "n"]], pd.DataFrame(v, columns=list(QUATERNION), index=b.index)], axis=1)

    head = "".join(f"{k} {sums.schema[k].dataType.simpleString()}, " for k in keys)
    return sums.mapInPandas(solve, f"{head}n long, qw double, qx double, qy double, qz double")


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two unit quaternions, sign-free; from the difference's length, which stays exact for small angles."""
    near, far = (F.sqrt(sum(((x - s * y) * (x - s * y) for x, y in zip(a, b, strict=True)), F.lit(0.0))) for s in (1, -1))
    return F.degrees(4 * F.asin(F.least(F.least(near, far) / 2, F.lit(1.0))))


def deviations(rotations: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """``rotations`` with ``deviation``: degrees from their key's mean."""
    m = means.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in QUATERNION])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in QUATERNION), F.lit(0.0)))
    turn = angle_between([F.col(c) / size for c in QUATERNION], [F.col(f"__{c}") for c in QUATERNION])
    return rotations.join(m, same).withColumn("deviation", turn).drop(*m.columns)


def calibrate(observed: DataFrame, run: str, order: str, prefix: int) -> DataFrame:
    """(run, fitted, qw .. qz, accepted, later, fraction, worst, height_span, lateral_span): each run's mean orientation over its first ``prefix`` scans that were
    observed, frozen, and how far the observed scans after it turn from that.

    ``observed``: ``observe``'s columns with run and order. A run's prefix is the scans up to its ``prefix``-th observed one.
    """
    ok = F.col("state") == "observed"
    o = written(observed, "observed").withColumn("__seen", F.count_if(ok).over(W.partitionBy(run).orderBy(order)))
    o = written(with_quaternion(o, [F.col(v) for v in ("forward", "left", "up")]), "oriented")  # a row a scan, read twice
    first = (F.col("__seen") < prefix) | ((F.col("__seen") == prefix) & ok)
    mean = mean_rotations(o.where(first & ok), [run]).withColumnRenamed("n", "fitted")
    late = deviations(o.where(~first), mean, [run])
    told = late.groupBy(run).agg(
        F.count("*").alias("later"), F.count_if(ok).alias("accepted"), F.max(F.when(ok, F.col("deviation"))).alias("worst"),
        *[(F.max(F.when(ok, F.col(c))) - F.min(F.when(ok, F.col(c)))).alias(f"{c}_span") for c in ("height", "lateral")],
    )
    out = mean.join(told, run, "left").withColumns({"later": F.coalesce("later", F.lit(0)), "accepted": F.coalesce("accepted", F.lit(0))})
    return out.withColumn("fraction", F.when(F.col("later") > 0, F.col("accepted") / F.col("later")))
