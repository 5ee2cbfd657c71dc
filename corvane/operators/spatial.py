"""Per-scan spatial operators: filters, voxels, bins, strips, and joins by distance on a grid.

Everything is keyed by frame, never by recording: frames are many and of like size, so partitions are even.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import cell, finite, norm
from .assign import union_find
from .scans import nearest_first, search, solve_graphs

XYZ = ("x", "y", "z")


def radial_band(points: DataFrame, lo: float, hi: float, closed: bool = True) -> DataFrame:
    """Returns whose range lies in [lo, hi] or (lo, hi); non-finite points fail."""
    r = norm(*map(F.col, XYZ))
    inside = (r >= lo) & (r <= hi) if closed else (r > lo) & (r < hi)
    return points.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")) & inside)


def crop(points: DataFrame, min_forward: float, half_width: float) -> DataFrame:
    return points.where((F.col("x") >= min_forward) & (F.abs("y") < half_width))


def usable(points: DataFrame) -> DataFrame:
    """Finite points away from the origin (squared norm above 1e-6)."""
    return points.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")) & (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") > 1e-6))


def in_box(lo: tuple[float, ...], hi: tuple[float, ...]) -> Column:
    ok = F.lit(True)
    for c, a, b in zip(XYZ, lo, hi, strict=True):
        ok = ok & F.col(c).between(a, b)
    return ok


def voxel_first(points: DataFrame, size: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The first point of each voxel in the order of ``point_id``, numbered by voxel key from 1 (``reduced_id``).

    One shuffle on (keys, voxel) with map-side minima, then one on keys for the numbering.
    """
    cells = [cell(c, size).alias(f"k{c}") for c in XYZ]
    rest = [c for c in points.columns if c not in (*keys, "point_id")]
    first = points.groupBy(*keys, *cells).agg(F.min_by(F.struct("point_id", *rest), "point_id").alias("p"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("kx", "ky", "kz"))
    return first.select(*keys, number.cast("long").alias("reduced_id"), "kx", "ky", "kz", "p.*")


def voxel_count(points: DataFrame, size: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Distinct voxels per group, exactly. Two-step: distinct cells first, so the count needs no wide state."""
    cells = points.select(*keys, *[cell(c, size).alias(f"k{c}") for c in XYZ]).distinct()
    return cells.groupBy(*keys).agg(F.count("*").alias("voxels"))


def voxel_centroid(points: DataFrame, size: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    return points.groupBy(*keys, *[cell(c, size).alias(f"k{c}") for c in XYZ]).agg(
        F.count("*").alias("n"), *[(F.round(F.avg(c), 11) + 0.0).alias(f"mean_{c}") for c in XYZ]
    )


def range_bins(points: DataFrame, edges: list[float], supported: Column, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Counts of returns and of supported returns in each [lo, hi) of x; empty bins appear with zeros."""
    at = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        at = F.when((F.col("x") >= edges[i]) & (F.col("x") < edges[i + 1]), i).otherwise(at)
    counted = points.withColumn("bin", at).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("returns"), F.count_if(supported).alias("supported"))
    frames = points.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))))
    return frames.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("returns", F.lit(0)).alias("returns"), F.coalesce("supported", F.lit(0)).alias("supported"))


def support_strips(points: DataFrame, width: float, least: int, span: float, across: str = "y", keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Strips along x with at least ``least`` returns that span at least ``span`` across; their bounds."""
    return (
        points.groupBy(*keys, cell("x", width).alias("strip"))
        .agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in XYZ for f in (F.min, F.max)])
        .where((F.col("n") >= least) & (F.col(f"max_{across}") - F.col(f"min_{across}") >= span))
    )


def cell_support(points: DataFrame, size: float, station: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """For each cross-section cell (y, z): how many stations along x it spans and how many returns it holds."""
    s = cell("x", station)
    return points.groupBy(*keys, cell("y", size).alias("col"), cell("z", size).alias("row")).agg((F.max(s) - F.min(s)).alias("span"), F.count("*").alias("returns"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Equal bins; the last one is closed on the right."""
    width = (hi - lo) / bins
    at = F.when(F.col(value) == hi, bins - 1).otherwise(F.floor((F.col(value) - lo) / width)).cast("int")
    return df.where(F.col(value).between(lo, hi)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def sliding_windows(points: DataFrame, length: float, stride: float) -> DataFrame:
    """Each point once for every window [w * stride, w * stride + length) of x that holds it: an explode, not a range join."""
    first = F.floor((F.col("x") - length) / stride) + 1
    return points.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("x") / stride)))).where((F.col("x") >= F.col("window") * stride) & (F.col("x") < F.col("window") * stride + length))


def nearest_return(points: DataFrame, angle_cells: Column) -> DataFrame:
    """The least range in each direction cell, given back to every return of the cell."""
    r = norm(*map(F.col, XYZ))
    return points.withColumn("dir", angle_cells).withColumn("range", r).withColumn("nearest", F.min("range").over(W.partitionBy("frame", "dir")))


# --- joins by distance -----------------------------------------------------------------------------------------------


def neighbour_pairs(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = ("frame",), axes: tuple[str, ...] = XYZ, once: bool = False) -> DataFrame:
    """Pairs (left a_*, right b_*) with squared distance <= radius² as column ``d2``.

    Each scan's points meet in one task, on a grid; they aren't copied to neighbouring cells. With ``once`` (both sides the same points) each unordered pair comes
    once, either way round.
    """
    names = [[c for c in df.columns if c not in keys] for df in (left, right)]
    schema = T.StructType([*(left.schema[k] for k in keys), *(T.StructField(f"{s}_{c}", df.schema[c].dataType) for s, df, cs in zip("ab", (left, right), names, strict=True) for c in cs), T.StructField("d2", T.DoubleType())])

    def solve(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> pa.Table:
        a, b = a.take(pa.array(i)), b.take(pa.array(j))
        return pa.table([*a.select([*keys, *names[0]]).columns, *b.select(names[1]).columns, pa.array(d2)], schema.names)

    return search(left, left if once else right, radius, keys, axes, solve, schema, once)


def mutual_radius_edges(points: DataFrame, max_radius: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Edges (src < dst) with d² <= min(r_i, r_j)², where each point carries its own ``radius`` <= max_radius."""
    side = points.select(*keys, "point_id", *XYZ, "radius")
    r = F.least("a_radius", "b_radius")
    return neighbour_pairs(side, side, max_radius, keys, once=True).where(F.col("d2") <= r * r).select(*keys, F.least("a_point_id", "b_point_id").alias("src"), F.greatest("a_point_id", "b_point_id").alias("dst"))


def radius_semi(left: DataFrame, targets: DataFrame, radius: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The left points with any target within the radius, once each."""
    return search(left, targets.select(*keys, *XYZ), radius, keys, XYZ, lambda a, b, i, j, d2: a.take(pa.array(np.unique(i))), T.StructType([*(left.schema[k] for k in keys), *(f for f in left.schema if f.name not in keys)])).select(*left.columns)


def nearest(left: DataFrame, right: DataFrame, reach: float, keys: tuple[str, ...] = ("frame",), k: int = 1, others: bool = False) -> DataFrame:
    """The k nearest right points within ``reach`` of each left point, ties to the smaller id; with ``others`` only those of another id. The same table on both
    sides is dealt out once."""
    schema = T.StructType([*(left.schema[c] for c in keys), left.schema["point_id"], T.StructField("rank", T.IntegerType()), T.StructField("nearest_id", right.schema["point_id"].dataType), T.StructField("d2", T.DoubleType())])

    def solve(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> pa.Table:
        ids = np.asarray(b.column("point_id"))
        if others:
            other = np.asarray(a.column("point_id"))[i] != ids[j]
            i, j, d2 = i[other], j[other], d2[other]
        i, j, d2, rank = nearest_first(i, j, d2, ids, k)
        return pa.table([*a.select([*keys, "point_id"]).take(pa.array(i)).columns, pa.array(rank), b.column("point_id").take(pa.array(j)), pa.array(d2)], schema.names)

    side = left.select(*keys, "point_id", *XYZ)
    found = search(side, side if left is right else right.select(*keys, "point_id", *XYZ), reach, keys, XYZ, solve, schema)
    return found.drop("rank") if k == 1 else found


def degrees(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Neighbours of each node, itself included."""
    both = edges.select(*keys, F.col("src").alias("point_id")).unionByName(edges.select(*keys, F.col("dst").alias("point_id")))
    counted = both.groupBy(*keys, "point_id").agg(F.count("*").alias("n"))
    return nodes.select(*keys, "point_id").join(counted, [*keys, "point_id"], "left").select(*keys, "point_id", (F.coalesce("n", F.lit(0)) + 1).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame, key: str = "frame", carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, point_id, carried, label): components of each frame's graph, numbered from 0 by their smallest node; nodes keep their columns ``carried``.

    A frame's graph is bounded (one scan), so the graphs of many are solved whole in one union-find.
    """
    schema = T.StructType([T.StructField(key, nodes.schema[key].dataType), T.StructField("point_id", T.LongType()), *(nodes.schema[c] for c in carried), T.StructField("label", T.LongType())])

    def solve(n: pa.Table, scan: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pa.Table:
        label = union_find(len(scan), src, dst)
        return n.append_column("label", pa.array(label - label[scan.searchsorted(scan)]))  # a scan's first node has its least label

    return solve_graphs(nodes.select(key, "point_id", *carried), edges, key, solve, schema)


def induced(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The edges both of whose ends are in ``nodes``: two semi-joins."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*keys, F.col("point_id").alias(end)), [*keys, end], "left_semi")
    return edges


def structural(points: DataFrame, limit: Column, coarse: float, fine: float, station: float, min_length: float, min_returns: int, gap: float, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Adds ``structural``: returns of the tunnel's own cross-section (y lateral, z height).

    Two conditions: the return's coarse cell is occupied over a span of stations by enough returns, and on the fine grid, thickened by
    one row and by the gap to both sides, the occupied run at its height reaches out past ``limit`` (of column ``row``, the fine row).
    A scan is dealt out once; points stay in their cells until both are decided, so nothing is joined back. Points without a cell or a key aren't structural.
    """
    s = cell("x", station)
    mine = [f"__p{i}" for i in range(len(points.columns))]
    p = points.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(points.columns, mine, strict=True)], *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], s.alias("__s"), cell(F.col("y") + coarse / 2, coarse).alias("sc"), cell(F.col("z") + coarse / 2, coarse).alias("sr"), cell("y", fine).alias("col"), cell("z", fine).alias("row"))
    own = [f"__k{i}" for i in range(len(keys))]
    place = W.partitionBy(*own, "sc", "sr")
    known = F.lit(True)
    for c in (*own, "sc", "sr", "col", "row"):
        known = known & F.col(c).isNotNull()
    supported = known & ((F.max("__s").over(place) - F.min("__s").over(place) + 1) * station >= min_length) & (F.count("*").over(place) >= min_returns)
    # Dealt by scan once: what follows is grouped and ordered within scans.
    p = p.repartition(*own).withColumn("supported", F.coalesce(supported, F.lit(False)))
    k = -int(-(gap / fine) // 1)
    cells = p.groupBy(*own, "col", "row").agg(F.collect_list(F.struct(*mine, "supported")).alias("points"))
    # A cell thickens its own row and those beside it; its points stay with its own.
    shift = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    thick = cells.select("*", shift.alias("shift")).select(*own, "col", (F.col("row") + F.col("shift")).alias("row"), F.when(F.col("shift") == 0, F.col("points")).alias("points"))
    line = W.partitionBy(*own, "row").orderBy("col")
    runs = thick.withColumn("new", F.coalesce(F.col("col") - F.lag("col").over(line) > 2 * k + 1, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    w = W.partitionBy(*own, "row", "run")
    runs = runs.withColumns({"left": F.min("col").over(w) - k, "right": F.max("col").over(w) + k}).where("points is not null")
    reach = F.when(F.col("col") >= 0, (F.col("right") + 1) * fine).otherwise(-F.col("left") * fine)
    out = runs.withColumn("outward", F.coalesce(reach >= limit, F.lit(False))).select("outward", F.explode("points").alias("p"))
    return out.select(*[F.col(f"p.{m}").alias(c) for c, m in zip(points.columns, mine, strict=True)], (F.col("p.supported") & F.col("outward")).alias("structural"))
