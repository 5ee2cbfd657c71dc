"""Segmentation of a scan: range-adaptive density labels as joins and aggregates over the mutual-radius graph."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import norm
from ..sources.shared import shared_folder
from . import spatial as sp
from .assign import shortest_from, union_find


@dataclass(frozen=True)
class DensityParams:
    radius: float
    angular_radius: float
    max_radius: float
    vertical_scale: float
    min_near: float
    min_far: float
    reference_range: float


def density_labels(points: DataFrame, c: DensityParams) -> DataFrame:
    """(frame, point_id, label, core): cores joined over mutual edges, borders given to their nearest core within both radii,
    and what is left labelled by its own components after them.

    Graph, degrees and borders are joins and aggregates; only the labelling of one scan's graph runs in Python.
    """
    r = norm(F.col("x"), F.col("y"), F.col("z"))
    need = F.greatest(F.lit(c.min_far), F.ceil(c.min_near * F.least(F.lit(1.0), F.pow(c.reference_range / F.greatest(r, F.lit(1.0)), 2))))
    p = points.select("frame", "point_id", "x", "y", (F.col("z") * c.vertical_scale).alias("z"), F.least(F.greatest(c.radius + c.angular_radius * r, F.lit(c.radius)), F.lit(c.max_radius)).alias("radius"), need.alias("need"))
    # The graph is read three times (degrees, cores, labels), so it is written once.
    spark = points.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/edges-{uuid.uuid4().hex}"
    graph = sp.mutual_radius_edges(p, c.max_radius)
    graph.write.parquet(at)
    edges = spark.read.schema(graph.schema).parquet(at)
    core = sp.degrees(p, edges).join(p.select("frame", "point_id", "need"), ["frame", "point_id"]).select("frame", "point_id", (F.col("degree") >= F.col("need")).alias("core"))
    sides = p.join(core, ["frame", "point_id"]).select("frame", "point_id", "x", "y", "z", "radius", "core")
    pairs = sp.neighbour_pairs(sides.where("not core").drop("core"), sides.where("core").drop("core"), c.max_radius)
    best = F.min(F.struct("d2", F.col("b_point_id").alias("near"), F.least("a_radius", "b_radius").alias("r"))).alias("m")
    border = pairs.groupBy("frame", F.col("a_point_id").alias("point_id")).agg(best).where("m.d2 <= m.r * m.r").select("frame", "point_id", "m.near")
    nodes = core.join(border, ["frame", "point_id"], "left").select(F.col("frame").alias("g"), "point_id", "core", "near")

    def solve(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("point_id")
        ids, is_core = n["point_id"].to_numpy(), n["core"].to_numpy(bool)
        a, b = ids.searchsorted(e["src"].to_numpy()), ids.searchsorted(e["dst"].to_numpy())
        label = np.full(len(ids), -1, np.int64)

        def components(mask: np.ndarray, base: int) -> int:
            place = np.flatnonzero(mask)
            both = mask[a] & mask[b]
            got = union_find(len(place), place.searchsorted(a[both]), place.searchsorted(b[both]))
            label[place] = base + got
            return base + (int(got.max()) + 1 if len(got) else 0)

        count = components(is_core, 0)
        near = n["near"].to_numpy(float)
        has = ~np.isnan(near)
        label[has] = label[ids.searchsorted(near[has].astype(np.int64))]
        components(label < 0, count)
        return pd.DataFrame({"frame": key[0], "point_id": ids, "label": label, "core": is_core})

    kind = points.schema["frame"].dataType.simpleString()
    right = edges.select(F.col("frame").alias("h"), "src", "dst")
    return nodes.groupBy("g").cogroup(right.groupBy("h")).applyInPandas(solve, f"frame {kind}, point_id long, label long, core boolean")


def nearest_seed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame, point_id, seed, distance): the nearest seed over weighted edges (frame, src, dst, w); ``nodes`` has a flag ``seed``."""

    def solve(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = n["point_id"].sort_values().to_numpy()
        seeds = np.sort(n.loc[n["seed"], "point_id"].to_numpy())
        d, own = shortest_from(len(ids), list(zip(ids.searchsorted(e["src"]).tolist(), ids.searchsorted(e["dst"]).tolist(), e["w"].tolist(), strict=True)), ids.searchsorted(seeds).tolist())
        ok = own >= 0
        return pd.DataFrame({"frame": key[0], "point_id": ids[ok], "seed": ids[own[ok]], "distance": d[ok]})

    left = nodes.select(F.col("frame").alias("g"), "point_id", "seed").groupBy("g")
    return left.cogroup(edges.select(F.col("frame").alias("h"), "src", "dst", "w").groupBy("h")).applyInPandas(solve, "frame long, point_id long, seed long, distance double")
