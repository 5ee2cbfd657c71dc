"""Binary point clouds, label files, result lines, and writers of exchange formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Point field codes and their numpy kinds.
FIELD_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


@dataclass(frozen=True)
class Layout:
    """Fields (name, offset, code) of a packed point, its size, byte order, and the row padding of the message."""

    fields: tuple[tuple[str, int, int], ...]
    step: int
    big_endian: bool = False
    width: int = 0
    row_step: int = 0

    def dtype(self) -> np.dtype:
        order = ">" if self.big_endian else "<"
        return np.dtype({"names": [n for n, _, _ in self.fields], "formats": [order + FIELD_KINDS[c] for _, _, c in self.fields], "offsets": [o for _, o, _ in self.fields], "itemsize": self.step})

    def points(self, blob: bytes) -> np.ndarray:
        if self.width and self.row_step and self.row_step != self.width * self.step:
            blob = b"".join(blob[i : i + self.width * self.step] for i in range(0, len(blob), self.row_step))
        return np.frombuffer(blob, self.dtype(), len(blob) // self.step)


def decode_clouds(messages: DataFrame, layout: Layout, rotation: list[list[float]] | None = None, translation: list[float] | None = None, keep_invalid: bool = False) -> DataFrame:
    """(bag, frame, point_id, source_index, x, y, z, intensity, ring, time) of (bag, frame, data).

    Non-finite points and those at the origin go (unless ``keep_invalid``); attributes that are invalid are null, never dropped
    with their point. ``time`` is normalised to [0, 1] over the scan. Messages stream through Arrow batches; nothing is shuffled.
    """
    r, t = np.eye(3) if rotation is None else np.array(rotation), np.zeros(3) if translation is None else np.array(translation)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b.itertuples():
                p = layout.points(m.data or b"")
                xyz = np.stack([p[c].astype(float) for c in "xyz"], 1)
                ok = np.isfinite(xyz).all(1) & ((xyz * xyz).sum(1) > 1e-6)
                at = np.arange(len(p)) if keep_invalid else np.flatnonzero(ok)
                q = p[at]
                out = pd.DataFrame(xyz[at] @ r.T + t, columns=["x", "y", "z"])
                names = p.dtype.names
                value = q["intensity"].astype(float) if "intensity" in names else np.full(len(q), np.nan)
                out["intensity"] = np.where(np.isfinite(value), value, np.nan)
                ring = q["ring"].astype(float) if "ring" in names else np.full(len(q), np.nan)
                out["ring"] = pd.array(np.where(np.isfinite(ring) & (ring >= 0) & (ring == np.floor(ring)), ring, np.nan), dtype="Float64").astype("Int32")
                stamp = next((n for n in ("timestamp", "time", "t") if n in names), None)
                s = q[stamp].astype(float) if stamp else np.full(len(q), np.nan)
                span = np.nanmax(s) - np.nanmin(s) if len(s) and np.isfinite(s).any() else np.nan
                out["time"] = (s - np.nanmin(s)) / span if span and np.isfinite(span) else s * np.nan
                out.insert(0, "source_index", at.astype("int32"))
                out.insert(0, "point_id", np.arange(len(q)))
                out.insert(0, "frame", m.frame)
                out.insert(0, "bag", m.bag)
                yield out

    return messages.select("bag", "frame", "data").mapInPandas(run, "bag long, frame long, point_id long, source_index int, x double, y double, z double, intensity double, ring int, time double")


def encode_clouds(points: DataFrame, layout: Layout) -> DataFrame:
    """(bag, frame, data): packs each scan's points (bag, frame, point_id and the layout's fields)."""
    names = [n for n, _, _ in layout.fields]

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id")
        a = np.zeros(len(g), layout.dtype())
        for n in names:
            a[n] = g[n].to_numpy()
        return pd.DataFrame([(*key, a.tobytes())], columns=["bag", "frame", "data"])

    return points.select("bag", "frame", "point_id", *names).groupBy("bag", "frame").applyInPandas(pack, "bag long, frame long, data binary")


POSITION = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
LABELS = T.StructType([T.StructField("obj_id", T.StringType()), T.StructField("obj_type", T.StringType()), T.StructField("psr", T.StructType([T.StructField(n, POSITION) for n in ("position", "rotation", "scale")]))])

BOX = T.ArrayType(T.DoubleType())
OBJECT = T.StructType([T.StructField(n, k) for n, k in (
    ("component_id", T.LongType()), ("track_id", T.LongType()), ("bbox_min", BOX), ("bbox_max", BOX), ("distance_m", T.DoubleType()), ("cluster_nearest_x_m", T.DoubleType()),
    ("path_relation", T.StringType()), ("support_voxels", T.IntegerType()), ("confirmed", T.BooleanType()), ("intersection_confirmed", T.BooleanType()), ("evidence_timestamps_s", BOX),
)])
#: One explicit, nullable schema: early-exit rows lack fields, so nothing is inferred.
RESULT = T.StructType([T.StructField(n, k) for n, k in (
    ("bag", T.StringType()), ("frame", T.LongType()), ("measurement_timestamp_ns", T.LongType()), ("timestamp_s", T.DoubleType()), ("status", T.StringType()), ("health", T.StringType()),
    ("health_reasons", T.ArrayType(T.StringType())), ("gap_reset", T.BooleanType()), ("nearest_obstacle_m", T.DoubleType()), ("objects", T.ArrayType(OBJECT)), ("processing_s", T.DoubleType()),
    ("geometry", T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("reason", T.StringType())])), ("motion", T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("reason", T.StringType())])),
)])


def read_results(spark: SparkSession, paths: str | list[str], keys: DataFrame | None = None) -> DataFrame:
    """Result lines (JSONL, gzip or not); timing files are left out; ``keys`` (bag, frame) keeps only rows they name.

    Keys are left to Spark's own choice of join: it broadcasts them while their size allows.
    """
    rows = spark.read.schema(RESULT).json(paths).where(~F.input_file_name().rlike(r"-timing\.jsonl(\.gz)?$"))
    return rows if keys is None else rows.join(keys.select("bag", "frame"), ["bag", "frame"], "left_semi")


def write_results(results: DataFrame, path: str) -> None:
    """Result lines, gzip; existing output is refused."""
    results.write.mode("errorifexists").option("compression", "gzip").json(path)


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, obj_id, obj_type, psr) of label files named by frame; a frame in two files is an error."""
    raw = spark.read.schema(LABELS).option("multiLine", True).json(f"{folder.rstrip('/')}/*.json")
    named = raw.withColumn("file", F.input_file_name()).withColumn("frame", F.regexp_extract("file", r"(\d+)\.json$", 1).cast("long"))
    twice = named.groupBy("frame").agg(F.count_distinct("file").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"frame {twice[0].frame} is labelled in two files")
    return named.drop("file")


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of binary files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def pcd_bytes(xyz: np.ndarray, intensity: np.ndarray) -> bytes:
    """A binary PCD file of float32 x, y, z, intensity."""
    n = len(xyz)
    head = f"VERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + np.c_[xyz, intensity].astype("<f4").tobytes()


def kitti_bytes(xyz: np.ndarray, intensity: np.ndarray) -> bytes:
    return np.c_[xyz, intensity].astype("<f4").tobytes()


def kitti_pose(pose: np.ndarray) -> str:
    """The first three rows of a pose, as one line."""
    return " ".join(f"{v:.9g}" for v in np.asarray(pose, float)[:3].reshape(-1))


def exchange_files(points: DataFrame, kind: str = "pcd") -> DataFrame:
    """(frame, name, content): one file per scan in PCD or KITTI form, built on the executors; the caller writes the rows where it wants."""
    build = {"pcd": pcd_bytes, "kitti": kitti_bytes}[kind]

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id")
        body = build(g[["x", "y", "z"]].to_numpy(float), g["intensity"].fillna(0).to_numpy(float))
        return pd.DataFrame([(key[0], f"{int(key[0]):06d}.{'pcd' if kind == 'pcd' else 'bin'}", body)], columns=["frame", "name", "content"])

    return points.select("frame", "point_id", "x", "y", "z", "intensity").groupBy("frame").applyInPandas(solve, "frame long, name string, content binary")


def header_stamp(prefix: bytes) -> int:
    """Nanoseconds from the first bytes of a serialised message: a 4-byte preamble, then seconds and nanoseconds."""
    sec, nano = struct.unpack_from("<iI", prefix, 4)
    if not 0 <= nano < 1_000_000_000:
        raise ValueError("nanoseconds out of range")
    return sec * 1_000_000_000 + nano
