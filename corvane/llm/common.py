"""What the corpus operators share: shared-folder tables, size-checked joins, workers' caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder

#: A side of a join is broadcast only when it was measured and has at most this many bytes, about.
BROADCAST_BYTES = 64 << 20

#: ASCII white space: what separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
#: A word is a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z and nothing else (for str.translate).
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())


_CACHES: dict[str, Callable[[], None]] = {}
_LAST_CACHE: list[str] = []


def claim_cache(name: str, clear: Callable[[], None]) -> None:
    """Says that an operator is about to fill its cache in this worker. Workers outlive stages, so the caches of
    other operators are emptied first: a worker never holds more than one operator's."""
    if _LAST_CACHE == [name]:
        return
    _CACHES[name] = clear
    for other, f in _CACHES.items():
        if other != name:
            f()
    _LAST_CACHE[:] = [name]
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # freed pages go back to the system
    pa.default_memory_pool().release_unused()


class KeyTable:
    """64-bit keys to their places, looked up for whole arrays: a few open tables, each for the keys that collided in those before."""

    def __init__(self, keys: np.ndarray):
        self.parts = []
        left = np.arange(len(keys))
        while len(left):
            bits = max(8, len(left).bit_length() + 3)
            m = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.parts) * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
            slot = (keys[left] * m) >> np.uint64(64 - bits)
            key, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            key[slot], value[slot] = keys[left], left
            self.parts.append((m, np.uint64(64 - bits), key, value))
            left = left[value[slot] != left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        out = np.full(len(keys), -1, np.int32)
        for m, shift, key, value in self.parts:
            slot = (keys * m) >> shift
            hit = key[slot] == keys
            out[hit] = np.maximum(out[hit], value[slot[hit]])
        return out


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor.

    ``keep`` writes a frame and returns it reread; ``drop`` deletes one that nothing reads any more. Results are read lazily, so an operator
    can't drop what its own result reads: ``clear_since`` deletes that once the result was written elsewhere.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.made.append(self)
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    @classmethod
    def clear_since(cls, n: int) -> None:
        """Deletes the tables of every scratch made after the first ``n``."""
        while len(cls.made) > n:
            cls.made.pop().clear()

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def clear(self) -> None:
        """Deletes every table of this scratch."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def with_broadcast(side: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` with a broadcast hint if its rows take at most ``bound`` bytes, else as it is (a shuffle join)."""
    wide = [F.octet_length(f.name) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.size(f.name) * 32 for f in side.schema if isinstance(f.dataType, T.StringType | T.BinaryType | T.ArrayType)]
    row = F.lit(16 + 8 * len(side.columns)).cast("long")
    for x in wide:
        row = row + F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    return F.broadcast(side) if (side.agg(F.sum(row)).first()[0] or 0) <= bound else side


def crc_mod(col: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null ids count as the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % m


def hash_sample(df: DataFrame, key: str, bound: int, total: int | None = None) -> DataFrame:
    """About ``bound`` rows at most, chosen by the hash of ``key``: the same rows however the table is dealt out."""
    total = df.count() if total is None else total
    if total <= bound:
        return df
    cut = int(bound / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < cut)


def map_batches(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch], schema: str, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows; ``f`` gets and returns columns as lists or arrays."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip((got[n] for n in out.names), out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, inputs: list[str], f: Callable[..., list[bool]], rows: int = 500) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``f`` of the named columns' lists says so. No shuffle."""
    at_input = [df.columns.index(c) for c in inputs]
    fed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = fed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ok = f(*(part.column(i).to_pylist() for i in at_input))
                yield part.filter(pa.array(ok, pa.bool_()))

    return fed.mapInArrow(run, out).toDF(*df.columns)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """These names with as many underscores before them as it takes until ``df`` has none of them, in any case."""
    there, out = {c.lower() for c in df.columns}, [f"__{n}" for n in wanted]
    while there & {n.lower() for n in out}:
        out = [f"_{n}" for n in out]
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)



__all__ = ["ASCII_LOWER", "BROADCAST_BYTES", "KeyTable", "SPACE", "WORD", "Scratch", "claim_cache", "crc_mod", "filter_rows", "free_names", "hash_sample", "map_batches", "union_all", "with_broadcast"]
