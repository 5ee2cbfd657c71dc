"""Ordered recordings dealt out by range instead of by key: recurrences and last values that no task needs a whole recording for.

A table is sorted by (keys, order) in ranges, so a long recording lies in many tasks. What a range has to know of those before it is a row:
its neighbour's last row, and one composed map. Ranges are put together from these rows, one for each range, and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: Rows whose maps are composed one after the other before blocks of them are composed.
BLOCK = 32


def compose(m: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running composition of affine maps v -> m v + b: entry i is the map of steps 0 to i. (n, k, k) and (n, k)."""
    n, k = b.shape
    if n <= 1:
        return m, b
    blocks = -(-n // BLOCK)
    mm, bb = np.broadcast_to(np.eye(k), (blocks * BLOCK, k, k)).copy(), np.zeros((blocks * BLOCK, k))
    mm[:n], bb[:n] = m, b
    mm, bb = mm.reshape(blocks, BLOCK, k, k), bb.reshape(blocks, BLOCK, k)
    for i in range(1, BLOCK):  # all blocks at once
        bb[:, i] += np.einsum("nij,nj->ni", mm[:, i], bb[:, i - 1])
        mm[:, i] = mm[:, i] @ mm[:, i - 1]
    if blocks > 1:
        m0, b0 = compose(mm[:, -1], bb[:, -1])
        bb[1:] += np.einsum("ntij,nj->nti", mm[1:], b0[:-1])
        mm[1:] = mm[1:] @ m0[:-1, None]
    return mm.reshape(-1, k, k)[:n], bb.reshape(-1, k)[:n]


def _sorted_ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> DataFrame:
    by = [*keys, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return dealt.sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__place": place})


def _shifted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``__before``: these columns of the row before in the same partition (null in its first row)."""
    kept = len(df.columns)
    out = T.StructType([*df.schema.fields, T.StructField("__before", T.StructType([df.schema[c] for c in columns]))])
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            before = [pa.concat_arrays([pa.nulls(1, b.column(i).type) if last is None else last[j], b.column(i).slice(0, b.num_rows - 1)]) for j, i in enumerate(at)]
            none = pc.equal(pa.array(np.arange(b.num_rows)), -1 if last is not None else 0)
            last = [b.column(i).slice(b.num_rows - 1) for i in at]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.StructArray.from_arrays(before, columns, mask=none)], [f.name for f in out])

    return df.mapInArrow(run, out)


def _joined(keys: list[str], before: Column) -> Column:
    """Whether the row before has the same keys."""
    same = before.isNotNull()
    for k in keys:
        same = same & before[k].eqNullSafe(F.col(k))
    return same


def affine_scan(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable[[Callable[[str], Column]], tuple[list[list[Column | float]], list[Column | float]]], names: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with the columns ``names``: v of each row is m v' + b, v' of the row before it in (keys, order); the first row of a key has v' = 0.

    ``step`` gets a function that names a column of the row before (one of ``columns``, null in a key's first row) and returns the rows of m and
    b. Maps compose per range, ranges compose once, and the results are applied: no task holds a recording, whatever its length. Columns named
    ``__part``, ``__place`` or ``__before`` must not be there; a null in m or b counts as 0.
    """
    k, kept = len(names), df.columns
    for c in ("__part", "__place", "__before"):
        if c in kept:
            raise ValueError(f"the table has a column {c}")
    before = [*dict.fromkeys([*keys, *columns])]
    rows = _shifted(_sorted_ranges(df, keys, order, parts), before)

    def maps(before: Column) -> dict[str, Column]:
        joined = _joined(keys, before)
        m, b = step(lambda c: F.when(joined, before[c]))
        number = lambda x: F.coalesce(x.cast("double") if isinstance(x, Column) else F.lit(float(x)), F.lit(0.0))
        cells = [F.when(joined, number(x)).otherwise(0.0) for line in m for x in line]
        return {"__m": F.array(*cells), "__b": F.array(*[number(x) for x in b])}

    schema = T.StructType([*rows.withColumns(maps(F.col("__before"))).schema.fields])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces each map by its composition with those before it in the range; the first row's is left out (it needs the range before)."""
        m0, b0 = np.eye(k), np.zeros(k)
        for n_batch, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            m = np.asarray(batch.column("__m").flatten(), float).reshape(-1, k, k).copy()
            b = np.asarray(batch.column("__b").flatten(), float).reshape(-1, k).copy()
            if batch.column("__place")[0].as_py() == 0:
                m[0], b[0] = np.eye(k), 0
            b[0] += m[0] @ b0
            m[0] = m[0] @ m0
            m, b = compose(m, b)
            m0, b0 = m[-1], b[-1]
            made = {"__m": pa.array(list(m.reshape(-1, k * k)), pa.list_(pa.float64())), "__b": pa.array(list(b), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([made[f] if f in made else batch.column(f) for f in batch.schema.names], batch.schema.names)

    # The first row's own columns are kept for the join of the ranges; its map is made then.
    rows = written(rows.withColumns(maps(F.col("__before"))).mapInArrow(local, schema), "scan")
    whole = F.struct(*kept, "__before", "__m", "__b")
    edges = rows.groupBy("__part").agg(F.min_by(whole, "__place").alias("first"), F.max_by(whole, "__place").alias("last"))  # a row for each range
    edges = edges.withColumn("__before", F.lag(F.struct(*[F.col(f"last.{c}").alias(c) for c in before])).over(W.orderBy("__part")))
    heads = edges.select("__part", "first.*", "last", F.col("__before").alias("__edge")).drop("__before", "__m", "__b").withColumnRenamed("__edge", "__before")
    heads = heads.withColumns(maps(F.col("__before"))).select("__part", "__before", "__m", "__b", F.col("last.__m").alias("__lm"), F.col("last.__b").alias("__lb"))

    def chain(t: pa.Table) -> pa.Table:
        """v of every range's first row: its map after the range before's."""
        t = t.combine_chunks().sort_by("__part")
        grid = lambda c, *shape: np.asarray(t.column(c).combine_chunks().flatten(), float).reshape(-1, *shape)
        m, b, lm, lb = grid("__m", k, k), grid("__b", k), grid("__lm", k, k), grid("__lb", k)
        head, v = np.zeros((len(b), k)), np.zeros(k)
        for i in range(len(b)):  # ranges, not rows
            head[i] = m[i] @ v + b[i]
            v = lm[i] @ head[i] + lb[i]
        return pa.table([t.column("__part"), pa.array(list(head), pa.list_(pa.float64())), t.column("__before")], ["__part", "__head", "__edge"])

    before_type = schema["__before"].dataType.simpleString()
    heads = heads.groupBy(F.col("__part") * 0).applyInArrow(chain, f"__part int, __head array<double>, __edge {before_type}")
    met = rows.join(heads, "__part")
    value = [F.when(F.col("__place") == 0, F.col("__head")[i]).otherwise(sum((F.col("__m")[i * k + j] * F.col("__head")[j] for j in range(k)), F.col("__b")[i])).alias(n) for i, n in enumerate(names)]
    return met.select(*kept, *value)


def last_seen(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that isn't null in the rows up to and with each, in (keys, order). No task holds a key."""
    kept = df.columns
    rows = written(_sorted_ranges(df.withColumn("__value", value), keys, order, parts), "seen")  # ranges drawn anew needn't be the same
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k"))
    rows = rows.withColumn("__key", key)
    # Of each range, what its last key has seen; a range of that key alone that saw nothing hands on what came before.
    found = F.col("__value").isNotNull()
    edges = rows.groupBy("__part").agg(F.max_by("__key", "__place").alias("key"), F.max_by(F.when(found, F.struct("__key", F.col("__value").alias("v"))), F.when(found, F.col("__place"))).alias("seen"))
    of_key = F.when(F.col("seen.__key").eqNullSafe(F.col("key")), F.col("seen.v"))
    edges = edges.select("__part", F.col("key").alias("__ekey"), of_key.alias("v"))
    by = W.partitionBy("__ekey").orderBy("__part")  # ranges, not rows
    edges = edges.select("__ekey", "__part", F.last("v", True).over(by).alias("__carried"))
    edges = edges.withColumn("__part", F.lead("__part").over(W.orderBy("__part")))
    inside = F.last("__value", True).over(W.partitionBy("__part", "__key").orderBy("__place"))
    rows = rows.withColumn("__inside", inside)
    met = rows.join(edges.where("__part is not null"), (rows["__part"] == edges["__part"]) & rows["__key"].eqNullSafe(edges["__ekey"]), "left")
    return met.select(*[rows[c] for c in kept], F.coalesce("__inside", "__carried").alias(name))
