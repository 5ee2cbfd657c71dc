"""Run-to-run comparison: keyed full joins, schema-driven deep differences, rounded-key matches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder

TOLERANCE = 1e-10


def presence(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either run and whether each run has them."""
    b = before.select(*keys).distinct().withColumn("in_before", F.lit(True))
    a = after.select(*keys).distinct().withColumn("in_after", F.lit(True))
    both = b.join(a, keys, "full_outer")
    return both.select(*keys, F.coalesce("in_before", F.lit(False)).alias("in_before"), F.coalesce("in_after", F.lit(False)).alias("in_after"))


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Paths of a schema's leaves; arrays and maps are leaves, compared whole."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal, both null, or within ``tolerance`` absolutely or relatively; NaN equals NaN."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance + tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def _same(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return close(a, b, tolerance)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
        return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: close(x, y, tolerance)), lambda ok: ok), a.isNull() & b.isNull())
    return a.eqNullSafe(b)


def deep_difference(before: DataFrame, after: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys, path, old, new) of every leaf that differs between rows of equal key. Floats are compared with tolerance, the rest exactly.

    The comparison is generated from the schema, so it is one join and one projection whatever the nesting.
    """
    parts = leaves(T.StructType([f for f in before.schema.fields if f.name not in keys]))
    rest = [c for c in before.columns if c not in keys]
    joined = before.select(*keys, F.struct(*rest).alias("b")).join(after.select(*keys, F.struct(*rest).alias("a")), keys)
    changes = [F.when(~_same(F.col(f"b.{p}"), F.col(f"a.{p}"), k, tolerance), F.struct(F.lit(p).alias("path"), F.col(f"b.{p}").cast("string").alias("old"), F.col(f"a.{p}").cast("string").alias("new"))) for p, k in parts]
    return joined.select(*keys, F.explode(F.array_compact(F.array(*changes))).alias("c")).select(*keys, "c.*")


def transitions(before: DataFrame, after: DataFrame, keys: list[str], field: str) -> DataFrame:
    """How often each ``old -> new`` occurs for a field, over rows of equal key whose values differ."""
    j = before.select(*keys, F.col(field).alias("old")).join(after.select(*keys, F.col(field).alias("new")), keys)
    return j.where(~F.col("old").eqNullSafe(F.col("new"))).groupBy(F.concat_ws(" -> ", F.coalesce("old", F.lit("null")), F.coalesce("new", F.lit("null"))).alias("change")).agg(F.count("*").alias("n"))


def numbered(run: DataFrame, order: list[str]) -> DataFrame:
    """``run`` with ``line``, its rows' places in order. Lines are numbered within ranges of the order and the ranges' sizes added up, so no
    task holds the whole run."""
    n = run.select(*order, F.struct(*run.columns).alias("row")).repartitionByRange(*order).sortWithinPartitions(*order)
    n = n.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    at = f"{shared_folder(run.sparkSession).rstrip('/')}/lines-{uuid.uuid4().hex}"
    n.write.parquet(at)  # read twice, and ranges drawn anew needn't be the same
    n = run.sparkSession.read.schema(n.schema).parquet(at)
    sizes = n.groupBy("part").agg(F.count("*").alias("size"))  # one row for each range
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("part", before.alias("before")))
    return n.join(sizes, "part").select((F.col("before") + F.col("place") + 1).alias("line"), "row.*")


def positional_merge(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """(line, before, after, same): two runs with lines, zipped line by line; ``same`` says whether the identity columns agree."""
    b = before.select("line", F.struct(*[c for c in before.columns if c != "line"]).alias("before"))
    a = after.select("line", F.struct(*[c for c in after.columns if c != "line"]).alias("after"))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}"))
    return b.join(a, "line", "full_outer").withColumn("same", same)


def violations(rows: DataFrame, rules: dict[str, tuple[Column, int]]) -> DataFrame:
    """(violation, n, allowed) of every rule that more rows break than are allowed: one pass, a row of counts turned into rows."""
    counts = rows.agg(*[F.count_if(broken).alias(name) for name, (broken, _) in rules.items()])
    each = F.array(*[F.struct(F.lit(name).alias("violation"), F.col(name).alias("n"), F.lit(allowed).cast("long").alias("allowed")) for name, (_, allowed) in rules.items()])
    return counts.select(F.explode(each).alias("v")).select("v.*").where("n > allowed")


def rounded_key(values: list[Column], digits: int = 7) -> Column:
    """A join key of coordinates rounded half-even to ``digits`` decimals, as whole numbers."""
    return F.array(*[F.rint(v * 10**digits).cast("long") for v in values])
