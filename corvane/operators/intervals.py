"""Records and the intervals that hold them, where both sides may be of any size: no side is broadcast by intent, no key or bin is one task's.

``interval_join`` gives all pairs. Intervals are put into bins of a width that suits their own length (a level for each power of four), so an interval
stands in five bins at most however long it is; a record looks into one bin of each level that intervals have. Bins with many records
are dealt over salts, to which their intervals are copied. ``segment_of`` gives each record the last interval that started, by a sweep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import last_seen

#: Records of a bin and level that go to one salt, about.
SALT_ROWS = 100_000


def interval_join(records: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``records`` (with whole numbers ``at``) joined to the ``intervals`` of equal ``keys`` with start <= at <= end.

    Columns of both sides, which must differ but for ``keys``; records without an interval and intervals that are null or end before
    they start have no rows; records and intervals that repeat give a row for each pair (equal records have one salt; Spark splits a partition that
    stays too large). The keys' nulls match nothing.
    """
    keys = keys or []
    if both := (set(records.columns) & set(intervals.columns)) - set(keys):
        raise ValueError(f"both sides have a column {min(both)}")
    length = F.col(end) - F.col(start)
    level = F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) / 2).cast("int")
    bin_of = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), 2 * __level)")
    wide = intervals.where(F.col(end) >= F.col(start)).withColumn("__level", level)
    wide = wide.withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    levels = [r[0] for r in wide.select("__level").distinct().collect()]  # at most 32, whatever the intervals
    narrow = records.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    narrow = narrow.withColumn("__bin", bin_of(at))
    by = [*keys, "__level", "__bin"]
    hot = narrow.groupBy(*by).count().where(F.col("count") > salt_rows).select(*by, F.ceil(F.col("count") / salt_rows).cast("int").alias("__salts"))
    spread = lambda side: side.join(hot, by, "left").withColumn("__salts", F.coalesce("__salts", F.lit(1)))
    one = spread(narrow).withColumn("__salt", F.pmod(F.xxhash64(*records.columns), F.col("__salts")).cast("int")).drop("__salts")
    all_ = spread(wide).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    met = one.join(all_, [*by, "__salt"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    return met.select(*records.columns, *[c for c in intervals.columns if c not in keys])


def segment_of(records: DataFrame, segments: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``records`` with ``segment``: a struct of the last segment of equal ``keys`` that started at or before ``at`` (null where none did), and
    ``state``: ``inside``, ``before`` (nothing started yet) or ``outside`` (the segment had ended). Of segments that start together the last by end, then by
    the other columns, counts. Both sides are one ordered table, swept range by range."""
    keys = keys or []
    told = F.struct(*[F.col(c) for c in segments.columns])
    left = segments.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(end).alias("e"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(segments.columns)]).alias("__tie"), told.alias("__segment"), F.lit(None).cast(records.select(F.struct("*").alias("r")).schema["r"].dataType).alias("__record"))
    right = records.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(left.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(left.schema["__segment"].dataType).alias("__segment"), F.struct("*").alias("__record"))
    seen = last_seen(left.unionByName(right), keys, ["__at", "__kind", "__tie"], F.col("__segment"), "segment", parts)
    state = F.when(F.col("segment").isNull(), "before").when(F.col(at) <= F.col(f"segment.{end}"), "inside").otherwise("outside")
    return seen.where("__kind = 1").select("__record.*", "segment").withColumn("state", state)
