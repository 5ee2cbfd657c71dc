"""Windows over ordered scan streams: gaps, episodes, rolling evidence. One shuffle by recording each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import array_median


def ordered(keys: tuple[str, ...] = ("bag",), by: str = "ns") -> W:
    return W.partitionBy(*keys).orderBy(by)


def gap_flags(scans: DataFrame, max_gap_ns: int, keys: tuple[str, ...] = ("bag",)) -> DataFrame:
    """``dt_ns`` to the scan before, whether it is a gap (strictly more than allowed), and whether time went backwards or stood still."""
    dt = F.col("ns") - F.lag("ns").over(ordered(keys))
    return scans.withColumn("dt_ns", dt).withColumns({"gap": F.coalesce(F.col("dt_ns") > max_gap_ns, F.lit(False)), "nonincreasing": F.coalesce(F.col("dt_ns") <= 0, F.lit(False))})


def scan_stream(scans: DataFrame, every: int, max_frames: int, keys: tuple[str, ...] = ("bag",)) -> DataFrame:
    """A recording read in order: equal stamps are dropped, every n-th source index is kept, at most ``max_frames`` come out.

    ``index`` is the source index, so it isn't dense.
    """
    w = ordered(keys)
    numbered = scans.withColumns({"index": F.row_number().over(W.partitionBy(*keys).orderBy("ns", "frame")) - 1, "before": F.lag("ns").over(W.partitionBy(*keys).orderBy("ns", "frame"))})
    kept = numbered.where((F.col("index") % every == 0) & (F.col("before").isNull() | (F.col("before") < F.col("ns"))))
    return kept.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_frames).drop("n", "before")


def islands(scans: DataFrame, changed: Column, keys: tuple[str, ...] = ("bag",), by: str = "ns", name: str = "island") -> DataFrame:
    """Numbers runs: a new one starts where ``changed`` holds."""
    return scans.withColumn("__c", F.when(changed, 1).otherwise(0)).withColumn(name, F.sum("__c").over(ordered(keys, by).rowsBetween(W.unboundedPreceding, 0))).drop("__c")


def status_episodes(scans: DataFrame, keys: tuple[str, ...] = ("bag",)) -> DataFrame:
    """Runs of equal status, not split at acquisition gaps."""
    w = ordered(keys)
    runs = islands(scans, F.lag("status").over(w).isNull() | (F.lag("status").over(w) != F.col("status")), keys)
    return runs.groupBy(*keys, "island", "status").agg(F.count("*").alias("frames"), F.min("ns").alias("start_ns"), F.max("ns").alias("end_ns"))


def alarm_accounting(scans: DataFrame, alarm: Column, max_gap_ns: int, keys: tuple[str, ...] = ("bag",)) -> DataFrame:
    """Alarm episodes split at gaps; time between scans goes to the earlier scan's status, gaps are excluded."""
    w = ordered(keys)
    s = gap_flags(scans.withColumn("alarm", alarm), max_gap_ns, keys)
    begins = F.col("alarm") & (F.col("dt_ns").isNull() | F.col("gap") | ~F.lag("alarm").over(w))
    s = s.withColumns({"begins": begins, "prior_alarm": F.lag("alarm").over(w)})
    return s.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.count_if("alarm").alias("alarm_frames"), F.count_if("begins").alias("alarm_episodes"),
        F.coalesce(F.sum(F.when(~F.col("gap"), F.col("dt_ns"))), F.lit(0)).alias("observed_ns"), F.coalesce(F.sum(F.when(F.col("gap"), F.col("dt_ns"))), F.lit(0)).alias("excluded_ns"),
        F.coalesce(F.sum(F.when(~F.col("gap") & F.col("prior_alarm"), F.col("dt_ns"))), F.lit(0)).alias("alarm_ns"),
    )


def flag_episodes(flags: DataFrame, max_gap_ns: int) -> DataFrame:
    """Episodes of (bag, kind): split where the flag pauses, at acquisition gaps, and where its reason changes.

    ``flags``: (bag, seq, ns, gap, kind, reason); ``seq`` numbers all scans of the recording, so a pause is a jump of it.
    """
    keys = ("bag", "kind")
    w = ordered(keys, "seq")
    starts = F.lag("seq").over(w).isNull() | (F.col("seq") - F.lag("seq").over(w) > 1) | F.col("gap") | (F.lag("reason").over(w) != F.col("reason"))
    return islands(flags, starts, keys, "seq").groupBy(*keys, "island", "reason").agg(F.count("*").alias("frames"), F.min("seq").alias("start"), F.max("seq").alias("end"))


def hits_in_window(scans: DataFrame, hit: Column, number: str, window: int, keys: tuple[str, ...]) -> DataFrame:
    """Hits among the last ``window`` frame numbers, this one included: a range frame, so missing frames count as misses."""
    return scans.withColumn("hits", F.count_if(hit).over(W.partitionBy(*keys).orderBy(number).rangeBetween(-(window - 1), 0)))


def distinct_in_window(scans: DataFrame, value: str, window_ns: int, keys: tuple[str, ...] = ("bag",)) -> DataFrame:
    """Distinct values over the last ``window_ns`` (a value exactly that old still counts).

    A value counts from each of its scans for ``window_ns``; where that overlaps it is one stretch. So the distinct values at a scan are the stretches
    begun less those ended: a running sum, no list of a window's values.
    """
    of_value = W.partitionBy(*keys, value).orderBy("ns")
    counted = F.col(value).isNotNull()
    since, until = F.col("ns") - F.lag("ns").over(of_value), F.lead("ns").over(of_value) - F.col("ns")
    s = scans.withColumn("__begins", F.when(counted & (since.isNull() | (since > window_ns)), 1).otherwise(0)).withColumn("__ends", counted & (until.isNull() | (until > window_ns)))
    here = s.select(F.struct(*scans.columns).alias("row"), *keys, (F.col("ns") * 2).alias("at"), F.col("__begins").alias("step"))
    over = s.where("__ends").select(F.lit(None).cast(here.schema["row"].dataType).alias("row"), *keys, ((F.col("ns") + window_ns) * 2 + 1).alias("at"), F.lit(-1).alias("step"))
    running = here.unionByName(over).withColumn("distinct", F.sum("step").over(W.partitionBy(*keys).orderBy("at")).cast("int"))
    return running.where("row is not null").select("row.*", "distinct")


def rolling_median(scans: DataFrame, value: str, n: int, keys: tuple[str, ...] = ("bag",), by: str = "ns") -> DataFrame:
    return scans.withColumn("median", array_median(F.collect_list(value).over(ordered(keys, by).rowsBetween(-(n - 1), 0))))


def moving_average(scans: DataFrame, value: str, half: int, keys: tuple[str, ...] = ("bag",)) -> DataFrame:
    """Centred mean with zeros beyond both ends: the divisor stays ``2 * half + 1``."""
    return scans.withColumn("mean", F.sum(value).over(ordered(keys).rowsBetween(-half, half)) / (2 * half + 1))
