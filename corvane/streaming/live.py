"""The live path: ordered scans per recording with explicit state.

Lateness tolerance is zero: a scan whose stamp equals the last is dropped, an older one resets the recording's tracks and yields
an ``unknown`` row. Event-time windows and watermarks serve the aggregates; per-recording state is keyed by ``bag``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import COLUMNS, OUT, Tracker, TrackParams, run_scans


def read_events(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The events table as a stream of (bag, frame, ns, status, value)."""
    from ..sources.tables import micros

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", max_files).parquet(sf_dir)
    return raw.select(F.col("user_id").alias("bag"), F.col("event_id").alias("frame"), (micros(raw, "ts") * 1000).alias("ns"), F.col("event_type").alias("status"), "value")


MONITORED = "bag long, frame long, ns long, outcome string, status string, reset string, gap_reset boolean, received long, processed long"


def monitor(scans: DataFrame, max_gap_ns: int, min_returns: float | None = None) -> DataFrame:
    """Each scan's outcome (processed, duplicate, out_of_order), resets and running counters per recording.

    ``reset`` says what cleared the recording's state: a late scan, a gap, or (with ``min_returns``, which needs a column ``returns``) too few
    returns. Late scans and those of too few returns have the status ``unknown``; a late one leaves the acquisition time as it was.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, received, processed = state.get if state.exists else (None, 0, 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values(["ns", "frame"]).itertuples():
            received += 1
            outcome = "processed" if last is None or r.ns > last else "duplicate" if r.ns == last else "out_of_order"
            reset = "late" if outcome == "out_of_order" else None
            if outcome == "processed":
                if min_returns is not None and r.returns < min_returns:
                    reset = "insufficient_returns"
                elif last is not None and r.ns - last > max_gap_ns:
                    reset = "gap"
                last, processed = int(r.ns), processed + 1
            status = "unknown" if reset in ("late", "insufficient_returns") else "seen"
            rows.append((key[0], r.frame, r.ns, outcome, status, reset, reset == "gap", received, processed))
        state.update((last, received, processed))
        yield pd.DataFrame(rows, columns=["bag", "frame", "ns", "outcome", "status", "reset", "gap_reset", "received", "processed"])

    return scans.groupBy("bag").applyInPandasWithState(step, MONITORED, "last long, received long, processed long", "append", GroupStateTimeout.NoTimeout)


def watchdog(scans: DataFrame, silence_ms: int) -> DataFrame:
    """Rows ``seen`` for newer scans and one ``unknown`` when a recording falls silent; the acquisition time is kept through it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], last, "unknown")], columns=["bag", "ns", "status"])
            state.update((last,))  # no new timeout until the next scan
            return
        newest = max(int(f["ns"].max()) for f in frames)
        last = newest if last is None else max(last, newest)
        state.update((last,))
        state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame([(key[0], last, "seen")], columns=["bag", "ns", "status"])

    return scans.groupBy("bag").applyInPandasWithState(step, "bag long, ns long, status string", "ns long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def track_stream(objects: DataFrame, params: TrackParams) -> DataFrame:
    """The batch tracker's step on a stream of objects: the same class, its state carried per recording.

    Scans not newer than the recording's last give no rows, as ``monitor`` reports them; an older one clears the tracks, and ids go on.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(params)
        parts = list(frames)
        g = parts[0] if len(parts) == 1 else pd.concat(parts)
        if tracker.last is not None:
            if (g["ns"] / 1e9 < tracker.last).any():
                tracker.reset()
            g = g[g["ns"] / 1e9 > tracker.last]
        rows = list(run_scans(tracker, int(key[0]), g)) if len(g) else []
        state.update((pickle.dumps(tracker),))
        names = ["bag", "frame", "gap_reset", *COLUMNS]
        yield pd.DataFrame(dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else [], columns=names)

    return objects.groupBy("bag").applyInPandasWithState(step, OUT, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def newest_only(batch: DataFrame) -> DataFrame:
    """The newest scan of each recording in a micro-batch (a queue of depth one)."""
    return batch.groupBy("bag").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "bag"]), "ns").alias("m")).select("bag", "m.*")


def windowed_counts(scans: DataFrame, alarm: Column, length: str, slide: str, lateness: str) -> DataFrame:
    """Scans and alarms per recording and sliding event-time window, with a watermark that bounds the state."""
    ts = scans.withColumn("ts", F.timestamp_micros(F.expr("ns div 1000"))).withWatermark("ts", lateness)
    return ts.groupBy("bag", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(alarm).alias("alarms")).select("bag", F.unix_micros("w.start").alias("start_us"), "n", "alarms")


def run_available(stream: DataFrame, folder: str, mode: str = "append", one_batch: bool = False) -> DataFrame:
    """Runs a stream over what there is now and returns its rows, from tables in the shared ``folder``.

    Processing-time timeouts keep asking for further batches, so streams that use them are run for ``one_batch``.
    """
    spark = stream.sparkSession
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(**({"once": True} if one_batch else {"availableNow": True}))
    w.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
