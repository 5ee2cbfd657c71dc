"""One stream to several tables, each batch once in each: a commit by batch id over all of them.

``foreachBatch`` may be called again with a batch that was written in part before a failure. A batch is computed once and kept, then written to each table
under a folder of its own number; a folder replaces what an earlier try left there. Readers take only batches that a commit file names, and that
file is written last: they see a batch in all tables or in none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Column of a table's folders: the batch that wrote its rows.
BATCH = "batch_id"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that are whole in every table, ascending."""
    p, fs = _files(spark, f"{root}/_commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def _commit(spark: SparkSession, root: str, batch: int) -> None:
    half, fs = _files(spark, f"{root}/_commits/.{batch}")
    whole, _ = _files(spark, f"{root}/_commits/{batch}")
    fs.create(half, True).close()
    if not fs.rename(half, whole) and not fs.exists(whole):
        raise OSError(f"batch {batch} of {root} couldn't be committed")


def write_batch(batch: DataFrame, number: int, root: str, outputs: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Writes every output of one batch and commits it. A batch that is committed already is left as it is."""
    spark = batch.sparkSession
    if number in committed(spark, root):
        return
    held = batch.persist()  # computed once for all outputs
    try:
        for name, f in outputs.items():
            f(held).write.mode("overwrite").parquet(f"{root}/{name}/{BATCH}={number}")
    finally:
        held.unpersist()
    _commit(spark, root, number)


def fan_out(stream: DataFrame, root: str, checkpoint: str, outputs: dict[str, Callable[[DataFrame], DataFrame]], **trigger) -> StreamingQuery:
    """Starts the stream; ``outputs`` name tables under ``root`` and say what of a batch goes there. Outputs that have state belong into ``stream`` itself."""
    if bad := [n for n in outputs if not n or n.startswith(("_", ".")) or "/" in n]:
        raise ValueError(f"no name for a table: {bad[0]!r}")
    write = lambda batch, number: write_batch(batch, number, root, outputs)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_output(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The committed rows of one table, with the column batch_id. Batches that aren't committed are no input."""
    numbers = committed(spark, root)
    paths = [f"{root}/{name}/{BATCH}={n}" for n in numbers]
    if not paths:
        return spark.createDataFrame([], f"{schema}, {BATCH} long")
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths).withColumn(BATCH, F.col(BATCH).cast("long"))
