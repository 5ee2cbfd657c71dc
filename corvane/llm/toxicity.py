"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, under a linear classifier.

Features are presences of hashed character 3- to 5-grams of the lower-cased text, with white space joined to
single blanks. A bounded hash sample of labelled training rows is read on the executors: one pass counts in how many
documents of each class a bucket stands, giving the log-count ratio r; buckets whose ratio isn't
``MIN_Z`` standard errors from zero are left out; a second pass brings the sample's remaining buckets (at most
``SAMPLE_ROWS`` short rows) to the driver, where logistic regression on r-scaled presences is fitted.
Scoring reads each whole text once, without a shuffle; the model is ``2 ** BITS`` numbers.

Defined results: null and empty texts get the score of no feature; without labels of both classes every score is
the smoothed base rate. Repeated label rows count once, toxic if any says so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash_sample, map_batches

BITS = 18
SIZES = (3, 4, 5)
#: Labelled rows that are read for fitting, at most about.
SAMPLE_ROWS = 16_000
MIN_Z = 4.0
#: Characters hashed at a time; pieces overlap, so no n-gram is lost.
PIECE = 1 << 20


def _hashes(text: str):
    """The bucket of every n-gram, in arrays."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, max(1, len(text) - max(SIZES) + 1), PIECE):
        a = np.frombuffer(text[at : at + PIECE + max(SIZES) - 1].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        h = a
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[n - 1 :]
            if n in SIZES and len(h):
                yield ((h ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32)


def buckets(text: str | None, kept: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, of those that ``kept`` marks."""
    parts = [h if kept is None else h[kept[h]] for h in _hashes(text or "")]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most about ``bound`` training rows with a label; the sampled ids are broadcast, so texts aren't shuffled."""
    y = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    y = hash_sample(y, "doc_id", bound)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")


class Model:
    def __init__(self, bias: float, coef: np.ndarray):
        self.bias, self.coef, self.kept = bias, coef, coef != 0

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.coef[buckets(text, self.kept)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, target: str = "toxic") -> Model:
    sample = labelled_sample(docs, labels, target, sample_rows)
    size = 1 << BITS

    def count(batches):
        import pyarrow as pa

        df = np.zeros((2, size), np.int64)
        docs_of = np.zeros(2, np.int64)
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                df[int(y > 0), buckets(text)] += 1
                docs_of[int(y > 0)] += 1
        at = np.flatnonzero(df.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([docs_of[0], *df[0, at]], pa.int64()), pa.array([docs_of[1], *df[1, at]], pa.int64())], ["bucket", "neg", "pos"])

    got = sample.mapInArrow(count, "bucket int, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()
    there = got[got.bucket < 0]
    n, p = (int(there[c].sum()) for c in ("neg", "pos"))
    bias = float(np.log((p + 1) / (n + 1)))
    if not n or not p:
        return Model(bias, np.zeros(size))
    neg, pos = np.zeros(size), np.zeros(size)
    got = got[got.bucket >= 0]
    neg[got.bucket], pos[got.bucket] = got["neg"], got["pos"]
    r = np.log((pos + 1) / (p + 2)) - np.log((neg + 1) / (n + 2))
    r[np.abs(r) < MIN_Z * np.sqrt(1 / (pos + 1) + 1 / (neg + 1))] = 0
    kept = r != 0

    rows = map_batches(sample.select("text", "y"), lambda x: {"y": x["y"], "b": [buckets(t, kept).astype("<i4").tobytes() for t in x["text"]]}, "y int, b binary", rows=500).collect()
    x = [np.frombuffer(row.b, "<i4") for row in rows]
    y = np.array([row.y > 0 for row in rows], float)
    return Model(*_logistic(x, y, r, bias))


def _logistic(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, bias: float, rounds: int = 300, l2: float = 1e-5) -> tuple[float, np.ndarray]:
    """Full-batch AdaGrad on r-scaled presences; the result is in units of plain presences."""
    counts = np.array([len(a) for a in x])
    idx = np.concatenate([*x, np.zeros(1, np.int32)])
    doc = np.repeat(np.arange(len(x)), counts)
    w, g2, gb2 = np.zeros(len(r)), np.full(len(r), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(doc, (w * r)[idx[:-1]], len(x)) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        gw = np.bincount(idx[:-1], g[doc], len(r)) * r / len(x) + l2 * w
        g2 += gw * gw
        w -= 0.05 * gw / np.sqrt(g2)
        gb2 += g.mean() ** 2
        bias -= 0.1 * g.mean() / np.sqrt(gb2)
    return float(bias), w * r


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row, from its text alone."""

    def f(x: dict) -> dict:
        s = [model.score(t) for t in x["text"]]
        return {"doc_id": x["doc_id"], "score": s, "predicted": [int(v >= 0.5) for v in s]}

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(src, f, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, predicted int", rows=500)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
