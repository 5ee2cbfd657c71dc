"""Quality: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. A logistic classifier on the content of the whole text (the mean log-count ratio of its words that stand more in good or in bad documents, ``WORDS``
   of them at most) and a dozen shape statistics (case, marks, separators, repeated words and lines) is fitted on a bounded hash sample of
   labelled rows and gives each document a log likelihood ratio.
2. Grouped aggregation sums the documents' probabilities for each host and for each path of a host. The strength of
   each prior (how many documents it weighs) comes from the data by the method of moments, over all hosts and
   over all paths. A host's posterior shrinks towards the global mean, a path's towards its host's posterior; sites
   with few documents stay near their prior.
3. A document's quality replaces the global prior odds by its path's, shrunk: logit(evidence) + logit(path) -
   logit(global). Its own evidence is taken out of its path's and its host's sums first, so that it counts once.

The aggregates are small against the documents and are joined back by key without texts; a side that was counted and is
small is broadcast, otherwise Spark splits skewed partitions of the join.

Defined results: null or empty text has evidence 0 and isn't kept; null hosts and paths are groups of their own;
without labels of both classes the evidence is the smoothed base rate. Repeated label rows count once (the
highest label). An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, filter_rows, free_names, map_batches, with_broadcast
from .toxicity import labelled_sample

#: Labelled rows that are read for fitting, at most about.
SAMPLE_ROWS = 8_000
#: A document is kept from this quality on.
KEEP_FROM = 0.5
#: Bounds for the weight of a prior, in documents.
STRENGTH = (1.0, 1_000.0)
_RUNS = re.compile(r"[^\w\s]{2,}")
FEATURES = 13
#: Words whose class ratio is content evidence, at most; standard errors that a ratio must be from zero.
WORDS, MIN_Z = 20_000, 4.0


def features(text: str | None, ratio: dict[str, float]) -> np.ndarray:
    """Content and shape of a whole text; zeros for an empty one."""
    out = np.zeros(FEATURES)
    words = (text or "").split()
    if not words:
        return out
    n, k = len(text), len(words)
    by = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = by.sum()
    upper, lower = by[65:91].sum(), by[97:123].sum()
    kinds = set(words)
    distinct = len(kinds)
    told = [ratio[w] for w in kinds if w in ratio]
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    marks = size - upper - lower - by[48:58].sum() - by[128:].sum() - by[[32, 9, 10, 11, 12, 13]].sum()
    full_stops = by[46] + by[33] + by[63]
    out[:] = (
        upper / max(1, upper + lower), marks / size, by[124] / k, by[33] / k, (by[[35, 36, 37, 38, 42]].sum()) / k, by[48:58].sum() / size,
        repeats / k, distinct / k, 1 - len(set(lines)) / max(1, len(lines)), min(n / k, 40) / 10, len(_RUNS.findall(text)) / k, full_stops / k, sum(told) / max(1, len(told)),
    )
    return out


class Evidence:
    """Logistic regression on standardised features; ``ratio`` are the log-count ratios of words."""

    def __init__(self, ratio: dict[str, float], mean: np.ndarray, scale: np.ndarray, w: np.ndarray, bias: float):
        self.ratio, self.mean, self.scale, self.w, self.bias = ratio, mean, scale, w, bias

    def prob(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.ratio) for t in texts]).reshape(-1, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -20, 20) @ self.w + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_ratios(sample: DataFrame) -> dict[str, float]:
    """The log-count ratios of the words whose ratio is the surest, from (text, y): in how many documents of each class a word stands."""

    def count(batches):
        n: dict[str, list[int]] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], ["word", "neg", "pos"])
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                for w in {*(text or "").split(), ""}:  # the empty word counts the documents
                    n.setdefault(w, [0, 0])[int(y > 0)] += 1
            if len(n) > 200_000:
                yield out()
                n.clear()
        yield out()

    words = sample.select("text", "y").mapInArrow(count, "word string, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    scratch = Scratch(sample.sparkSession, "words")
    words = scratch.keep(words, "counts")
    of = words.where("word = ''").first()
    if of is None or not of.neg or not of.pos:
        return {}
    ratio = F.log((F.col("pos") + 1) / (of.pos + 2)) - F.log((F.col("neg") + 1) / (of.neg + 2))
    z = F.abs(F.col("r")) / F.sqrt(1 / (F.col("pos") + 1) + 1 / (F.col("neg") + 1))
    best = words.where("word <> ''").withColumn("r", ratio).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(WORDS)
    out = {r.word: r.r for r in best.select("word", "r").collect()}  # WORDS rows at most
    scratch.clear()
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, target: str = "quality") -> Evidence:
    """The model of the labelled rows, ``sample_rows`` at most. Weights are fitted to features whose word ratios come from the other half of the rows (equal
    texts stand in one half), so that the ratios' weight isn't learnt from labels that they have seen; the model's own ratios come from all rows. Where a
    half has no rows of one class, nothing can be learnt on it, and the weights are fitted to the model's own ratios."""
    scratch = Scratch(docs.sparkSession, "labelled")
    sample = scratch.keep(labelled_sample(docs, labels, target, sample_rows).select("text", "y"), "sample")  # read once for each half and once for all
    half, rows = F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)), []
    ratio = word_ratios(sample)
    there = [(r.half, r.good) for r in sample.select(half.alias("half"), (F.col("y") > 0).alias("good")).distinct().collect()]
    for k in (0, 1):
        seen = word_ratios(sample.where(half != k)) if len(there) == 4 else ratio
        rows += map_batches(sample.where(half == k), lambda x, seen=seen: {"y": x["y"], "x": [features(t, seen).tolist() for t in x["text"]]}, "y int, x array<double>", rows=500).collect()
    scratch.clear()
    x = np.array([r.x for r in rows]).reshape(-1, FEATURES)
    y = np.array([r.y > 0 for r in rows], float)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    flat = Evidence({}, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), bias)
    if not 0 < y.sum() < len(y):
        return flat
    m, s = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.clip((x - m) / s, -20, 20), np.ones(len(x))]
    w = np.r_[np.zeros(FEATURES), bias]
    ridge = np.diag(np.r_[np.full(FEATURES, 1.0), 1e-6])
    for _ in range(40):  # damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, grad)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
    return Evidence(ratio, m, s, w[:-1], float(w[-1]))


def evidence(docs: DataFrame, model: Evidence, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence): one pass over the texts, no shuffle."""

    def f(x: dict) -> dict:
        p = model.prob(x["text"])
        return x | {"evidence": [float(v) if t and not t.isspace() else 0.0 for v, t in zip(p, x["text"], strict=True)]}

    src = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return map_batches(src, f, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, host string, path string, evidence double", rows=500)


def _strength(groups: DataFrame, mean: float) -> float:
    """Method of moments for a beta prior: from the variance of group means beyond that within groups."""
    r = groups.where("n >= 2").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
    ).first()
    if not r.n or r.k < 2 or not 0 < mean < 1:
        return STRENGTH[1]
    within = r.within / max(1, r.n - r.k)
    between = max(0.0, (r.between - (r.k - 1) * within) / r.n)
    return float(min(max(mean * (1 - mean) / between - 1 if between > 1e-12 else STRENGTH[1], STRENGTH[0]), STRENGTH[1]))


class Sites:
    """What grouped aggregation says of hosts and paths: ``table`` (host, path, n, s, host_n, host_s), documents and sums of evidence; the
    global mean; and the strengths of the priors."""

    def __init__(self, scored: DataFrame):
        paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q"))
        paths = Scratch(scored.sparkSession, "sites").keep(paths, "paths")  # read several times below
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        self.mean = float(min(max(total.s / total.n, 1e-3), 1 - 1e-3)) if total.n else 0.5
        self.at_host, self.at_path = _strength(hosts, self.mean), _strength(paths, self.mean)
        hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
        self.table = paths.join(with_broadcast(hosts), F.col("host").eqNullSafe(F.col("h"))).drop("h", "q")

    def posteriors(self, own: Column | float = 0.0, rows: int = 0) -> tuple[Column, Column]:
        """Of the table's columns: host and path posterior, without ``rows`` documents of evidence ``own``."""
        own = own if isinstance(own, Column) else F.lit(own)
        host = (F.col("host_s") - own + self.at_host * self.mean) / (F.col("host_n") - rows + self.at_host)
        return host, (F.col("s") - own + self.at_path * host) / (F.col("n") - rows + self.at_path)


def _logit(c: Column) -> Column:
    p = F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def combine(scored: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, quality, kept) of scored documents; posteriors are without the document's own evidence."""
    sites = Sites(scored)
    side = with_broadcast(sites.table.withColumnsRenamed({"host": "h", "path": "p"}))
    joined = scored.join(side, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left").drop("h", "p")
    host, path = sites.posteriors(F.col("evidence"), 1)
    joined = joined.withColumns({"host_posterior": host, "path_posterior": path})
    z = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(sites.mean))
    q = F.when(F.col("evidence") <= 0, 0.0).otherwise(1 / (1 + F.exp(-z)))
    return joined.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", q.alias("quality"), (q >= keep_from).alias("kept"))


def source_sites() -> tuple[Column, Column]:
    """Host and path where a table has only a source and a language: the source, and the language within it."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of at least this quality, all columns as they are. Texts are read twice and never shuffled while there are
    few sites: once for the sites' posteriors, once for the decision."""
    model = fit(docs, labels)
    host, path = source_sites()
    sites = Sites(evidence(docs, model, host, path))
    told = ["host", "path", "n", "s", "host_n", "host_s"]
    h, p, *counts = names = free_names(docs, *told)
    joined = docs.join(with_broadcast(sites.table.select(*[F.col(c).alias(n) for c, n in zip(told, names, strict=True)])), host.cast("string").eqNullSafe(F.col(h)) & path.cast("string").eqNullSafe(F.col(p)), "left")
    cut, mean, at_host, at_path = float(np.log(keep_from / (1 - keep_from))), sites.mean, sites.at_host, sites.at_path
    logit = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))

    def f(texts: list, *site: list) -> list[bool]:
        e = np.array([v if t and not t.isspace() else 0.0 for v, t in zip(model.prob(texts), texts, strict=True)])
        n, s, host_n, host_s = (np.array([x or 0 for x in c], float) for c in site)
        of_host = (host_s - e + at_host * mean) / (host_n - 1 + at_host)
        of_path = (s - e + at_path * of_host) / (n - 1 + at_path)
        return [bool(k) for k in (logit(e) + logit(of_path) - logit(mean) >= cut) & (e > 0)]

    return filter_rows(joined, ["text", *counts], f, rows=200).select(*docs.columns)


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, model: Evidence | None = None) -> DataFrame:
    """Quality of every row. Hosts are ``source`` and paths are languages of a source unless columns are given."""
    model = model or fit(docs, labels)
    by_source = source_sites()
    host, path = by_source[0] if host is None else host, by_source[1] if path is None else path
    scored = Scratch(docs.sparkSession, "quality").keep(evidence(docs, model, host, path), "evidence")
    return combine(scored)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
