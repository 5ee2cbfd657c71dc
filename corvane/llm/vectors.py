"""Operators on embeddings: exact top-k search and near-duplicate links.

**Exact top-k** by distributed histogram selection. Every task scores all its rows against the queries, a block of them after the other,
and counts scores in equal bins of the interval in which each query's k-th best must lie; the summed
histograms give the bin of the k-th value, which becomes the next interval, until few scores are left at or
above it. Then rows below that bin are filtered out, and ties go to the smaller id.
A partition reports bins only down to its own k-th best score, below which the global k-th can't lie.

**Near-duplicate links** by int8 tile products. Unit vectors are quantised to int8 with a scale each; the length
of what quantisation lost bounds the error of every product rigorously (|u·v - ũ·ṽ| <= e_u + e_v + e_u e_v).
Vectors are dealt to cells around pivots, and cells that can't hold a link by the triangle inequality
of angles are never paired; the others meet tile by tile. A block of vectors is quantised once and travels to its tiles as int8, scales and errors;
pairs that the bounds put above the threshold are links, and those that int8 can't decide are recomputed in double precision, for which
only their vectors travel. A tile gives a count and a local root for each vector.

Defined results: vectors that are null, or hold null or non-finite components, take no part in a search and have no
links, nor have zero vectors; vectors of different lengths never meet. A search's scores are exact; a sum beyond 64 bits is held at their
limit. Rows without an id are left out of a search. An id that repeats is one query (its least vector), and its rows are no candidates of its own.
For links every row is a vector of its own, whatever its id: rows that share an id have their own links and component. A component is named by
its smallest id; rows without an id are linked as others are, name no component (null if there is no id in it), and are kept only there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, union_all, with_broadcast
from .components import connected_components

#: Queries and rows that are scored at a time; bytes of queries that travel with the tasks of a job.
QUERY_BLOCK, ROW_BLOCK, QUERY_BYTES = 512, 4096, 1 << 25
BINS = 1024
#: Rows of a tile's side.
TILE = 2048
#: Pivots at most.
PIVOTS = 1024


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of a batch's whole vectors, for each length."""
    col = batch.column("v")
    lens = np.asarray(col.value_lengths().fill_null(-1))
    ends = np.asarray(col.offsets)
    flat = np.asarray(col.values.cast(pa.float64()).fill_null(np.nan), np.float64)
    for d in np.unique(lens[lens > 0]):
        rows = np.flatnonzero(lens == d)
        x = flat[ends[rows][:, None] + np.arange(d)]
        ok = np.isfinite(x).all(1)
        if ok.any():
            yield rows[ok], x[ok]


def _array_column(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


# --- exact top-k -----------------------------------------------------------------------------------------------------


def whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, d, v binary): the components of every whole vector with an id, as little-endian doubles."""

    def run(batches):
        for b in batches:
            ids = b.column("id")
            for rows, x in _vectors(b):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())], ["id", "d", "v"])

    return _array_column(df, id_col, vec_col).where("id is not null").mapInArrow(run, "id long, d int, v binary")


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers, which have no largest."""
    big = np.abs(x) >= 2.0**52
    out = np.empty(x.shape, object)
    out[big] = [int(v) * scale for v in x[big].tolist()]
    out[~big] = [int(v) for v in np.floor(x[~big] * scale).tolist()]
    return out


def scores(q: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of floor(scale * component) as 64-bit integers: in doubles wherever every sum stays below 2**53, else in Python's
    integers; only a sum beyond 64 bits is held at their limit."""
    with np.errstate(over="ignore"):
        fq, fx = np.floor(q * scale), np.floor(x * scale)
    most_q, most_x = np.abs(fq).max(1, initial=0), np.abs(fx).max(1, initial=0)
    if most_q.max(initial=0) * most_x.max(initial=0) * q.shape[1] < 2**53:
        return (fq @ fx.T).astype(np.int64)
    large = most_q[:, None] * most_x[None, :] * q.shape[1] >= 2**53
    rows, cols = np.flatnonzero(large.any(1)), np.flatnonzero(large.any(0))
    small_q, small_x = np.where(most_q[:, None] < 2**53, fq, 0), np.where(most_x[:, None] < 2**53, fx, 0)
    out = np.where(large, 0, small_q @ small_x.T).astype(np.int64)
    big = _integers(q[rows], scale) @ _integers(x[cols], scale).T
    out[np.ix_(rows, cols)] = np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)
    return out


_SIGN = np.uint64(1 << 63)


def _scored(batches, ids: np.ndarray, q: np.ndarray, scale: int):
    """For each block of queries: its place, and (candidates' ids, keys[query, candidate], mask of the queries' own rows) of each block of
    this task's rows. Keys are scores as unsigned integers of the same order."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    cand = np.concatenate([np.asarray(b.column("id")) for b in got])
    x = np.frombuffer(b"".join(v.as_py() for b in got for v in b.column("v")), "<f8").reshape(len(cand), -1)

    def rows(block: slice):
        for at in range(0, len(cand), ROW_BLOCK):
            c = cand[at : at + ROW_BLOCK]
            yield c, scores(q[block], x[at : at + ROW_BLOCK], scale).view(np.uint64) ^ _SIGN, c[None, :] == ids[block][:, None]

    for s in range(0, len(ids), QUERY_BLOCK):
        yield s, rows(slice(s, s + QUERY_BLOCK))


def exact_topk(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by integer inner product. ``is_query`` is on column ``id``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    table = scratch.keep(whole_vectors(df, id_col, vec_col), "vectors")
    queries = scratch.keep(table.where(is_query).groupBy("id", "d").agg(F.min("v").alias("v")), "queries")
    found = []
    for d, asked in sorted((r.d, r["count"]) for r in queries.groupBy("d").count().collect()):  # vector lengths, not rows
        at_once = max(1, QUERY_BYTES // (8 * d))
        groups = -(-asked // at_once)
        for group in range(groups):
            of_group = F.pmod(F.xxhash64("id"), F.lit(groups)) == group
            rows = sorted((r.id, r.v) for r in queries.where((F.col("d") == d) & of_group).select("id", "v").collect())  # QUERY_BYTES, about
            if rows:
                ids, q = np.array([i for i, _ in rows]), np.frombuffer(b"".join(v for _, v in rows), "<f8").reshape(len(rows), -1)
                part = _group_topk(table.where(F.col("d") == d), ids, q, k, scale)
                found.append(scratch.keep(part, "best") if groups > 1 else part)
    return union_all(found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _group_topk(table: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, scale: int) -> DataFrame:
    n = len(ids)
    with np.errstate(over="ignore"):
        reach = np.sqrt((np.floor(q * scale) ** 2).sum(1)) * _longest(table, scale)
    reach = [min(int(min(x, 2.0**64) * (1 + 1e-9)) + 1, 2**63 - 1) for x in reach.tolist()]
    # Intervals of keys: a key is a score plus 2**63.
    lo, hi, need = [2**63 - r for r in reach], [2**63 + r for r in reach], np.full(n, k)
    lo = [0 if r == 2**63 - 1 else x for x, r in zip(lo, reach, strict=True)]
    todo = np.arange(n)
    while len(todo):
        width = [max(1, -((lo[t] - hi[t] - 1) // BINS)) for t in todo]
        got = _locate(table, ids[todo], q[todo], np.array([lo[t] for t in todo], np.uint64), np.array([hi[t] for t in todo], np.uint64), np.array(width, np.uint64), need[todo], scale)
        left = []
        for i, w in enumerate(width):
            t = todo[i]
            if i not in got:  # fewer than k candidates: every row is one of the best
                lo[t] = 0
                continue
            b, above, at_least = got[i]
            lo[t], hi[t], need[t] = lo[t] + b * w, min(hi[t], lo[t] + (b + 1) * w - 1), need[t] - above
            if w > 1 and at_least > 4 * k:
                left.append(t)
        todo = np.array(left, np.int64)
    floor = np.array(lo, np.uint64)

    def best(batches):
        for s, rows in _scored(batches, ids, q, scale):
            for cand, u, own in rows:
                ok = (u >= floor[s : s + len(u), None]) & ~own
                for i in np.flatnonzero(ok.any(1)):
                    j = np.flatnonzero(ok[i])
                    j = j[np.lexsort((cand[j], ~u[i, j]))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), ids[s + i])), pa.array(cand[j]), pa.array((u[i, j] ^ _SIGN).view(np.int64))], ["query_id", "vec_id", "score"])

    rows = table.select("id", "v").mapInArrow(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _longest(table: DataFrame, scale: int) -> float:
    """The length of the longest integer vector."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("v").to_pylist()), "<f8").reshape(b.num_rows, -1)
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((np.floor(x * scale) ** 2).sum(1)).max())])], ["n"])

    return table.select("v").mapInArrow(run, "n double").agg(F.max("n")).first()[0] or 0.0


def _locate(table: DataFrame, ids, q, lo, hi, width, need, scale) -> dict[int, tuple[int, int, int]]:
    """For each query: the bin that holds its k-th best, how many scores are in bins above, and in that bin or above."""

    def count(batches):
        for s, rows in _scored(batches, ids, q, scale):
            total = np.zeros((min(QUERY_BLOCK, len(ids) - s), BINS), np.int64)
            for _, u, own in rows:
                for i in range(len(total)):
                    x = u[i][(u[i] >= lo[s + i]) & (u[i] <= hi[s + i]) & ~own[i]]
                    total[i] += np.bincount(((x - lo[s + i]) // width[s + i]).astype(np.int64), minlength=BINS)[:BINS]
            above = total[:, ::-1].cumsum(1)[:, ::-1] - total
            at_q, at_bin = np.nonzero((total > 0) & (above < need[s : s + len(total), None]))
            yield pa.RecordBatch.from_arrays([pa.array(at_q + s, pa.int32()), pa.array(at_bin, pa.int32()), pa.array(total[at_q, at_bin])], ["q", "bin", "n"])

    bins = table.select("id", "v").mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    cum = bins.withColumn("c", F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin"))))
    wanted = F.broadcast(table.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "q int, need long"))
    rows = cum.join(wanted, "q").where((F.col("c") >= F.col("need")) & (F.col("c") - F.col("n") < F.col("need"))).collect()  # a row for each query of the group
    return {r.q: (r.bin, r.c - r.n, r.c) for r in rows}


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("id") % 100 == 0, 10)


ORACLE_TOPK = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


# --- near duplicates -------------------------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one; scaled first, so that squares neither vanish nor overflow."""
    top = np.abs(x).max(1)
    ok = top > 0
    y = x / np.where(ok, top, 1)[:, None]
    n = np.sqrt((y * y).sum(1))
    return y / np.where(ok, n, 1)[:, None], ok


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 matrix, scales, and a bound for the length of what each row lost."""
    s = np.maximum(np.abs(u).max(1), 1e-300) / 127
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - q * s[:, None]) ** 2).sum(1)) * (1 + 1e-12) + 1e-15
    return q.astype(np.int8), s, e


def tile_links(u: tuple, v: tuple, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of two quantised sides (int8 matrix, scales, errors) that may reach the threshold, and which do for certain; i < j if
    both sides are the same."""
    (qu, su, eu), (qv, sv, ev) = u, v
    # Sums of int8 products are whole numbers; up to 2**24 single precision holds them exactly, and has the fast product.
    kind = np.float32 if qu.shape[1] * 127 * 127 < 2**24 else np.float64
    product = qu.astype(kind) @ qv.astype(kind).T
    unit, error = su[:, None] * sv[None, :], eu[:, None] + ev[None, :] * (1 + eu[:, None]) + 1e-9
    maybe = product >= (threshold - error) / unit - 1e-6 * threshold / unit
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    return i, j, product[i, j].astype(float) * unit[i, j] >= threshold + error[i, j]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the links i-j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return root


def vector_links(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links are pairs of rows with cosine >= threshold."""
    scratch = Scratch(df.sparkSession, "vectors")

    def units(batches):
        for b in batches:
            ids, n = b.column("id"), b.num_rows
            key, vec = [None] * n, [None] * n
            for rows, x in _vectors(b):
                u, ok = _unit(x)
                for r, a, y in zip(rows[ok], x[ok], u[ok], strict=True):
                    key[r] = hashlib.blake2b((a + 0.0).tobytes(), digest_size=16).digest()
                    vec[r] = y.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(key, pa.binary()), pa.array(vec, pa.binary())], ["id", "key", "u"])

    rows = scratch.keep(_array_column(df, id_col, vec_col).mapInArrow(units, "id long, key binary, u binary"), "units")
    # Equal vectors are one class, so that a group of copies meets the others once. Its number has nothing to do with ids, which may be null or repeat.
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("u").alias("u"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = _links(classes, threshold, scratch)
    n_links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = scratch.keep(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "components")
    info = classes.select("key", "node", "rep", "mult").join(n_links, "node", "left").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    info = scratch.keep(info.select("key", "c", "rep", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n")), "info")
    least = info.groupBy("c").agg(F.min("rep").alias("least"))
    named = scratch.keep(info.join(with_broadcast(least), "c").select(F.col("key").alias("k"), "n", "least"), "named")
    scratch.drop(classes, found, comp, info)
    out = rows.select("id", "key").join(with_broadcast(named), F.col("key") == F.col("k"), "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component.isNull() | F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"))


def _cells(classes: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Pivots: for each vector length a hash sample of its vectors, at most PIVOTS."""
    cells: list[tuple[int, np.ndarray]] = []
    lengths = {r.d: r["count"] for r in classes.groupBy((F.length("u") / 8).cast("int").alias("d")).count().collect()}  # vector lengths, not rows
    for d, n in sorted(lengths.items()):
        want = min(PIVOTS, max(1, n // TILE))
        drawn = hash_sample(classes.where(F.length("u") == 8 * d).select("key", "u"), "key", 2 * want + 8, n).orderBy("key").limit(want).collect()
        cells += [(d, np.frombuffer(r.u, "<f8")) for r in drawn]
    return cells


_BLOCK = "block long, d int, node binary, mult binary, q binary, s binary, e binary"


def _pack_block(t: pa.Table) -> pa.Table:
    """One row that holds a block of vectors, quantised once."""
    t = t.sort_by("node")
    u = np.frombuffer(b"".join(t.column("u").to_pylist()), "<f8").reshape(t.num_rows, -1)
    q, s, e = quantise(u)
    held = {"block": t.column("block")[:1], "d": pa.array([u.shape[1]], pa.int32())}
    return pa.table(held | {n: pa.array([x.tobytes()], pa.binary()) for n, x in (("node", np.asarray(t.column("node"))), ("mult", np.asarray(t.column("mult"))), ("q", q), ("s", s), ("e", e))})


def _links_of(a: np.ndarray, b: np.ndarray, node: np.ndarray, mult: np.ndarray) -> pa.Table:
    """(node, links, root) of the nodes that places a and b of ``node`` (sorted) link."""
    links = np.bincount(a, mult[b], len(node)) + np.bincount(b, mult[a], len(node))
    root = node[local_roots(len(node), a, b)]
    at = np.flatnonzero(links > 0)
    return pa.table({"node": node[at], "links": links[at].astype(np.int64), "root": root[at]})


def _links(classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links, root) for each tile and each of its classes that has links there."""
    spark = classes.sparkSession
    cells = _cells(classes)
    if not cells:
        return classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    dims, by = np.array([d for d, _ in cells]), {}
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        by[int(d)] = at, np.stack([cells[i][1] for i in at])

    def deal(batches):
        for b in batches:
            us = b.column("u").to_pylist()
            cell, angle = np.zeros(len(us), np.int32), np.zeros(len(us))
            sizes = np.array([len(u) // 8 for u in us])
            for d in np.unique(sizes):
                at, pivots = by[int(d)]
                r = np.flatnonzero(sizes == d)
                cos = np.frombuffer(b"".join(us[i] for i in r), "<f8").reshape(len(r), -1) @ pivots.T
                best = cos.argmax(1)
                cell[r], angle[r] = at[best], np.arccos(np.clip(cos[np.arange(len(r)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "mult", "u")), pa.array(cell), pa.array(angle)], ["node", "mult", "u", "cell", "angle"])

    dealt = scratch.keep(classes.select("node", "mult", "u").mapInArrow(deal, "node long, mult long, u binary, cell int, angle double"), "dealt")
    held = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # at most PIVOTS rows for each length
    parts = np.array([-(-held[c].n // TILE) if c in held else 0 for c in range(len(cells))])
    first = np.concatenate([[0], parts.cumsum()])[:-1]
    radius = np.array([held[c].radius if c in held else 0.0 for c in range(len(cells))])
    near = []
    for at, pivots in by.values():
        gap = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) - radius[at][:, None] - radius[at][None, :]
        i, j = np.nonzero((gap <= np.arccos(threshold) + 1e-6) & (parts[at][:, None] > 0) & (parts[at][None, :] > 0))
        near.append(np.stack([at[i], at[j]])[:, i <= j])
    near = np.concatenate(near, 1)

    # Blocks of a cell are numbered from first[cell] on; a block's vectors are a hash slice of the cell's.
    sides = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(cells)) if parts[c]], "cell int, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("parts"))
    blocks = dealt.join(F.broadcast(sides), "cell").select(block.alias("block"), "node", "mult", "u").groupBy("block").applyInArrow(_pack_block, _BLOCK)
    blocks = scratch.keep(blocks, "blocks")
    run = lambda c: F.explode(F.sequence(F.lit(0).cast("long") + F.col(f"first_{c}"), F.col(f"first_{c}") + F.col(f"parts_{c}") - 1))
    told = spark.createDataFrame(list(zip(*near.tolist(), *(x.tolist() for x in (first[near[0]], parts[near[0]], first[near[1]], parts[near[1]])), strict=True)), "ca int, cb int, first_a long, parts_a long, first_b long, parts_b long")
    tiles = told.select("first_b", "parts_b", run("a").alias("x")).select("x", run("b").alias("y")).where("x <= y")
    tiles = tiles.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("block").to_pylist()
        read = lambda r, c, kind: np.frombuffer(r[c], kind)
        one = lambda r: (read(r, "q", np.int8).reshape(-1, r["d"]), read(r, "s", float), read(r, "e", float))
        a, b = t[0], t[-1]
        i, j, sure = tile_links(one(a), one(b), threshold, len(t) == 1)
        i, j = read(a, "node", np.int64)[i], read(b, "node", np.int64)[j]
        node = np.concatenate([read(r, "node", np.int64) for r in t])
        mult = np.concatenate([read(r, "mult", np.int64) for r in t])
        order = np.argsort(node)
        node, mult = node[order], mult[order]
        out = _links_of(np.searchsorted(node, i[sure]), np.searchsorted(node, j[sure]), node, mult)
        out = out.append_column("a", pa.nulls(out.num_rows, pa.list_(pa.int64()))).append_column("b", pa.nulls(out.num_rows, pa.list_(pa.int64())))
        if sure.all():
            return out
        left = {"node": [None], "links": [None], "root": [None], "a": [i[~sure]], "b": [j[~sure]]}
        return pa.concat_tables([out, pa.table({n: pa.array(x, out.schema.field(n).type) for n, x in left.items()})])

    met = tiles.join(blocks, "block").groupBy("x", "y").applyInArrow(solve, "node long, links long, root long, a array<long>, b array<long>")
    met = scratch.keep(met.withColumn("doubt", F.monotonically_increasing_id()), "met")
    # Pairs that int8 can't decide: their vectors, once for each tile, in double precision.
    doubt = met.where("a is not null").select("doubt", "a", "b")
    wanted = doubt.select(F.col("doubt").alias("of"), F.explode(F.array_union("a", "b")).alias("node"))
    vectors = wanted.join(dealt.select("node", "mult", "u"), "node")

    def decide(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("node")
        node, mult = np.asarray(vectors.column("node")), np.asarray(vectors.column("mult"))
        u = np.frombuffer(b"".join(vectors.column("u").to_pylist()), "<f8").reshape(len(node), -1)
        i, j = (np.searchsorted(node, np.asarray(pairs.column(c).combine_chunks().flatten())) for c in ("a", "b"))
        hit = np.concatenate([np.einsum("ij,ij->i", u[i[k : k + 65536]], u[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)])
        return _links_of(i[hit], j[hit], node, mult)

    decided = doubt.groupBy("doubt").cogroup(vectors.groupBy("of")).applyInArrow(decide, "node long, links long, root long")
    out = scratch.keep(met.where("a is null").select("node", "links", "root").unionByName(decided), "links")
    scratch.drop(dealt, blocks, met)
    return out


def op10_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.9)


ORACLE_LINKS = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
