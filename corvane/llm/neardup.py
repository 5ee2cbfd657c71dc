"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. One pass over the texts gives each document its set of hashed word shingles, a digest of the set and a MinHash
   signature. Documents with equal sets are one class; only its representative goes on.
2. Each class stands in ``TREES`` sorted signature orders. An order is range-partitioned by its full key and id, so a
   region of equal prefixes, however large, is dealt over tasks. Classes with a common prefix of ``DEPTH`` values are
   candidates. Where such a region holds more than ``REGION`` classes, the prefix that counts grows until it
   doesn't, each class keeps its next ``WINDOW`` neighbours with the longest common prefixes, and all meet the region's first.
   A one-bit sketch of the whole signature drops pairs that are far from the threshold.
3. Candidates are confirmed on full shingle sets: first each class with its likeliest partner, then, once
   components are known, every other pair that would join two components. Pairs inside a component change nothing.

4. Over-full regions of several components are closed exactly: classes that share one, directly or over others, are a family. A family's
   classes are split by set size and salted into tiles, and every two tiles whose sizes can match are compared on full sets.

A pair at similarity s stands in no common region with probability (1 - s**DEPTH)**TREES: 3e-8 at 0.8, 1e-10 at 0.85. The sketch, which is the
same in all orders, drops it with no larger a probability; 2e-10 at 0.85 and 6e-8 at 0.8 bound the sum of both. The work of step 4 grows with
the square of a family that isn't linked.

Defined results: texts are lower-cased in A-Z only and split at ASCII white space; with fewer words than a shingle
holds, the whole sequence is the one shingle; without words the set is empty and links with nothing. Rows that
share an id are one node. Rows without an id link with nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, claim_cache, free_names, union_all, with_broadcast
from .components import connected_components, forest_roots, lifted, merged

HASHES = 96
TREES = 24
DEPTH = 3
LEVELS = 8
REGION = 24
WINDOW = 3
#: Classes, and shingles of theirs, that a tile of the exact closing holds, about.
TILE_DOCS, TILE_SHINGLES = 1_024, 1_000_000
#: Rows of the sorted orders that a task gets, about.
ORDER_ROWS = 100_000
MEMO_WORDS = 150_000

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Which signature values each order sorts by: a slice of its own first, then others.
_ORDERS = np.array([[(t * DEPTH + i) % HASHES if i < DEPTH else (t * 7 + i * 13 + 5) % HASHES for i in range(LEVELS)] for t in range(TREES)])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    claim_cache("neardup", _WORDS.clear)
    if len(_WORDS) > MEMO_WORDS:
        _WORDS.clear()
    w = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h + w[i : len(w) - n + 1 + i] * _PLACE[i]
    return np.unique(_mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values; all ones for an empty set."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, ((s[None, at : at + 2048] * _MULT[:, None]) >> np.uint64(32)).min(1))
    return out.astype("<u4")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, key, sig): set size, digest of the set (null if empty) and signature of each row."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                sets = [shingles(t, words) for t in b.column("text").to_pylist()]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "key", "sig"])

    return docs.mapInArrow(run, "id long, n long, key binary, sig binary")


def _orders(classes: DataFrame) -> DataFrame:
    """(tree, key, node, bits) of each class in each order; keys hold two bytes of each value, high byte first, so they sort as the values do."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)
                keys = (sig & 0xFFFF).astype(">u2")[:, _ORDERS]  # class, tree, level
                bits = np.packbits((sig >> 16 & 1).astype(np.uint8), axis=1)
                n = len(sig)
                flat = keys.reshape(n * TREES, LEVELS)
                bits = np.repeat(bits, TREES, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), _fixed(flat.view(np.uint8).reshape(n * TREES, -1)), pa.array(np.repeat(np.asarray(b.column("node")), TREES)), _fixed(bits)],
                    ["tree", "key", "node", "bits"],
                )

    return classes.select("node", "sig").mapInArrow(run, "tree int, key binary, node long, bits binary")


def _fixed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def order_pairs(tree: np.ndarray, key: np.ndarray, bits: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (i, j, equal bits) of rows sorted by (tree, key)."""
    n = len(tree)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    same = (key[1:] == key[:-1]) & (tree[1:] == tree[:-1])[:, None]
    lcp = np.concatenate([[0], np.cumprod(same, 1).sum(1)])  # with the row before
    depth = np.full(n, LEVELS + 1)
    first = np.arange(n)
    over = np.zeros(n, bool)
    for d in range(LEVELS, DEPTH - 1, -1):
        start = np.flatnonzero(lcp < d)
        size = np.diff(np.append(start, n))
        depth[np.repeat(size <= REGION, size)] = d
        if d == DEPTH:
            first = np.repeat(start, size)
            over = np.repeat(size > REGION, size)
    out_i, out_j = [], []
    shared = lcp[1:]
    for o in range(1, min(REGION, n)):
        # The common prefix of rows i and i + o is the least of those between neighbours.
        ok = (shared >= depth[o:]) | ((o <= WINDOW) & (shared >= DEPTH))
        i = np.flatnonzero(ok)
        out_i.append(i)
        out_j.append(i + o)
        shared = np.minimum(shared[:-1], lcp[o + 1 :])
    star = np.flatnonzero(over & (first < np.arange(n)))
    i, j = np.concatenate([*out_i, first[star]]), np.concatenate([*out_j, star])
    equal = HASHES - np.unpackbits(bits[i] ^ bits[j], axis=1).sum(1, dtype=np.int64)
    ok = equal >= least
    return i[ok], j[ok], equal[ok]


def least_equal_bits(similarity: float) -> float:
    """The most sketch bits that may be asked for: a pair at this similarity shares fewer with a probability no larger than the forest's miss."""
    p, bound, below = (1 + similarity) / 2, (1 - similarity**DEPTH) ** TREES, 0.0
    for k in range(HASHES):
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > bound:
            return k
    return HASHES


def candidates(classes: DataFrame, n: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b, equal) of candidate classes, a < b, each pair once."""
    least = least_equal_bits(similarity)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        tree, node = np.asarray(t.column("tree")), np.asarray(t.column("node"))
        key = np.frombuffer(b"".join(t.column("key").to_pylist()), ">u2").reshape(len(tree), LEVELS)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(tree), -1)
        i, j, equal = order_pairs(tree, key, bits, least)
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        ok = a != b
        # A pair that several orders of this task show goes out once.
        _, once = np.unique(np.stack([a[ok], b[ok]]), axis=1, return_index=True)
        found = pa.table([x[ok][once] for x in (a, b, equal)], ["a", "b", "equal"])
        # The rows at both ends meet those of the parts beside this one in the next round.
        ends = np.arange(len(tree))
        ends = t.take(pa.array(ends[(ends < REGION) | (ends >= len(tree) - REGION)]))
        none = [pa.nulls(len(found), f.type) for f in ends.schema], [pa.nulls(len(ends), pa.int64())] * 3
        names = [*found.column_names, *ends.column_names]
        yield from pa.table([*found.columns, *none[0]], names).to_batches()
        yield from pa.table([*none[1], *ends.columns], names).to_batches()

    rows, count, parts, rounds = _orders(classes), n * TREES, 2, []
    while parts > 1:
        parts = max(1, count // ORDER_ROWS)
        dealt = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
        rounds.append(scratch.keep(dealt.mapInArrow(run, "a long, b long, equal long, tree int, key binary, node long, bits binary"), "met"))
        rows, count = rounds[-1].where("a is null").select("tree", "key", "node", "bits"), 2 * REGION * parts
    pairs = union_all([r.where("a is not null").select("a", "b", "equal") for r in rounds])
    out = scratch.keep(pairs.groupBy("a", "b").agg(F.max("equal").alias("equal")), "pairs")
    scratch.drop(*rounds)
    return out


def _regions(classes: DataFrame) -> DataFrame:
    """(region, node): the order and first ``DEPTH`` values of each class's key, in each order."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)
                k = (sig & 0xFFFF).astype(np.int64)[:, _ORDERS[:, :DEPTH]]  # class, tree, level
                region = np.arange(TREES, dtype=np.int64) << 48 | k[:, :, 0] << 32 | k[:, :, 1] << 16 | k[:, :, 2]
                yield pa.RecordBatch.from_arrays([pa.array(region.reshape(-1)), pa.array(np.repeat(np.asarray(b.column("node")), TREES))], ["region", "node"])

    return classes.select("node", "sig").mapInArrow(run, "region long, node long")


def families(classes: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, c, family) of the classes in over-full regions of several components; c is the component so far."""
    regions = _regions(classes)
    full = scratch.keep(regions.groupBy("region").agg(F.count("*").alias("m")).where(F.col("m") > REGION).select("region"), "full")
    side = with_broadcast(known.select(F.col("node").alias("kn"), "component"))
    over = regions.join(with_broadcast(full), "region").join(side, F.col("node") == F.col("kn"), "left").select("region", "node", F.coalesce("component", "node").alias("c"))
    over = scratch.keep(over, "over")
    mixed = over.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("node").alias("lead")).where("lo <> hi").select("region", "lead")
    mixed = scratch.keep(mixed, "mixed")
    members = scratch.keep(over.join(with_broadcast(mixed), "region").select("node", "c", "lead").distinct(), "members")
    family = scratch.keep(connected_components(members.select(F.col("node").alias("a"), F.col("lead").alias("b")), scratch), "family")
    out = scratch.keep(members.select("node", "c").distinct().join(with_broadcast(family.withColumnRenamed("component", "family")), "node"), "families")
    scratch.drop(full, over, mixed, members, family)
    return out


def tile_links(sets: list[np.ndarray], c: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i of ``left`` and j of ``right``, whose sets reach the similarity: one for any two components c that have some."""
    rows, cols = len(left), len(right)
    n = np.array([len(s) for s in sets], np.int64)
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], n.cumsum()])
    tokens = lambda side: (np.repeat(np.arange(len(side)), n[side]), np.concatenate([place[at[x] : at[x + 1]] for x in side]))
    (lr, lt), (rr, rt) = tokens(left), tokens(right)
    size = int(place.max()) + 1
    dl, dr = np.bincount(lt, minlength=size), np.bincount(rt, minlength=size)
    heavy = dl * dr * 400 > rows * cols
    both = np.zeros((rows, cols), np.float32)  # counts below 2**24 are exact
    # Frequent shingles by dense products, the others pair by pair.
    column = np.cumsum(heavy) - 1
    count = int(heavy.sum())
    lh, rh = heavy[lt], heavy[rt]
    (lr1, lc1), (rr1, rc1) = (lr[lh], column[lt[lh]]), (rr[rh], column[rt[rh]])
    for k in range(0, count, 1024):
        wide = min(1024, count - k)
        a, b = np.zeros((rows, wide), np.float32), np.zeros((cols, wide), np.float32)
        for m, r, col in ((a, lr1, lc1), (b, rr1, rc1)):
            ok = (col >= k) & (col < k + wide)
            m[r[ok], col[ok] - k] = 1
        both += a @ b.T
    light = ~lh & (dr[lt] > 0)
    by = np.argsort(lt[light], kind="stable")
    lr, lt = lr[light][by], lt[light][by]
    ok = ~rh & (dl[rt] > 0)
    rr, rt = rr[ok], rt[ok]
    first, times = np.searchsorted(lt, rt), dl[rt]
    ends = times.cumsum()
    k = 0
    while k < len(rt):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 4_000_000, "right")))
        t = times[k:to]
        within = np.arange(int(t.sum())) - np.repeat(t.cumsum() - t, t)
        i = lr[np.repeat(first[k:to], t) + within]
        both += np.bincount(i * cols + np.repeat(rr[k:to], t), minlength=rows * cols).reshape(rows, cols)
        k = to
    ok = (100 + percent) * both.astype(np.int64) >= percent * (n[left][:, None] + n[right][None, :])
    ok &= c[left][:, None] != c[right][None, :]
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    two = np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])])
    once = np.unique(two, axis=1, return_index=True)[1]
    return i[once], j[once]


def closing_links(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links across components within the families of (node, c, family, s), at least one for any two components that have some. Exact."""
    width = max(math.log(100 / percent) * (1 + 1e-9), 1e-9)  # sets whose bands aren't neighbours differ too much in size
    each = scratch.keep(sets.withColumn("band", F.floor(F.log(F.size("s")) / F.lit(width)).cast("long")), "banded")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(TILE_DOCS)), F.ceil(F.sum(F.size("s")) / F.lit(TILE_SHINGLES))).cast("long")
    sizes = scratch.keep(each.groupBy("family", "band").agg(parts.alias("parts")), "bands")
    around = sizes.select("family", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct(F.col("band").alias("of"), "parts").alias("x"))
    around = around.groupBy("family", "band").agg(F.collect_list("x").alias("around"), F.max(F.when(F.col("x.of") == F.col("band"), F.col("x.parts"))).alias("own")).where("own is not null")
    around = scratch.keep(around, "around")
    salted = each.join(with_broadcast(around), ["family", "band"]).withColumn("salt", F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("own")))
    cell = """flatten(transform(around, x -> transform(sequence(0L, x.parts - 1), q -> case
        when x.of > band or x.of = band and salt < q then named_struct('ba', band, 'sa', salt, 'bb', x.of, 'sb', q, 'side', 0)
        when x.of = band and salt = q then named_struct('ba', band, 'sa', salt, 'bb', band, 'sb', q, 'side', 2)
        else named_struct('ba', x.of, 'sa', q, 'bb', band, 'sb', salt, 'side', 1) end)))"""
    cells = salted.select("node", "c", "family", "s", F.explode(F.expr(cell)).alias("cell")).select("node", "c", "family", "s", "cell.*")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, c, side = (np.asarray(t.column(x)) for x in ("node", "c", "side"))
        i = j = np.zeros(0, np.int64)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if len(left) and len(right) and c.min() != c.max():
            s = t.column("s").combine_chunks()
            flat, at = np.asarray(s.flatten()), np.asarray(s.offsets)
            sets = [flat[x:y] for x, y in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
            i, j = tile_links(sets, c, left, right, percent)
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    return cells.groupBy("family", "ba", "sa", "bb", "sb").applyInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, s) of the documents (id, text) whose id stands in ``wanted`` (id)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t, words).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], ["node", "s"])

    return docs.join(with_broadcast(wanted), "id", "left_semi").mapInArrow(run, "node long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; documents are linked when 100 * |intersection| >= percent * |union|."""
    scratch = Scratch(docs.sparkSession, "neardup")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.keep(signatures(src, words), "signatures")
    classes = rows.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("node"), F.first("sig").alias("sig"))
    classes = scratch.keep(classes, "classes")
    pairs = candidates(classes, classes.count(), percent / 100, scratch)

    nodes = scratch.keep(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "nodes")
    sets = scratch.keep(full_sets(src, nodes, words), "sets")
    likely = pairs.groupBy("b").agg(F.max_by("a", F.struct("equal", -F.col("a"))).alias("a"))
    links = scratch.keep(confirmed(likely, sets, percent), "links")
    known = scratch.keep(forest_roots(links, scratch), "components")  # a class has one likeliest partner, of a smaller id
    rest = scratch.keep(lifted(pairs.select("a", "b"), known).select("a", "b"), "rest")
    more = scratch.keep(confirmed(rest, sets, percent), "links")
    if more.limit(1).count():
        known = scratch.keep(merged(known, more, scratch), "components")

    hot = families(classes, known, scratch)
    if hot.limit(1).count():
        own = full_sets(src, hot.select(F.col("node").alias("id")), words).join(with_broadcast(hot), "node")
        across = scratch.keep(closing_links(own, percent, scratch), "links")
        if across.limit(1).count():
            known = scratch.keep(merged(known, across, scratch), "components")
        scratch.drop(across)

    named = classes.select("key", "node").join(with_broadcast(known), "node", "left").select(F.col("key").alias("k"), F.coalesce("component", "node").alias("c"))
    named = scratch.keep(named, "named")
    scratch.drop(classes, pairs, nodes, sets, links, rest, more, known)  # all that follows reads rows and names only
    out = rows.select("id", "n", "key").join(with_broadcast(named), F.col("key") == F.col("k"), "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Columns stay as they are.

    Of rows that share an id the one with the least text stays; rows without an id all stay.
    """
    scratch = Scratch(docs.sparkSession, "first")
    found = scratch.keep(near_duplicates(docs.select("doc_id", "text"), words, percent), "found")
    gone = scratch.keep(found.where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(with_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    again = scratch.keep(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return left
    side = with_broadcast(again)
    one = W.partitionBy("doc_id").orderBy("text")
    (row,) = free_names(docs, "row")
    repeated = left.join(side, "doc_id", "left_semi").select(*docs.columns, F.row_number().over(one).alias(row)).where(F.col(row) == 1).drop(row)
    return left.join(side, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=3, percent=85)
