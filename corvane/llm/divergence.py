"""How the sources of a language differ: term by term and source by source, in exact whole numbers.

1. One pass counts terms per (lang, source) in each task and hands on partial sums (a hot source is a few rows a term and task, however many
   rows it has); their sum gives counts and document frequencies. A language keeps the terms of at least ``LEAST_DOCS`` of its documents.
2. A group's p of a term is ``1 + floor(SCALE * (count + 1) / (N + V))``. Part ``term`` ranks the terms that a source has more often than its
   language; Spark cuts each task's rows to the ranks asked for before it shuffles them.
3. Part ``pair`` sums ``f = floor((p - q)**2 / q)`` over all kept terms for every ordered pair of sources. Sources are hashed into blocks of
   about ``BLOCK``, terms into slices of about ``SLICE``; a task is one pair of blocks and one slice. Heavy terms, which stand in more than one of
   ``HEAVY`` groups of the language, are dense (terms x sources) arrays multiplied out block by block. Of the others each is first taken as absent
   everywhere (one f of the two sources' p at count 0, times their number); then every posting is set right against all sources as if absent there (once
   for each different p of a source), and then every two postings of a term. All partial sums are whole numbers and are added exactly.

Values: p is at most SCALE + 1, f below 2**60, and a sum of f below 2**62 for any distribution, so 64 bits hold them; counts are summed in 64 bits
and scaled in decimals.

Defined results: null text, language or source is the empty string; a term is a longest run of ASCII letters and non-ASCII characters, A-Z lower-cased; repeated
rows are documents of their own; a source without terms is a group; a language without kept terms has pairs of value 0; ties go to the smaller item in
UTF-8 order; extra columns don't matter, and an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, with_broadcast

LEAST_DOCS = 3
SCALE = 1_000_000_000
RANKS = 200
#: Sources of a block and terms of a slice, about.
BLOCK, SLICE = 128, 4_096
#: A term is heavy when it stands in more than one of so many groups of its language.
HEAVY = 4
#: Different (group, term) that a task counts before it hands them on.
HELD = 400_000

_UPPER = range(ord("A"), ord("Z") + 1)
#: Bytes to themselves in lower case where a term may have them, else to a blank: what is not ASCII is part of terms.
_TERM_BYTES = bytes(b + 32 if b in _UPPER else b if b >= 128 or ord("a") <= b <= ord("z") else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) partial counts of each task; every group has a row of the null term."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])

    def rows(counts: dict, seen: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), c in counts.items():
            s = seen[lang, source]
            terms = [None, *c]
            for at in range(0, len(terms), 100_000):
                part = terms[at : at + 100_000]
                text = pa.array(part, pa.binary()).cast(pa.string())
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), text, pa.array([c[t] for t in part], pa.int64()), pa.array([s[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                key = lang, source
                if key not in counts:
                    counts[key], seen[key] = Counter(), Counter()
                words = text.translate(_TERM_BYTES).split()
                counts[key].update(words)
                seen[key].update(set(words))
            if sum(map(len, counts.values())) > HELD:
                yield from rows(counts, seen)
                counts, seen = {}, {}
        yield from rows(counts, seen)

    return src.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str, terms: str) -> str:
    """p of a count in a group of ``total`` occurrences of ``terms`` kept terms, in decimals (a count times SCALE may pass 64 bits)."""
    return f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast(greatest({total} + {terms}, 1) as decimal(20,0)) as long)"


class Audit:
    """Counts, kept terms and groups of a table, written once; ``terms`` and ``pairs`` read them."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        self.scratch = scratch = Scratch(docs.sparkSession, "divergence")
        counted = scratch.keep(term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        groups = counted.where("term is null").select("lang", "source")
        kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("spread")).where(F.col("docs") >= LEAST_DOCS)
        kept = scratch.keep(kept.select("lang", "term", "lang_n", "spread"), "kept")
        #: (lang, lang_total, vocabulary, sources) of each language.
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.sum("lang_n").alias("t"), F.count("*").alias("v")), "lang", "left")
        self.langs = langs = scratch.keep(langs.select("lang", "sources", F.coalesce("t", F.lit(0)).alias("lang_total"), F.coalesce("v", F.lit(0)).alias("vocabulary")), "langs")
        in_lang = with_broadcast(langs)
        counts = counted.where("term is not null").join(kept, ["lang", "term"])
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("t"))
        groups = groups.join(totals, ["lang", "source"], "left").join(in_lang, "lang").withColumn("total", F.coalesce("t", F.lit(0)))
        #: (lang, source, total, vocabulary, sources, p0): p0 is a group's p of a kept term that it doesn't have.
        self.groups = groups = scratch.keep(groups.select("lang", "source", "total", "vocabulary", "sources", F.expr(_share("0", "total", "vocabulary")).alias("p0")), "groups")
        joined = counts.join(with_broadcast(groups.select("lang", "source", "total", "vocabulary", "sources")), ["lang", "source"]).join(in_lang.select("lang", "lang_total"), "lang")
        #: (lang, source, term, p, q, heavy) of each term that a group has; q is the language's.
        self.postings = scratch.keep(
            joined.select("lang", "source", "term", F.expr(_share("n", "total", "vocabulary")).alias("p"), F.expr(_share("lang_n", "lang_total", "vocabulary")).alias("q"), (F.col("spread") * HEAVY > F.col("sources")).alias("heavy")), "postings"
        )
        self.kept = kept
        scratch.drop(counted)

    def terms(self, ranks: int = RANKS) -> DataFrame:
        """(lang, source, item, value, rank) of the terms that a source has more often than its language."""
        f = F.expr("((p - q) * (p - q)) div q")
        best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return self.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), f.alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    def pair_sums(self) -> DataFrame:
        """(lang, source, item, value) of every two sources of a language: the sum of f over all kept terms, p of source and q of item."""
        blocks = F.ceil(F.col("sources") / F.lit(BLOCK)).cast("long")
        sides = self.groups.select("lang", "source", "p0", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit("block"), "source"), blocks).alias("block"))
        parts = with_broadcast(self.langs.select("lang", F.greatest(F.ceil(F.col("vocabulary") / F.lit(SLICE)), F.lit(1)).cast("long").alias("slices")))
        part = F.pmod(F.xxhash64(F.lit("slice"), "term"), F.col("slices")).alias("slice")
        heavy = F.col("spread") * HEAVY > F.col("sources")
        found = self.kept.join(with_broadcast(self.langs.select("lang", "sources")), "lang").join(parts, "lang").groupBy("lang", part).agg(F.count_if(~heavy).alias("light"), F.count_if(heavy).alias("heavy"))
        slices = parts.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")).join(found, ["lang", "slice"], "left")
        # A row without a term is a source: it tells how many light terms (light) and heavy ones (p) the slice has.
        rows = sides.join(with_broadcast(slices), "lang").select("lang", "slice", "block", "blocks", "source", "p0", F.lit(None).cast("string").alias("term"), F.coalesce("heavy", F.lit(0)).cast("long").alias("p"), F.coalesce("light", F.lit(0)).alias("light"), F.lit(False).alias("heavy"))
        at = with_broadcast(sides.select("lang", "source", "block", "blocks", "p0"))
        rows = rows.unionByName(self.postings.join(at, ["lang", "source"]).join(parts, "lang").select("lang", part, "block", "blocks", "source", "p0", "term", "p", F.lit(0).alias("light"), "heavy"))
        # A row of block x goes to the pairs (x, y) of blocks with y >= x on the left, and (w, x) with w <= x on the right.
        tile = """concat(transform(sequence(block, blocks - 1), y -> named_struct('a', block, 'b', y, 'side', if(y = block, 2, 0))),
            if(block > 0, transform(sequence(0L, block - 1), w -> named_struct('a', w, 'b', block, 'side', 1)), cast(array() as array<struct<a: bigint, b: bigint, side: int>>)))"""
        rows = rows.withColumn("tile", F.explode(F.expr(tile))).select("lang", "slice", "tile.a", "tile.b", "tile.side", "source", "p0", "term", "p", "light", "heavy")
        sums = rows.groupBy("lang", "slice", "a", "b").applyInArrow(tile_sums, "lang string, source string, item string, value long")
        return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """``pair_sums`` with ranks."""
        best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return self.pair_sums().withColumn("rank", F.row_number().over(best))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tile_sums(t: pa.Table) -> pa.Table:
    """Sums over one slice of terms for the sources of two blocks, in both directions; ``dense`` and ``sparse`` parts are added."""
    t = t.combine_chunks()
    side, term = np.asarray(t.column("side")), t.column("term").combine_chunks()
    heavy, p, p0, light = (t.column(c).combine_chunks() for c in ("heavy", "p", "p0", "light"))
    heavy, p0, light = np.asarray(heavy), np.asarray(p0), np.asarray(light)
    is_group = np.asarray(term.is_null())
    p = np.asarray(p)
    source = t.column("source").combine_chunks().dictionary_encode()
    names, source = source.dictionary, np.asarray(source.indices)
    term = np.asarray(term.dictionary_encode().indices.fill_null(-1))
    g = int(np.flatnonzero(is_group)[0])
    n_light, n_heavy = int(light[g]), int(p[g])

    def of(side_: int) -> tuple:
        mine = (side == side_) | (side == 2)
        g = np.flatnonzero(mine & is_group)
        place = np.full(len(names), -1)
        place[source[g]] = np.arange(len(g))
        x = np.flatnonzero(mine & ~is_group)
        return source[g], p0[g], place[source[x]], term[x], p[x], heavy[x]

    left, right = of(0), of(1)
    same = len(left[0]) == len(right[0]) and bool((left[0] == right[0]).all())
    out = [(x, y, _dense(x, y, n_heavy) + _sparse(x, y, n_light)) for x, y in [(left, right), (right, left)][: 1 if same else 2]]
    one, two, value = [], [], []
    for x, y, v in out:
        i, j = np.nonzero(x[0][:, None] != y[0][None, :])
        one.append(x[0][i]), two.append(y[0][j]), value.append(v[i, j])
    one, two, value = map(np.concatenate, (one, two, value))
    lang = pa.array([t.column("lang")[0].as_py()] * len(one), pa.string())
    return pa.table([lang, names.take(pa.array(one)), names.take(pa.array(two)), pa.array(value, pa.int64())], ["lang", "source", "item", "value"])


def _dense(left: tuple, right: tuple, count: int) -> np.ndarray:
    """Heavy terms: (terms, sources) arrays, p0 where a source lacks the term; one source of the left at a time against the whole right block.

    Of the slice's ``count`` heavy terms those that neither block has are alike."""
    (_, zero_l, at_l, term_l, p_l, heavy_l), (_, zero_r, at_r, term_r, p_r, heavy_r) = left, right
    terms, place = np.unique(np.concatenate([term_l[heavy_l], term_r[heavy_r]]), return_inverse=True)
    k = int(heavy_l.sum())
    a, b = np.repeat(zero_l[None, :], len(terms), 0), np.repeat(zero_r[None, :], len(terms), 0)
    a[place[:k], at_l[heavy_l]] = p_l[heavy_l]
    b[place[k:], at_r[heavy_r]] = p_r[heavy_r]
    out = _f(zero_l[:, None], zero_r[None, :]) * (count - len(terms))
    for i in range(len(zero_l)):
        out[i] += _f(a[:, i, None], b).sum(0)
    return out


def _sparse(left: tuple, right: tuple, count: int) -> np.ndarray:
    """The slice's ``count`` light terms: absent everywhere, then each posting against absence, then each two postings of a term."""
    (_, zero_l, at_l, term_l, p_l, heavy_l), (_, zero_r, at_r, term_r, p_r, heavy_r) = left, right
    at_l, term_l, p_l, at_r, term_r, p_r = at_l[~heavy_l], term_l[~heavy_l], p_l[~heavy_l], at_r[~heavy_r], term_r[~heavy_r], p_r[~heavy_r]
    none = _f(zero_l[:, None], zero_r[None, :])
    out = none * count
    both, times = np.unique(np.stack([at_l, p_l]), axis=1, return_counts=True)
    for i in np.unique(both[0]):
        of = both[0] == i
        out[i] += (times[of, None] * (_f(both[1][of, None], zero_r[None, :]) - none[i])).sum(0)
    both, times = np.unique(np.stack([at_r, p_r]), axis=1, return_counts=True)
    for j in np.unique(both[0]):
        of = both[0] == j
        out[:, j] += (times[of, None] * (_f(zero_l[None, :], both[1][of, None]) - none[:, j])).sum(0)
    by = np.argsort(term_l, kind="stable")
    at_l, term_l, p_l = at_l[by], term_l[by], p_l[by]
    first, last = np.searchsorted(term_l, term_r), np.searchsorted(term_l, term_r, "right")
    times, k = last - first, 0
    ends = times.cumsum()
    while k < len(times):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 2_000_000, "right")))
        n = times[k:to]
        i = np.arange(int(n.sum())) - np.repeat(n.cumsum() - n - first[k:to], n)
        j = np.repeat(np.arange(k, to), n)
        a, b, p, q = at_l[i], at_r[j], p_l[i], p_r[j]
        np.add.at(out, (a, b), _f(p, q) - _f(p, zero_r[b]) - _f(zero_l[a], q) + none[a, b])
        k = to
    return out


def source_divergence(docs: DataFrame, ranks: int = RANKS, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source's term shares stand from those of each other source (``pair``) and which terms it prefers (``term``)."""
    audit = Audit(docs, **columns)
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", audit.pairs()), ("term", audit.terms(ranks)))]
    return out[0].unionByName(out[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


ORACLE = """
with d as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), w as (
    select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d
), kept as (
    select lang, term, count(*) as n from w group by lang, term having count(distinct r) >= 3
), c as (
    select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term
), v as (
    select lang, count(*) as v, sum(n) as total from kept group by lang
), g as (
    select lang, source, coalesce(sum(c.n), 0) as total from (select distinct lang, source from d) left join c using (lang, source) group by lang, source
), p as (
    select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + v.v)::hugeint as p, 1 + (1000000000::hugeint * (kept.n + 1)) // (v.total + v.v)::hugeint as q
    from g join v using (lang) join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term
), both_ as (
    select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
    group by a.lang, a.source, b.source
), found as (
    select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item) as rank from both_
    union all
    select * from (
        select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint as value, row_number() over (partition by lang, source order by ((p - q) * (p - q)) // q desc, term) as rank from p where n > 0 and p > q
    ) where rank <= 200
)
select lang, source, part, item, value, rank::int as rank from found
"""
