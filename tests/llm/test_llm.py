"""Corpus operators: against brute force, exact round trips, held-out accuracy, and unusual tables."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, components, langid, lm, neardup, packing, quality, registry, toxicity, vectors
from corvane.llm.common import Scratch, crc_mod
from support import rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, key string, id long, h long, k int, label int, tree int, node long, row long, quality int, sequence_id long"
EXTRA = (0.5, True, "x", 1, 2, 3, 4, 5, 6, 7, 8, 9)


def docs_of(spark, texts, ids=None, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None, *EXTRA) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


LONG = "word longer " * 30_000 + "x" * 5_000
ODD = ["plain text of some words", None, "", " \t\n ", "A", LONG, "plain text of some words", "日本語 テスト", "\x00\x1c !!! 123", "<|endoftext|> <|startoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns whose names clash."""
    rows_ = [(i, t, [None, "en", "de"][i % 3], [None, "a"][i % 2], None, *EXTRA) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows_, (None, "no id at all here", None, None, None, *EXTRA), rows_[0]], DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# --- odd tables ------------------------------------------------------------------------------------------------------


def test_every_document_operator_takes_odd_tables(spark, odd, no_docs, labels):
    n = odd.count()
    tox = toxicity.fit(odd, labels)
    assert toxicity.toxicity_scores(odd, tox).where("score between 0 and 1").count() == n
    assert toxicity.toxicity_scores(no_docs, toxicity.fit(no_docs, labels.limit(0))).count() == 0
    lang = langid.fit(odd)
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, lang).collect()}
    assert len(got) == n - 1 and got[1] == got[2] == got[3] == got[8] == "und" and got[0] in lang.langs
    assert langid.identify(odd, langid.fit(no_docs)).where("lang_pred = 'und' and score = 0").count() == n
    good = quality.quality(odd, labels)
    assert good.count() == n and good.where("kept and doc_id in (1, 2, 3)").count() == 0
    assert quality.quality(no_docs, labels.limit(0)).count() == 0
    near = neardup.near_duplicates(odd, 3, 85)
    assert near.count() == n and {(r.doc_id, r.component_id) for r in near.where("doc_id in (0, 6)").collect()} == {(0, 0), (6, 0)}
    assert near.where("n_shingles = 0 and not kept").count() == 0 and neardup.near_duplicates(no_docs).count() == 0
    assert lm.score_documents(odd).where("score <= 0 and base_score <= 0").count() == n
    assert lm.score_documents(odd, F.lit(False)).where("train_tokens = 0 and n_known = 0").count() == n and lm.score_documents(no_docs).count() == 0
    assert packing.pack(odd).groupBy("doc_id").count().count() == n - 1 and packing.pack(no_docs).count() == 0
    assert bpe.bpe_decode(bpe.bpe_encode(odd)).count() == n and bpe.bpe_encode(no_docs).count() == 0


def test_filters_keep_columns_and_clean_rows(odd, labels, no_docs):
    for f in (lambda d: langid.keep_identified(d, langid.fit(d)), lambda d: quality.keep_good(d, labels), lambda d: neardup.keep_first(d)):
        assert f(odd).columns == odd.columns and f(no_docs).count() == 0
    kept = [r.doc_id for r in neardup.keep_first(odd).collect()]
    assert kept.count(0) == 1 and 6 not in kept and {1, 2, 3, 4, 5, 7} <= set(kept)


def test_filters_take_any_extra_column(spark, labels):
    """Names that the operators would use themselves, in any case, and rows whose ids repeat."""
    extra = ["__h", "__N", "__s", "__row", "___row", "__host", "__PATH", "__n", "part", "component_id"]
    rows_ = [(i, t, "en", "a", None, *range(len(extra))) for i, t in [*enumerate(ODD), (0, "another text with this id, of several words"), (0, ODD[0])]]
    extra = [c for k, c in enumerate(extra) if c.lower() not in [x.lower() for x in extra[:k]]]
    docs = spark.createDataFrame([r[: 5 + len(extra)] for r in rows_], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in extra))
    for f in (lambda d: langid.keep_identified(d, langid.fit(d)), lambda d: quality.keep_good(d, labels), lambda d: neardup.keep_first(d)):
        assert f(docs).columns == docs.columns and f(docs).count() >= 0
    assert [r.text for r in neardup.keep_first(docs).where("doc_id = 0").collect()] == [min(ODD[0], "another text with this id, of several words")]


def test_word_ratios_are_weighed_by_rows_they_have_not_seen(spark, monkeypatch):
    """Labels that are chance: some words look telling on the rows they were counted on. On those rows they'd tell nearly everything, on others nothing."""
    rng = random.Random(3)
    monkeypatch.setattr(quality, "MIN_Z", 1.0)
    rows_ = [(i, " ".join(rng.sample([f"word{k}" for k in range(600)], 150)), rng.randrange(2)) for i in range(400)]
    docs = docs_of(spark, [t for _, t, _ in rows_])
    m = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows_], "doc_id long, quality int"))
    told = np.array([quality.features(t, m.ratio)[-1] for _, t, _ in rows_])
    seen = np.corrcoef(told, [y for *_, y in rows_])[0, 1]
    assert (len(m.ratio) > 3, seen > 0.4, abs(m.w[-1]) < 0.5) == (True, True, True), (len(m.ratio), seen, m.w[-1])


# --- 1, 2, 9: classifiers --------------------------------------------------------------------------------------------


def test_sparse_sites_shrink_and_large_sites_speak_for_themselves(spark):
    e = spark.createDataFrame([("big", "big/a", 0.9)] * 400 + [("bad", "bad/a", 0.1)] * 400 + [("one", "one/a", 0.0)], "host string, path string, evidence double")
    sites = quality.Sites(e)
    host, path = sites.posteriors()
    got = {r.host: r for r in sites.table.select("host", host.alias("host_posterior"), path.alias("path_posterior")).collect()}
    assert got["big"].host_posterior > 0.88 and got["bad"].host_posterior < 0.12
    assert 0.1 < got["one"].host_posterior < sites.mean and got["one"].path_posterior <= got["one"].host_posterior


def test_quality_equals_brute_force_and_counts_no_evidence_twice(spark):
    rng = random.Random(8)
    rows_ = [(i, (h := rng.choice(["a", "b", "c", None])), rng.choice([f"{h}/x", f"{h}/y", None]), rng.betavariate(5, 1) if h == "a" else rng.random()) for i in range(200)]
    rows_ += [(900, "alone", "alone/x", 0.9), (901, "alone too", None, 0.2), (902, "a", "a/empty", 0.0)]
    scored = spark.createDataFrame(rows_, "doc_id long, host string, path string, evidence double")
    sites = quality.Sites(scored)
    logit = lambda p: math.log(max(min(p, 1 - 1e-9), 1e-9) / (1 - max(min(p, 1 - 1e-9), 1e-9)))
    assert sites.mean == pytest.approx(sum(r[3] for r in rows_) / len(rows_))

    def strength(keys):
        by = defaultdict(list)
        for r, k in zip(rows_, keys, strict=True):
            by[k].append(r[3])
        many = [v for v in by.values() if len(v) > 1]
        n = sum(map(len, many))
        within = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v in many) / max(1, n - len(many))
        between = max(0, (sum(len(v) * (sum(v) / len(v) - sites.mean) ** 2 for v in many) - (len(many) - 1) * within) / n)
        return min(max(sites.mean * (1 - sites.mean) / between - 1 if between > 1e-12 else 1000, 1), 1000)

    assert sites.at_host == pytest.approx(strength([r[1] for r in rows_])) and sites.at_path == pytest.approx(strength([r[1:3] for r in rows_]))
    got = {r.doc_id: r for r in quality.combine(scored).collect()}
    for i, h, p, e in rows_:
        others = [r[3] for r in rows_ if r[1] == h and r[0] != i]
        near = [r[3] for r in rows_ if r[1:3] == (h, p) and r[0] != i]
        host = (sum(others) + sites.at_host * sites.mean) / (len(others) + sites.at_host)
        path = (sum(near) + sites.at_path * host) / (len(near) + sites.at_path)
        q = 1 / (1 + math.exp(-(logit(e) + logit(path) - logit(sites.mean)))) if e else 0
        assert got[i].quality == pytest.approx(q) and got[i].path_posterior == pytest.approx(path) and got[i].kept == (q >= 0.5)
    assert got[900].quality == pytest.approx(0.9) and got[901].quality == pytest.approx(0.2)


def test_content_is_evidence(spark):
    good, bad = "fine words of a good page", "cheap offer click now page"
    texts = [good if i % 2 else bad for i in range(400)]
    docs = docs_of(spark, texts)
    m = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int"))
    assert m.ratio["fine"] > 1 and m.ratio["cheap"] < -1 and "page" not in m.ratio
    p = m.prob(["good words", "click now", None])
    assert p[0] > 0.5 > p[1]


def test_quality_and_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = quality.quality(docs, labels).drop("quality").join(labels, "doc_id").where(crc_mod("doc_id", 5) == 0)
    assert q.where("kept = (quality = 1)").count() >= 0.97 * q.count() and q.where("not kept and quality = 1").count() <= 1
    lang = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(crc_mod("doc_id", 5) == 0)
    assert lang.where("lang = lang_pred").count() >= 0.98 * lang.count()


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    t = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(crc_mod("doc_id", 5) == 0)
    hit, all_toxic, wrong = (t.where(c).count() for c in ("predicted = 1 and toxic = 1", "toxic = 1", "predicted = 1 and toxic = 0"))
    assert hit >= 0.75 * all_toxic and wrong <= 0.01 * t.count()


def test_long_texts_lose_no_ngram_between_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abcdé 漢", k=3000))
    whole = toxicity.buckets(text)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    assert toxicity.buckets(text).tolist() == whole.tolist()


def test_forward_sums_all_segmentations_and_expected_counts_are_posteriors():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    prob = np.random.default_rng(2).random((len(pieces) + 1, 2))
    prob /= prob.sum(0)
    lattice, words = langid.Lattice(pieces), ["▁abab", "▁xb", "b"]

    def ways(w):
        if not w:
            return [[]]
        found = []
        for n in range(1, len(w) + 1):
            piece = pieces.index(w[:n]) if w[:n] in pieces else len(pieces) if n == 1 else None
            if piece is not None:
                found += [[piece, *rest] for rest in ways(w[n:])]
        return found

    for c in range(2):
        p = [[math.prod(prob[x, c] for x in way) for way in ways(w)] for w in words]
        assert lattice.log_likelihood(words, prob)[:, c] == pytest.approx([math.log(sum(x)) for x in p])
        want = np.zeros(len(prob))
        for w, x in zip(words, p, strict=True):
            for way, v in zip(ways(w), x, strict=True):
                np.add.at(want, way, 3 * v / sum(x))
        assert lattice.expected(words, np.full((3, 2), 3.0), prob)[:, c] == pytest.approx(want)


def log_states(word, pieces, logs):
    """log of the summed probability of all ways to each position of a word, by plain recursion."""
    z = [0.0]
    for e in range(1, len(word) + 1):
        ways = [z[e - n] + logs[pieces.get(word[e - n : e], -1)] for n in range(1, min(e, 20) + 1) if n == 1 or word[e - n : e] in pieces]
        top = max(ways)
        z.append(top + math.log(sum(math.exp(x - top) for x in ways)))
    return z


@pytest.mark.parametrize("segment", [1 << 14, 32])
def test_long_words_are_never_cut(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = random.Random(4)
    listed = ["a", "b", "ab", "ba", "aab", "b" * 12, "ab" * 9]
    pieces = {x: i for i, x in enumerate(listed)}
    prob = np.random.default_rng(2).random((len(listed) + 1, 2)) * 1e-6
    lattice, logs = langid.Lattice(listed), np.log(prob)
    words = ["".join(rng.choice("aabbbc") for _ in range(n)) for n in (3, 23, 24, 25, 26, 300, 1500)] + ["b" * 700, "ab" * 400]
    for c in range(2):
        one = {i: logs[i, c] for i in range(-1, len(listed))}
        assert lattice.log_likelihood(words, prob)[:, c] == pytest.approx([log_states(w, pieces, one)[-1] for w in words], rel=1e-9)
        for w in words[-3:]:
            up, down = log_states(w, pieces, one), log_states(w[::-1], {x[::-1]: i for x, i in pieces.items()}, one)[::-1]
            want = np.zeros(len(prob))
            for s in range(len(w)):
                for n in range(1, 21):
                    if s + n <= len(w) and (n == 1 or w[s : s + n] in pieces):
                        i = pieces.get(w[s : s + n], -1)
                        want[i] += math.exp(up[s] + one[i] + down[s + n] - up[-1])
            assert lattice.expected([w], np.ones((1, 2)), prob)[:, c] == pytest.approx(want, rel=1e-6)


def test_predictions_equal_brute_force_and_too_many_languages_are_an_error(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.fit(docs)
    pieces = {x: i for i, x in enumerate(m.pieces)}
    got = {r.doc_id: r for r in langid.identify(docs, m).collect()}
    for r in docs.where("doc_id % 20 = 0").collect():
        words = langid.words_of(r.text)[:400] if r.text else []
        if r.text and len(langid.words_of(r.text)) > 400:
            continue
        z = [lp + sum(log_states(w, pieces, dict(zip(range(-1, len(pieces)), np.log(np.r_[m.prob[-1:, c], m.prob[:-1, c]]).tolist(), strict=True)))[-1] for w in words) for c, lp in enumerate(m.log_prior)]
        if words:
            best = max(z)
            assert got[r.doc_id].lang_pred == m.langs[z.index(best)] and got[r.doc_id].score == pytest.approx(1 / sum(math.exp(x - best) for x in z), abs=1e-3)
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.fit(docs)


# --- 3, 10: vectors --------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, id long, v string, key string"


def vector_table(spark, vs, ids=None):
    return spark.createDataFrame([(i, v, None, 1, "v", "k") for i, v in zip(ids or range(len(vs)), vs, strict=True)], VECTORS)


def test_topk_equals_brute_force_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BINS", 4)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    vs = [rng.integers(-2, 3, 6).astype(float).tolist() for _ in range(700)] + [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [], [1.0, 2.0], [3.0, 1.0]]
    table = vector_table(spark, vs).repartition(5)
    got = sorted(map(tuple, vectors.exact_topk(table, F.col("id") % 100 == 0, 7).collect()))
    ok = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in enumerate(vs) if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 100 == 0):
        best = sorted((-int(ok[q] @ c), i) for i, c in ok.items() if i != q and len(c) == len(ok[q]))[:7]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_of_few_or_no_rows_and_large_components(spark):
    assert vectors.exact_topk(vector_table(spark, []), F.col("id") % 100 == 0).count() == 0
    got = vectors.exact_topk(vector_table(spark, [[1e9, 1.0], [2e9, -1.0], [1e9, 3.0]]), F.col("id") % 100 == 0).collect()
    f = lambda v: [math.floor(1024 * x) for x in v]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, min(sum(a * b for a, b in zip(f([1e9, 1.0]), f(v), strict=True)), 2**63 - 1)) for i, v in ((1, [2e9, -1.0]), (2, [1e9, 3.0]))]


def test_scores_beyond_doubles_are_exact(spark):
    f = lambda v: [math.floor(x) * 1024 if abs(x) > 2**52 else math.floor(1024 * x) for x in v]
    vs = [[1.0, 0.0, 0.5], [1.5e12, 0.0, 0.0], [2e12, 1e15, -3.0], [-2e12, 7.0, 1e-9], [1e300, 0.0, 0.0], [-1e300, 0.0, 0.0], [1e307, -1e307, 0.0], [2e12 + 1, 0.0, 0.0]]
    for first in (vs[0], vs[2], vs[6]):
        all_ = [first, *vs]
        got = vectors.exact_topk(vector_table(spark, all_), F.col("id") % 100 == 0).collect()
        want = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(f(first), f(v), strict=True)))) for v in vs]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i + 1, s) for s, i in sorted(((s, i) for i, s in enumerate(want)), key=lambda x: (-x[0], x[1]))]


def test_null_and_repeated_ids_of_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (None, [9.0, 9.0]), (5, [1.0, 1.0]), (5, [4.0, 0.0]), (100, [0.0, 2.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.exact_topk(table, F.col("id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    m = 1024 * 1024
    assert got[:3] == [(0, 1, 5, 4 * m), (0, 2, 5, m), (0, 3, 100, 0)] and [g[2] for g in got[3:]] == [5, 0, 5] and len(got) == 6
    links = [((7, [1.0, 0.0]), (7, 2, 7, True)), ((7, [0.0, -1.0]), (7, 0, 7, True)), ((None, [1.0, 0.01]), (None, 2, 7, False)), ((9, [1.0, 0.02]), (9, 2, 7, False))]
    links += [((None, [-1.0, 0.0]), (None, 1, None, True)), ((None, [-1.0, 0.01]), (None, 1, None, True)), ((None, None), (None, 0, None, True)), ((3, None), (3, 0, 3, True))]
    rows_ = vectors.vector_links(spark.createDataFrame([x for x, _ in links], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(repr, map(tuple, rows_))) == sorted(repr(x) for _, x in links)


def brute_links(vs, t=0.9):
    ok = [i for i, v in enumerate(vs) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    link = {i: set() for i in range(len(vs))}
    for a, b in itertools.combinations(ok, 2):
        x, y = (np.array(v, float) / max(map(abs, v)) for v in (vs[a], vs[b]))  # so that squares neither overflow nor vanish
        if len(x) == len(y) and x / np.linalg.norm(x) @ (y / np.linalg.norm(y)) >= t:
            link[a].add(b)
            link[b].add(a)
    comp = {}
    for i in range(len(vs)):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += link[x]
    return [(i, len(link[i]), comp[i], comp[i] == i) for i in range(len(vs))]


def test_vector_links_equal_brute_force_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 8))
    vs = [(centres[i % 12] + 0.3 * rng.standard_normal(8)).tolist() for i in range(300)]
    vs += [vs[3]] * 40 + [None, [0.0] * 8, [float("nan")] * 8, [], [1.0, 0.0], [1.0, 0.01], [1e300] * 8, [1e-300] * 8]
    got = sorted(map(tuple, vectors.vector_links(vector_table(spark, vs).repartition(4)).collect()))
    assert got == brute_links(vs)
    assert vectors.vector_links(vector_table(spark, [])).count() == 0


def test_quantisation_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    u, _ = vectors._unit(rng.standard_normal((200, 33)) * rng.random((200, 1)))
    q, s, e = vectors.quantise(u)
    approx = (q.astype(float) @ q.astype(float).T) * s[:, None] * s
    assert (np.abs(u @ u.T - approx) <= e[:, None] + e * (1 + e[:, None])).all()


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 160)) and all(got[i] == 200 for i in (200, 201, 202))


def test_what_has_met_its_root_is_not_joined_again(spark, monkeypatch):
    """A star and a chain: all of the star is done in one round, however many rounds the chain takes."""
    links = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(5000, 5040)]
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": (out := keep(self, df, name), kept.append(out.count()))[0])
    frame, scratch = spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")
    got = sorted(map(tuple, components.forest_roots(frame, scratch).collect()))
    assert got == sorted((i, 0 if i <= 3000 else 5000) for i in [*range(3001), *range(5000, 5041)])
    assert sum(kept) < 2 * 3000 + 10 * 40
    # Further links: two components and one node that wasn't known.
    kept.clear()
    known = scratch.keep(components.forest_roots(frame, scratch), "known")
    kept.clear()
    more = spark.createDataFrame([(2000, 5010), (17, 5040), (5001, 9000), (5, 6), (8000, 8001)], "a long, b long")
    merged = dict(map(tuple, components.merged(known, more, scratch).collect()))
    assert merged == {n: 0 for n, _ in got} | {9000: 0, 8000: 8000, 8001: 8000} and sum(kept) < 40
    assert components.forest_roots(frame.limit(0), scratch).count() == 0


# --- 4, 5: tokens ----------------------------------------------------------------------------------------------------

PARTS = ["a", "B", "e", " ", "  ", "\n", "\t", "'s", "'LL", "é", "É", "ß", "the", "ING", "1", "23", "½", "!", "...", "日本", "語", "🙂", "<|endoftext|>", "\x1c", "\x85", "\xa0", "ǆ", "İ", "́", "aaaa", "--", "ſ", "\x00"]


@pytest.mark.parametrize("file, encode", [("byte_bpe_50k.json", lambda s, t: np.frombuffer(bpe.codec(s).encode(t), "<u4").tolist()), ("word_bpe_49k.json", lambda s, t: packing.tokenizer(s).ids(t).tolist())])
def test_ids_equal_the_library(file, encode):
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path(file), encoding="utf-8").read()
    library, rng = Tokenizer.from_str(spec), random.Random(4)
    for text in ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(spec, text) == ids
        if file.startswith("byte"):
            assert bpe.codec(spec).decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_words_of_many_texts_are_looked_up_once_and_the_memo_is_bounded(monkeypatch):
    spec, rng, asked = open(packing.word_bpe_path(), encoding="utf-8").read(), random.Random(5), []

    class Counted(packing.WordTokenizer):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    tok, words = Counted(spec), ["the", "The", "report.", "Año", "it's", "x,", ",.", "1a2", "-'re"]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(200)] + ["", " ", "日本 the"]
    want = [tok.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tok.encode(texts)] == want
    assert len(asked) <= 4 * len(words)  # nine words and their parts, not 6,000
    monkeypatch.setattr(packing, "MEMO_WORDS", 2)
    tok.clear()
    assert [x.tolist() for x in tok.encode(texts)] == want and len(tok) <= 2


def test_keys_of_many_documents_equal_those_of_each_alone():
    rng = np.random.default_rng(3)
    docs = [np.r_[rng.integers(2, 30, n), 1].astype("<u2") for n in rng.integers(0, 12, 300)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=40)
    corpus = packing.Corpus(df, len(docs), sum(map(len, docs)))

    def alone(d):
        weight = lambda t, n: corpus.idf[t] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(d) / corpus.mean))
        best = sorted((-weight(t, n), t) for t, n in Counter(d[:-1].tolist()).items() if df[t] > 1)[:2]
        return [t for _, t in best] + [-1] * (2 - len(best))

    assert corpus.keys(docs).tolist() == [alone(d) for d in docs] and corpus.keys([]).shape == (0, 2)


def test_automaton_of_a_small_vocabulary_equals_greedy_merging():
    letters = bpe.byte_letters()
    base = [letters[b] for b in b"abc"]
    merges = [("a", "b"), ("a", "a"), ("ab", "c"), ("aa", "b"), ("b", "c"), ("aa", "ab"), ("c", "c"), ("cc", "ab")]
    vocab = {s: i for i, s in enumerate([*base, *(x + y for x, y in merges)])}
    m = bpe.MergeAutomaton(vocab, merges, {})

    def greedy(word):
        out = list(word)
        for x, y in merges:
            i = 0
            while i < len(out) - 1:
                if (out[i], out[i + 1]) == (x, y):
                    out[i : i + 2] = [x + y]
                i += 1
        return [vocab[t] for t in out]

    for n in range(1, 8):
        for w in itertools.product("abc", repeat=n):
            assert m.encode_word("".join(w).encode()) == greedy(w)


def check_packing(docs, pieces):
    """Every id in exactly one piece, gapless sequences, nothing but powers of two below the window."""
    spec = open(packing.word_bpe_path(), encoding="utf-8").read()
    want = {i: np.append(packing.tokenizer(spec).ids(t or ""), 1).astype("<u4") for i, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i]) and p.ids_crc32 == zlib.crc32(want[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(want[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.WINDOW and at & (at - 1) == 0


def test_packing_covers_every_id_once(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"topic{i % 7} " * (i * 3)) for i in range(200)]
    check_packing(docs, packing.pack(docs_of(spark, [t for _, t in docs], [i for i, _ in docs]).repartition(3)).collect())


def test_related_documents_meet_wherever_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 64)
    names = ["volcano", "sonata", "enzyme", "glacier", "harvest", "turbine", "cathedral", "falcon", "orchid", "tariff"]
    docs = [(i, f"the report of {i} about " + f"{names[i % 10]} " * 12 + "and more of it " * 20) for i in range(400)]
    df = docs_of(spark, [t for _, t in docs], [i for i, _ in docs])
    got = [sorted((p.doc_id, p.start, p.length, p.sequence_id, p.offset) for p in packing.pack(d).collect()) for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("doc_id")).coalesce(2))]
    assert got[0] == got[1] == got[2]
    topics = defaultdict(Counter)
    for i, _, n, q, _ in got[0]:
        topics[q][i % 10] += n
    assert sum(max(c.values()) for c in topics.values()) > 0.9 * sum(sum(c.values()) for c in topics.values())
    check_packing(docs, packing.pack(df).collect())


def test_neighbours_by_bm25_share_rare_terms():
    rng = np.random.default_rng(0)
    common = rng.integers(2, 40, (12, 60))
    docs = [np.r_[common[i], np.full(5, 1000 + i % 3)].astype("<u4") for i in range(12)]
    used = np.zeros(12, bool)
    used[0] = True
    near = packing.Index(docs).neighbours(0, used)
    assert set(near[:3].tolist()) == {3, 6, 9} and 0 not in near


# --- 6: chat ---------------------------------------------------------------------------------------------------------


def test_chat_reads_back_any_text(spark):
    parts = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "\\", "<|", "<\\|", "\\n", "é", "🙂", "", "|>"]
    rng = random.Random(6)
    turns = [(c, t, rng.choice(["user", "assistant", "a\nb", "<|x", "\\", None]), None if rng.random() < 0.1 else "".join(rng.choices(parts, k=6))) for c in range(40) for t in range(rng.randint(1, 70))]
    turns += [(None, None, "user", "no conversation"), (3, 0, "assistant", "again"), (3, 0, "assistant", "again")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"m": F.lit(1), "chunk": F.lit(2), "seq": F.lit(3), "kind": F.lit("x")})
    got = {r.conv_id: r for r in chat.format_conversations(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    want = defaultdict(list)
    for c, t, role, text in turns:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, ts in want.items():
        ts = sorted(ts)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in ts]
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        assert [s.loss for s in got[c].segments] == [x for _, _, r, _ in ts for x in (False, r == "assistant", False)]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_logs_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, "", "Hel"), (1, 3, "delta", 1, None, "lo"), (1, 4, "edit", 0, "user", "hello"), (1, 5, "message", 2, "user", "more"),
        (1, 6, "message", 3, "assistant", "old"), (1, 7, "regenerate", 1, "", None), (1, 8, "delta", 1, "", "New"), (1, 9, "message", 2, "user", "later"), (2, 0, "delta", 0, "user", "only a delta"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {r.conv_id: r.turns for r in chat.render(chat.fold_events(df)).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [(t.role, t.text) for t in got[1]] == [("user", "hello"), ("assistant", "New"), ("user", "later")]
    assert [(t.role, t.text) for t in got[2]] == [("user", "only a delta")]


def plain_fold(log):
    """Events one by one, in order: what the operator's docstring says, without its shortcuts."""
    state, cuts = defaultdict(list), []
    for seq, kind, role, text, message in sorted((s, k, r or "", t or "", m) for s, k, m, r, t in log):
        parts = state[message]
        if kind == "message" or not parts:
            parts.append([role, text if kind in ("message", "delta", "edit") else "", seq])
        else:
            p = parts[-1]
            p[0] = role or p[0]
            p[1] = p[1] + text if kind == "delta" else text if kind == "edit" else "" if kind == "regenerate" else p[1]
            p[2] = seq
        if kind == "regenerate":
            cuts.append((message, seq))
    return [(r, t) for m in sorted(state) for r, t, last in state[m] if not any(c < m and s > last for c, s in cuts)]


def test_random_logs_equal_a_plain_fold(spark):
    rng = random.Random(12)
    logs = {c: [(rng.randrange(150) if c % 2 else i, rng.choice(["message", "delta", "delta", "edit", "regenerate", "seen"]), rng.randrange(90) if c % 3 else rng.randrange(4), rng.choice(["user", "assistant", "", None]), rng.choice(["a", "bc", "", None, "<|"])) for i in range(rng.randrange(1, 150))] for c in range(40)}
    df = spark.createDataFrame([(c, s, k, m, r, t) for c, log in logs.items() for s, k, m, r, t in log], "conv_id long, seq long, kind string, message long, role string, text string")
    got = {r.conv_id: r.turns for r in chat.render(chat.fold_events(df)).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    for c, log in logs.items():
        assert [(t.role, t.text) for t in got.get(c, [])] == plain_fold(log)


def test_a_message_of_many_deltas_and_a_long_text(spark):
    n = 30_000
    log = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.lit("delta").alias("kind"), F.lit(0).cast("long").alias("message"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.fold_events(log).first()
    assert got.text == "".join(map(str, range(n)))
    long = "<|\\é🙂\n" * 300_000
    turns = spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", long)], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_conversations(turns).select(chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert [(t.role, t.text) for t in r.turns] == [("assistant", long), ("user", long)]
    kinds = {r.kind for r in chat.message_log(turns.limit(2)).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}


# --- 7: language model -----------------------------------------------------------------------------------------------


def lm_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(1001, None), (1002, "the the the"), (1003, "")]
    return docs, docs_of(spark, [t for _, t in docs], [i for i, _ in docs])


def test_shards_are_numbered_densely_and_share_no_sequence(spark, monkeypatch):
    """Groups of one shard, groups split by the second and the third salt; many empty texts, which share both keys."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 7)
    rng = random.Random(12)
    texts = ["" for _ in range(90)] + [f"word{rng.randrange(3)} word{rng.randrange(3)} same" for _ in range(90)] + [f"alone{i} together{i % 9}" for i in range(60)]
    docs = docs_of(spark, texts)
    spec = open(packing.word_bpe_path(), encoding="utf-8").read()
    told = packing.tokenized(docs.select("doc_id", "text"), spec).cache()
    corpus, ids = packing.corpus_of(told), told.where("seen is null").select("doc_id", "ids", "digest")
    keys = packing.keyed(ids, corpus, packing.WordTokenizer(spec).dtype).cache()
    sizes = keys.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    dealt = packing.sharded(keys, sizes).collect()
    assert len(dealt) == len(texts)
    place = defaultdict(set)
    for r in dealt:
        place[r.shard].add((r.g, r.s2, r.s3))
    assert all(len(v) == 1 for v in place.values()) and len({next(iter(v)) for v in place.values()}) == len(place)
    assert min(place) >= 0 and max(place) < 2 * len(place) + 8 and any(r.s3 > 0 for r in dealt)
    pieces = packing.pack(docs).collect()
    at = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    for (s, o, n), (t, p, _) in itertools.pairwise(at):
        assert p == (o + n if s == t else 0)
    assert {r.sequence_id >> packing.SEQUENCE_BITS for r in pieces} == set(place)


def test_a_worker_holds_no_words_while_documents_are_keyed(spark, monkeypatch):
    spec = open(packing.word_bpe_path(), encoding="utf-8").read()
    dtype = packing.tokenizer(spec).dtype
    ids = spark.createDataFrame([(0, b"", 0)], "doc_id long, ids binary, digest long")
    monkeypatch.setattr(type(ids), "mapInArrow", lambda self, f, schema: f)
    run = packing.keyed(ids, packing.Corpus(np.zeros(9, np.int64), 1, 3), dtype)
    packing.tokenizer(spec).ids("some words")
    docs = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([np.array([5, 6, 1], dtype).tobytes()]), pa.array([0])], ["doc_id", "ids", "digest"])
    assert [b.to_pylist()[0]["n"] for b in run([docs])] == [3] and not packing._TOKENIZERS


def test_packing_keys_documents_once(spark, monkeypatch):
    called, keyed = [], packing.keyed
    monkeypatch.setattr(packing, "keyed", lambda *a, **b: (called.append(1), keyed(*a, **b))[1])
    docs = [(i, f"word{i % 7} and some more of {i % 3}") for i in range(60)]
    check_packing(docs, packing.pack(docs_of(spark, [t for _, t in docs], [i for i, _ in docs])).collect())
    assert len(called) == 1


def test_base_scores_and_counts_equal_brute_force_and_training_does_better(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 50)
    docs, df = lm_tables(spark, sf)
    toks = {i: [*WORDS.findall((t or "").translate(LOWER)), "\n"] for i, t in docs}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    learn = crc_mod("doc_id", 10) != 0
    got = lm.score_documents(df, learn).collect()
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks[r.doc_id]), sum(c[w] > 0 for w in toks[r.doc_id]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks[r.doc_id]), abs=1e-8)
    monkeypatch.setattr(lm, "ROUNDS", 0)
    untrained = {r.doc_id: r.score for r in lm.score_documents(df, learn).collect()}
    held = [r for r in got if r.doc_id not in set(train)]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) > sum(untrained[r.doc_id] for r in held) + 0.2 * tokens
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def trained(spark, df, learn):
    table = lm.tokenized(df, learn)
    stats = lm.Statistics(lm.count_tokens(table.where("learn")).cache())
    model, rest, fresh = stats.model()
    return stats, lm.fit(model, table.where("learn").select("doc_id", "tokens"), int(stats.n[lm.END])), rest, fresh


@pytest.mark.parametrize("top", [50, 1 << 18])
def test_model_scores_equal_brute_force(spark, sf, monkeypatch, top):
    """Every token by itself, from the definition: features, softmax of the class, softmax of the slot, share of the shared slot."""
    monkeypatch.setattr(lm, "TOP", top)
    monkeypatch.setattr(lm, "SCORED", 300)
    docs, df = lm_tables(spark, sf)
    docs = docs[-40:]
    df = df.where(F.col("doc_id").isin([i for i, _ in docs]))
    learn = crc_mod("doc_id", 10) != 0
    stats, m, rest, fresh = trained(spark, df, learn)
    toks = {i: [w.encode() for w in WORDS.findall((t or "").translate(LOWER))] for i, t in docs}
    c = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    slots = {int(t): (int(s), int(u)) for t, s, u in zip(stats.top, *((lambda p: (m.slot[p], m.unit[p]))(m.table.find(stats.top))), strict=True)}

    def softmax(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    got = {r.doc_id: r.score for r in lm.score_documents(df, learn).collect()}
    for i, ws in toks.items():
        events, near, want = [lm.CLASSES] * 3, lm.CLASSES, 0.0
        for at, w in enumerate([*ws, None]):
            t = lm.word_token(w) if w is not None else None
            k = lm.END if w is None else lm.AGAIN if at and w == ws[at - 1] else int(m.class_of[t % lm.TYPES])
            p1, p2, p3 = events[-1], events[-2], events[-3]
            one = lambda x: np.array([x])
            rows_ = [lm._hashed(n, one(x))[0] for n, x in enumerate((m.class_of_near[near], near, m.class_of_near[near] * lm.PAST + p2, p2, p3))]
            assert m.class_of_near[near] == p1
            want += math.log10(softmax(m.classes.bias[0].astype(float) + sum(m.classes.weights[r].astype(float) for r in rows_))[k])
            slot, unit = slots.get(t, (0, -1))
            if k > lm.AGAIN:
                rows_ = [lm._hashed(n, one(x))[0] for n, x in enumerate((k * lm.PAST + p1, k * lm.NEAR + near, k * lm.PAST + p2))]
                want += math.log10(softmax(m.words.bias[k].astype(float) + sum(m.words.weights[r].astype(float) for r in rows_))[slot])
                if not slot:
                    want += math.log10((1 - fresh[k]) * c[w] / rest[k] if c[w] else fresh[k])
            near = lm.PAST + unit if unit >= 0 and k > lm.AGAIN else k
            events.append(k)
        assert got[i] == pytest.approx(want, abs=1e-4 * (len(ws) + 1))
    # The words of a class, and what was never seen, have the whole of it.
    for k in range(2, lm.CLASSES):
        own = {w: n for w, n in c.items() if m.class_of[lm.word_token(w) % lm.TYPES] == k}
        shared = sum(n for w, n in own.items() if not slots.get(lm.word_token(w), (0,))[0])
        assert shared == pytest.approx(rest[k]) and 0 < fresh[k] <= 1


def test_classes_of_degenerate_counts():
    """All equal, one row, one pair, nothing, very large: every type has a class, and what the counts say of types of two kinds shows in the classes."""
    n = lm.TYPES
    one = np.zeros((n, n))
    one[3] = 5
    pair = np.zeros((n, n))
    pair[1, 2] = 1
    for counts in (np.zeros((n, n)), np.ones((n, n)), one, pair, np.full((n, n), 1e15), np.eye(n) * 7):
        got = lm.cluster_types(counts)
        assert got.shape == (n,) and got.min() >= 2 and got.max() < lm.CLASSES
    assert len(set(lm.cluster_types(np.zeros((n, n))).tolist())) == lm.CLASSES - 2
    kinds = np.arange(n) % 2
    two = lm.cluster_types(np.where(kinds[:, None] != kinds[None, :], 50.0, 0.0))
    assert not set(two[kinds == 0].tolist()) & set(two[kinds == 1].tolist())
    for bad in (np.nan, -1.0, np.inf):
        with pytest.raises(ValueError, match="finite"):
            lm.cluster_types(np.full((n, n), bad))


def test_every_training_document_moves_the_weights(spark):
    n = 6000
    texts = [f"own{i} word and{i % 7}" for i in range(n)]
    _, m, _, _ = trained(spark, docs_of(spark, texts), F.lit(True))
    for t in texts:
        _, _, history, _ = m.events([lm.tokens_of(t)])
        assert m.classes.weights[m.class_features(history)[0]].any(2).all()
    assert m.words.weights.any()


def test_probabilities_of_both_factors_sum_to_one():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 60, 500).astype(np.uint64)
    m = lm.Model(2 + np.arange(lm.TYPES) % (lm.CLASSES - 2), words, rng.integers(0, lm.SLOTS, 500), np.where(np.arange(500) < lm.UNITS, np.arange(500), -1), np.ones((lm.CLASSES, lm.SLOTS)), np.ones(lm.CLASSES))
    for f in (m.classes, m.words):
        f.weights += rng.standard_normal(f.weights.shape).astype(np.float32)
    _, _, ch, wh = m.events([words[rng.integers(0, 500, 200)], words[:0]])
    for f, (rows_, b) in ((m.classes, m.class_features(ch)), (m.words, m.word_features(wh))):
        assert np.exp(lm._log_softmax(f.logits(rows_, b))).sum(1) == pytest.approx(1, abs=1e-4)
    assert m.events([words[:0]])[0].tolist() == [lm.END]


# --- 8: near duplicates ----------------------------------------------------------------------------------------------


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), top(i), top(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(40, 150))
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [" ".join(passage + rng.choices(vocab, k=rng.randint(5, 30))) for _ in range(80)]
    big = rng.choices(vocab, k=80)
    texts += [" ".join([*big[:j], "Edit" + str(j), *big[j + 1 :]]) for j in range(80)] + [" ".join(big)] * 30
    texts += ["one", "ONE", "one two", "", None, "  ", "a b c", "a b c d", "A B\tC\nD", LONG]
    got = sorted(map(tuple, neardup.near_duplicates(docs_of(spark, texts).repartition(5), words, percent).collect()))
    assert got == brute_components(texts, words, percent)


def test_a_region_of_equal_prefixes_gives_few_candidates():
    n = 3000
    key = np.zeros((n, neardup.LEVELS), np.uint16)  # one region, however deep
    i, j, _ = neardup.order_pairs(np.zeros(n, int), key, np.zeros((n, neardup.HASHES // 8), np.uint8), 0)
    assert len(i) <= n * (neardup.WINDOW + 1) and set(range(1, n)) <= set(j.tolist())


def test_links_in_a_large_family_of_unlinked_texts_are_all_found(spark, monkeypatch):
    """One template with tails of their own (similarity 0.80), and pairs that share a part of the tail (0.88)."""
    monkeypatch.setattr(neardup, "TILE_DOCS", 300)
    template, n, pairs = " ".join(f"t{i}" for i in range(100)), 2400, 400
    tail = lambda i, k: " ".join(f"x{i}_{j}" for j in range(k))
    texts = [f"{template} {tail(i % (n - pairs), 5)} {tail(10**6 + i, 7)}" for i in range(n)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert got == {i: i % (n - pairs) for i in range(n)}


def test_links_just_above_the_threshold_among_texts_just_below_are_all_found(spark):
    """One template of 90 shingles: any two texts share 0.837 of theirs, planted pairs 0.856 (a part of the tail more)."""
    template, n, pairs = " ".join(f"t{i}" for i in range(92)), 1000, 150
    tail = lambda i, k: " ".join(f"x{i}_{j}" for j in range(k))
    texts = [f"{template} {tail(i % (n - pairs), 1)} {tail(10**6 + i, 8)}" for i in range(n)]
    sets = [neardup.shingles(t, 3) for t in texts]
    share = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert share(0, 1) < 0.85 <= share(0, n - pairs) < 0.87 and share(0, 1) > 0.82
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert got == {i: i % (n - pairs) for i in range(n)}


def test_tile_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.95], rng.integers(0, 300, rng.integers(1, 12))]) for _ in range(90)]
    c, left, right = rng.integers(0, 25, 90), np.arange(50), np.arange(40, 90)
    i, j = neardup.tile_links(sets, c, left, right, 80)
    alike = lambda x, y: 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))
    want = {tuple(sorted((c[x], c[y]))) for x in left for y in right if c[x] != c[y] and alike(x, y)}
    assert want and all(alike(x, y) for x, y in zip(i, j, strict=True)) and sorted(want) == sorted(tuple(sorted((c[x], c[y]))) for x, y in zip(i, j, strict=True))


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_the_sketch_loses_no_more_than_the_orders(similarity):
    p, n = (1 + similarity) / 2, neardup.HASHES
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(math.ceil(neardup.least_equal_bits(similarity))))
    assert lost <= (1 - similarity**neardup.DEPTH) ** neardup.TREES


@pytest.mark.parametrize("n, order_rows", [(2, 100_000), (80, 100)])
def test_no_boundary_between_parts_parts_a_pair(spark, monkeypatch, n, order_rows):
    monkeypatch.setattr(neardup, "ORDER_ROWS", order_rows)
    texts = [" ".join(f"p{i // 2}_{j}" for j in range(60)) + f" end{i}" for i in range(n)]
    classes = [(i, bytearray(neardup.signature(neardup.shingles(t, 3)).tobytes())) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = neardup.candidates(spark.createDataFrame(classes, "node long, sig binary"), n, 0.85, Scratch(spark, "parts")).select("a", "b").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(i, i + 1) for i in range(0, n, 2)} <= set(map(tuple, got))


def test_components_of_a_large_family_with_sparse_links_are_whole():
    rng, n, length = random.Random(4), 600, 150
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    sets = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        sets.append(neardup.shingles(" ".join(w), 5))
    place = {x: i for i, x in enumerate(sorted({x for s in sets for x in s.tolist()}))}
    m = np.zeros((n, len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s.tolist()]] = 1
    both, size = m @ m.T, m.sum(1)
    link = 100 * both >= 80 * (size[:, None] + size - both)
    sig = np.stack([neardup.signature(s) for s in sets])
    bits = np.packbits((sig >> 16 & 1).astype(np.uint8), axis=1)
    found = np.zeros((n, n), bool)
    for order in neardup._ORDERS:
        key = (sig & 0xFFFF)[:, order]
        o = np.lexsort(key.T[::-1])
        i, j, _ = neardup.order_pairs(np.zeros(n, int), key[o], bits[o], neardup.least_equal_bits(0.8))
        found[o[i], o[j]] = True
    a, b = np.nonzero(link & (found | found.T))
    x, y = np.nonzero(np.triu(link, 1))
    assert vectors.local_roots(n, a, b).tolist() == vectors.local_roots(n, x, y).tolist() and len(x) > 3 * len(np.nonzero(np.triu(found, 1) & link)[0]) / 2 > 0


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_equals_a_plain_version(spark, sf):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    all_rows = docs.orderBy("doc_id").collect()
    model = langid.fit(docs)
    langs, scores = langid._Scorer(model).predict([r.text for r in all_rows])
    one = [r for r, x, s in zip(all_rows, langs, scores, strict=True) if x != "und" and s >= 0.5]
    assert sorted(r.doc_id for r in cp.language(spark, docs, sf).collect()) == [r.doc_id for r in one]
    first = spark.createDataFrame(one, docs.schema)
    ev = quality.fit(first, labels)
    e = {r.doc_id: float(p) for r, p in zip(one, ev.prob([r.text for r in one]), strict=True)}
    kept = {r.doc_id for r in quality.combine(spark.createDataFrame([(r.doc_id, r.source, f"{r.source}/{r.lang}", e[r.doc_id]) for r in one], "doc_id long, host string, path string, evidence double")).where("kept").collect()}
    two = [r for r in one if r.doc_id in kept]
    assert sorted(r.doc_id for r in cp.good(spark, first, sf).collect()) == [r.doc_id for r in two]
    stay = [two[i] for i, _, _, k in brute_components([r.text for r in two], 5, 80) if k]
    got = cp.distinct(spark, spark.createDataFrame(two, docs.schema), sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [r.doc_id for r in stay]
    check_packing([(r.doc_id, r.text) for r in stay], cp.run(spark, sf).collect())


def test_pipeline_takes_odd_and_empty_tables(spark, odd, no_docs, labels, tmp_path):
    import corpus_pipeline as cp

    for name, docs, marks in (("odd", odd, labels), ("empty", no_docs, labels.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for n, stage in cp.STAGES[:-1]:
            out = stage(spark, spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), f"{tmp_path}/{name}")
            assert out.columns == docs.columns
            assert name == "odd" or out.count() == 0
    kept = cp.language(spark, odd, f"{tmp_path}/odd")
    assert kept.where("text is null or trim(text) = ''").count() == 0 and kept.count() > 0
    assert cp.run(spark, f"{tmp_path}/empty").count() == 0
    pieces = cp.run(spark, f"{tmp_path}/odd").collect()
    by = defaultdict(int)
    for p in pieces:
        by[p.doc_id] += p.length
    assert all(by[p.doc_id] >= p.doc_tokens for p in pieces)


def test_decoding_nulls_and_invalid_bytes(spark):
    ids = lambda *x: np.array(x, "<u4").tobytes()
    c = bpe.codec(open(bpe.byte_bpe_path(), encoding="utf-8").read())
    broken = c.automaton.labels.index(b"\xe2") if hasattr(c, "automaton") else None
    rows_ = [(1, None), (2, b""), (3, c.encode("plain é"))] + ([(4, ids(broken))] if broken is not None else [])
    got = {r.doc_id: r.text for r in bpe.bpe_decode(spark.createDataFrame(rows_, "doc_id long, ids binary")).collect()}
    assert got[1] == got[2] == "" and got[3] == "plain é" and got.get(4, "\ufffd") == "\ufffd"


def test_remembered_arcs_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "ARCS", 10)
    c = bpe.codec(open(bpe.byte_bpe_path(), encoding="utf-8").read())
    text = " ".join(random.Random(1).choices(["unbelievable", "hippopotamus", "straße", "xyzzy1234"], k=50))
    from tokenizers import Tokenizer

    assert np.frombuffer(c.encode(text), "<u4").tolist() == Tokenizer.from_file(bpe.byte_bpe_path()).encode(text, add_special_tokens=False).ids


def test_toxicity_equals_brute_force(spark):
    """Buckets, log-count ratios and the score, one n-gram at a time."""
    rng = random.Random(5)
    words = ["nice", "day", "Vile", "filth", "tree", "walk"]
    texts = [" ".join(rng.choices(words[:2] + words[4:] if i % 3 else words[1:4], k=8)) for i in range(120)]
    docs, marks = docs_of(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    m = toxicity.fit(docs, marks)

    def grams(t):
        t, out = f" {' '.join(t.lower().split())} ", set()
        for n in toxicity.SIZES:
            for i in range(len(t) - n + 1):
                h = 0
                for k, ch in enumerate(t[i : i + n]):
                    h = ord(ch) if k == 0 else (h * 0x9E3779B97F4A7C15 + ord(ch)) % 2**64
                out.add((((h ^ n) * 0xD6E8FEB86659FD93) % 2**64) >> (64 - toxicity.BITS))
        return out

    assert all(sorted(grams(t)) == toxicity.buckets(t).tolist() for t in texts[:20])
    learn = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    pos, neg = (Counter(g for i in learn if (i % 3 == 0) == bad for g in grams(texts[i])) for bad in (True, False))
    p, n = (sum((i % 3 == 0) == bad for i in learn) for bad in (True, False))
    for g in {*pos, *neg}:
        r = math.log((pos[g] + 1) / (p + 2)) - math.log((neg[g] + 1) / (n + 2))
        if abs(r) < toxicity.MIN_Z * math.sqrt(1 / (pos[g] + 1) + 1 / (neg[g] + 1)):
            assert m.coef[g] == 0
        elif m.coef[g]:
            assert m.coef[g] * r > 0  # training moves a ratio's weight from none towards its side
    for r in toxicity.toxicity_scores(docs, m).collect():
        z = m.bias + sum(m.coef[g] for g in grams(texts[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == int(r.score >= 0.5) == int(r.doc_id % 3 == 0)


def test_digests_of_the_queries(spark, sf):
    r = registry.QUERIES["op5_bpe_codec"](spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").first().text
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    c = registry.QUERIES["op6_chat_format"](spark, sf).where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert (c.n_turns, c.loss_chars, c.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert json.dumps(sorted(registry.QUERIES)) and duckdb.sql("SELECT 1").fetchall() == [(1,)]
