"""Decontamination, fill-in-middle and source divergence: against brute force and exact round trips, on small and unusual tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, EXTRA, LONG, LOWER, ODD, docs_of

from corvane.llm import decontaminate, divergence, fim

# --- 11: decontamination ---------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def by_definition(text, items, window=10):
    """(words, hit words, items) and the longest matches, from the definitions."""
    w, hit, found = words_of(text), set(), set()
    for i, t in items:
        v = words_of(t)
        size = min(window, len(v))
        grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if size else set()
        for p in range(len(w) - size + 1 if size else 0):
            if tuple(w[p : p + size]) in grams:
                hit.update(range(p, p + size))
                found.add("" if i is None else str(i))
    return len(w), hit, sorted(found)


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def leaked(spark):
    """Few words, so that windows of items stand in documents by chance, partly, repeatedly and across each other."""
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma-ray", "Δελτα", "x1", "日本", "o'clock", "End."]
    items = [(i, prose(rng, rng.choice([1, 2, 4, 9, 10, 11, 25, 60]), vocabulary)) for i in range(30)]
    items += [(100, items[7][1]), (101, None), (102, " ., "), (7, "zeta alone"), (103, " ".join([items[5][1], items[6][1]])), (None, prose(rng, 12, vocabulary))]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(30), vocabulary)]
        for _ in range(rng.randrange(4)):
            t = rng.choice(items)[1] or ""
            k = rng.randrange(len(t) + 1)
            parts += [rng.choice([t, t[k:], t[:k], t.upper()]), "unknown words between"]
        texts.append("\n".join(parts))
    return texts, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("shard", "block"), [(500_000, 4 << 20), (40, 4 << 20), (40, 600)])
def test_hits_equal_brute_force(spark, leaked, monkeypatch, shard, block):
    """Also where a document stands in several shards, and where the items travel in several blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts, items, table = leaked
    for window in (10, 3):
        got = decontaminate.contamination(docs_of(spark, texts), table, window=window, shard=shard).collect()
        assert len(got) == len(texts)
        for r in got:
            n, hit, ids = by_definition(texts[r.doc_id], items, window)
            assert (r.n_words, {k for s in r.spans for k in range(s.start, s.end)}, r["items"]) == (n, hit, ids)


def test_shards_of_any_size_give_equal_results(spark, leaked):
    texts, _, table = leaked
    one, many = (sorted((r.doc_id, str(r.spans), str([(m.start, m.words) for m in r.matches])) for r in decontaminate.contamination(docs_of(spark, texts), table, shard=s).collect()) for s in (500_000, 30))
    assert one == many


def test_longest_matches_are_verbatim_and_longest(spark, leaked):
    texts, items, table = leaked
    split = [("" if i is None else str(i), words_of(t)) for i, t in items]
    for r in decontaminate.contamination(docs_of(spark, texts[:25]), table).collect():
        w = words_of(texts[r.doc_id])
        longest = lambda p: max((next((k for k in range(min(len(v) - a, len(w) - p)) if v[a + k] != w[p + k]), min(len(v) - a, len(w) - p)) for _, v in split for a in range(len(v))), default=0)  # noqa: B023, E731
        ends = [m.start + m.words for m in r.matches]
        assert ends == sorted(set(ends))
        for m in r.matches:
            assert m.words == longest(m.start)
            assert any(i == m.item_id and v[m.item_start : m.item_start + m.words] == w[m.start : m.start + m.words] for i, v in split)


def test_suffix_arrays_are_sorted_and_know_common_prefixes(leaked):
    _, items, _ = leaked
    block = decontaminate.Items.of([(str(i), t) for i, t in items], 10)
    rng = np.random.default_rng(5)
    shard = rng.integers(0, len(block.number) + 1, 600)
    shard[100:160] = shard[200:260]
    a = decontaminate.SuffixArray(shard, block)
    text = np.concatenate([shard, [0], block.words]).tolist()
    whole = lambda p: tuple(text[p : next((k for k in range(p, len(text)) if text[k] <= 0), len(text))])
    order = [whole(p)[: block.longest] for p in a.sorted.tolist()]
    assert order == sorted(order)
    test = np.flatnonzero(block.words > 0) + a.items_at
    for p in rng.integers(0, 600, 200).tolist():
        got = a.common(np.full(len(test), p), test)
        for q, n in zip(test.tolist(), got.tolist(), strict=True):
            x, y = whole(p), whole(q)
            assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_decontamination_takes_odd_tables(spark):
    rows_ = [(i, t, [None, "en"][i % 2], None, None, *EXTRA) for i, t in enumerate(ODD)]
    odd = spark.createDataFrame([*rows_, (None, "no id at all here", None, None, None, *EXTRA), rows_[0]], DOCS)
    items = spark.createDataFrame([(1, "Word longer word", "x"), (2, LONG, "x"), (3, None, None), (None, "id at all", "y"), (1, "word longer WORD", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.text): r for r in decontaminate.contamination(odd, items).collect()}
    assert got[5, LONG]["items"] == ["1", "2"] and [(m.start, m.words) for m in got[5, LONG].matches] == [(0, 60_001)]
    assert got[None, "no id at all here"]["items"] == [""] and got[0, ODD[0]].spans == [] and got[1, None].n_words == 0
    left = decontaminate.decontaminate(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 2
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), items).count() == 0


# --- 12: fill-in-middle ----------------------------------------------------------------------------------------------


def example(i, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    n, h = len(text), [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, form, None if form == "plain" else a, None if form == "plain" else b - a, {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form])


def test_examples_equal_the_definition_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(fim, "UNITS", 300)
    rng = random.Random(1)
    pieces = ["a", "\n", "\r\n", "<", "<P", "S>", "<<S", "<M>", "é", "é", "😀", "日", "\x00", " ", " ", "🇩🇪"]
    texts = [*ODD, *("".join(rng.choice(pieces[:7] + pieces[8:] * 3) for _ in range(rng.randrange(80))) for _ in range(300)), "with <M> inside"]
    docs = docs_of(spark, [*texts, texts[0], "x"], [*range(len(texts)), 0, None])
    made = fim.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    got = fim.restore(made.select("doc_id", "text", "form", "output", *[c for c in ("n", "prefix_chars", "middle_chars")])).collect()
    assert len(got) == len(texts) + 2 and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == example(r.doc_id, r.text) and r.restored == (r.text or "")
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert fim.fill_in_middle(docs, rate=0).where("form <> 'plain' or output <> coalesce(text, '')").count() == 0
    assert fim.fill_in_middle(docs, rate=100, spm=100).where("form = 'psm'").count() == 0


# --- 13: source divergence -------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_by_definition(rows_, ranks=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows_]
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 3]

        def share(ds, kept=kept):
            c = Counter(t for d in ds for t in d[2])
            n = sum(c[t] for t in kept)
            return c, {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        groups = {s: share([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        q = share(mine)[1]
        for s, (c, p) in groups.items():
            pair = [(sum(f(p[t], groups[o][1][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[t], q[t]), t) for t in kept if c[t] and p[t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1) if k <= most]
    return sorted(out)


@pytest.mark.parametrize(("block", "slice_", "heavy", "held"), [(128, 4096, 4, 400_000), (3, 7, 4, 50), (2, 5, 1, 400_000), (4, 9, 10**6, 10)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, slice_, heavy, held):
    """With tiles of several blocks and slices, all terms light, all heavy, and both; counts handed on early."""
    for name, v in (("BLOCK", block), ("SLICE", slice_), ("HEAVY", heavy), ("HELD", held)):
        monkeypatch.setattr(divergence, name, v)
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ["x", "Y", "é", "日", "-z", "1q"]]
    rows_ = []
    for k in range(160):
        source = f"s{min(rng.randrange(12), rng.randrange(12))}" if k % 3 else "s0"
        rows_.append((" ".join(rng.choice(vocabulary[: 8 + 4 * (ord(source[1]) % 10)]) for _ in range(rng.randrange(25))), rng.choice(["en", "de"]), source))
    rows_ += [(None, "en", "null text"), ("ax ax", None, None), ("only here", "fr", "a"), (None, "fr", "b"), ("", "it", "alone"), ("Same same", "de", "s3")] * 2
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows_)], "term long, text string, lang string, source string, n long")
    got = sorted(tuple(r) for r in divergence.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audit_by_definition(rows_)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in got)


def test_divergence_ranks_and_odd_tables(spark):
    rows_ = [(f"{t} {t}", "en", s) for s, ts in (("a", ["x", "y", "z"]), ("b", ["x", "w", "v"])) for t in ts for _ in range(3)]
    docs = spark.createDataFrame(rows_, "text string, lang string, source string")
    got = divergence.source_divergence(docs, ranks=2).where("part = 'term'")
    assert sorted((r.source, r["item"], r["rank"]) for r in got.collect()) == [("a", "y", 1), ("a", "z", 2), ("b", "v", 1), ("b", "w", 2)]
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(i, t, [None, "en"][i % 2], [None, "a"][i % 2], None, *EXTRA) for i, t in enumerate([*ODD, LONG, LONG, LONG])], DOCS)
    assert divergence.source_divergence(odd).where(F.col("value") < 0).count() == 0
