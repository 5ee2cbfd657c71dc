"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (a SentencePiece model, read on the
driver). A word's likelihood is the sum over all its segmentations into pieces, by a forward pass over its lattice; a
text's is the product over its words, whatever their segmentation. The probabilities come from two rounds of
expected counts (forward-backward) over the words of a bounded hash sample of training documents; what reaches the
driver is one number for each piece and language.

Words are lower-cased and split at white space, and never cut: the forward pass carries its state over words of any length, scaled as it goes
(learning alone reads a word over ``LEARN_CHARS`` characters as several). A character without a piece is a piece of its own kind, "unknown".

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text when nothing
was learned; equal likelihoods go to the first language by name. More than ``LANGUAGES`` languages are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyTable, Scratch, claim_cache, crc_mod, filter_rows, hash_sample, map_batches

#: Training documents that are read for fitting, at most about.
SAMPLE_ROWS = 8_000
ROUNDS = 2
LANGUAGES = 1_000
LEARN_CHARS = 1 << 16
#: Characters of a word that are searched for pieces at a time, numbers of a table of forward states, and positions that need no scaling.
SEGMENT, CELLS, UNSCALED = 1 << 14, 1 << 22, 24
#: Where states fall below 2**-LOW they are scaled by 2**LOW; that is looked for every so many positions.
LOW, LOOK = 200, 8
#: Added to each piece's expected count.
PRIOR = 0.05
MEMO_WORDS = 250_000
_LETTER = regex.compile(r"\p{L}")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str | None = None) -> list[str]:
    """The vocabulary's ordinary pieces, lower-cased, without repeats; the mark of a word's start is U+2581."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return list(dict.fromkeys(p for i in ids if (p := sp.id_to_piece(i).lower())))


class Lattice:
    """All segmentations of many words at once. Pieces are numbered as listed; the number after the last means unknown."""

    STEP = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.table = KeyTable(np.array([self._hash(p) for p in pieces], np.uint64))

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.STEP) + ord(c) + 1) & (1 << 64) - 1
        return h

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every arc, ordered by end. Substrings of one length are hashed and looked up together."""
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        lens = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lens)
        start = np.arange(len(c)) - np.repeat(lens.cumsum() - lens, lens)
        room = np.repeat(lens, lens) - start
        at, h = np.arange(len(c)), c
        piece = self.table.find(h)
        found = [(at, np.ones(len(c), np.int64), np.where(piece < 0, self.unknown, piece))]
        for n in range(2, self.longest + 1):
            ok = room[at] >= n
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * self.STEP + c[at + n - 1]
            piece = self.table.find(h)
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), n), piece[hit]))
        at, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        end = start[at] + size
        order = self._by(end)
        at, end = at[order], end[order]
        return word[at], start[at], end, piece[order].astype(np.int64)

    @staticmethod
    def _by(end: np.ndarray) -> np.ndarray:
        most = int(end.max(initial=0))
        return np.argsort(end.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64), kind="stable")

    def sweep(self, arcs: tuple[np.ndarray, ...], prob: np.ndarray, top: int, words: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(state, turns): state[position, word, language] * 2**(-LOW * turns) is the summed probability of all ways there; turns is None for 0.

        ``first`` [positions, word, language] are states that are known already, from position 0 on (1 at position 0).
        """
        word, start, end, piece = arcs
        first = np.ones((1, words, prob.shape[1])) if first is None else first
        known = len(first)
        state = np.zeros((top + 1, words, prob.shape[1]))
        state[:known] = first
        turns = np.zeros(state.shape, np.int32) if top > UNSCALED else None
        bounds = np.searchsorted(end, np.arange(known, top + 2))
        for i, e in enumerate(range(known, top + 1)):
            a, b = bounds[i], bounds[i + 1]
            add = state[start[a:b], word[a:b]] * prob[piece[a:b]]
            if words == 1:
                state[e, 0] = add.sum(0)
            else:
                for c in range(prob.shape[1]):
                    state[e, :, c] = np.bincount(word[a:b], add[:, c], words)
            if turns is not None:
                turns[e] = turns[e - 1]
                if e % LOOK == 0:
                    # Every state that a later arc starts from is among the last ``longest``; they share their turns.
                    last = slice(max(0, e - self.longest + 1), e + 1)
                    most = state[last].max(0)
                    low = (most > 0) & (most < 2.0**-LOW)
                    if low.any():
                        state[last] *= np.where(low, 2.0**LOW, 1.0)
                        turns[last] += low
        return state, turns

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """The states of short words: the summed probability of all ways to each position."""
        return self.sweep(self.arcs(words), prob, max(map(len, words), default=0), len(words))[0]

    def log_likelihood(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations of each word, for each language."""
        lens = np.array([len(w) for w in words], np.int64)
        out = np.empty((len(words), prob.shape[1]))
        order = np.argsort(lens, kind="stable")
        i = 0
        while i < len(order):
            if lens[order[i]] > SEGMENT:
                out[order[i]] = self._long(words[order[i]], prob)
                i += 1
                continue
            left = order[i:][lens[order[i:]] <= SEGMENT]
            take = max(1, int(np.searchsorted(np.arange(1, len(left) + 1) * (lens[left] + 1) * prob.shape[1], CELLS, "right")))
            at = left[:take]
            part = [words[x] for x in at]
            state, turns = self.sweep(self.arcs(part), prob, int(lens[at].max()), take)
            z = np.log(np.maximum(state[lens[at], np.arange(take)], 1e-300))
            out[at] = z if turns is None else z - turns[lens[at], np.arange(take)] * (LOW * np.log(2))
            i += take
        return out

    def _long(self, word: str, prob: np.ndarray) -> np.ndarray:
        """As above for one long word, in segments: each starts from the last states of the one before."""
        first, log = np.ones((1, 1, prob.shape[1])), np.zeros(prob.shape[1])
        for a in range(0, len(word), SEGMENT):
            part = word[a - (len(first) - 1) : a + SEGMENT]
            state, turns = self.sweep(self.arcs([part]), prob, len(part), 1, first)
            log -= turns[-1, 0] * (LOW * np.log(2)) if turns is not None else 0.0
            first = state[-self.longest :]
            if turns is not None:  # states of the last positions share their turns only from the last look on
                first = first * 2.0 ** (-LOW * (turns[-self.longest :] - turns[-1]).astype(float))
            most = first.max(0)
            log += np.log(most[0])
            first = first / most
        return log + np.log(np.maximum(first[-1, 0], 1e-300))

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected counts [piece, language] of all segmentations of words that stand counts[word, language] times."""
        lens = np.array([len(w) for w in words])
        word, start, end, piece = arcs = self.arcs(words)
        top, own = int(lens.max(initial=0)), np.arange(len(words))
        alpha, up = self.sweep(arcs, prob, top, len(words))
        # From the words' ends the same sweep gives the summed probability of all ways to the end.
        back = word, lens[word] - end, lens[word] - start, piece
        order = self._by(back[2])
        beta, down = self.sweep(tuple(x[order] for x in back), prob, top, len(words))
        left, right, whole = alpha[start, word], beta[lens[word] - end, word], np.maximum(alpha[lens, own], 1e-300)
        share = left * prob[piece] * (right / whole[word])
        if up is not None:
            share *= 2.0 ** (LOW * (up[lens, own][word] - up[start, word] - down[lens[word] - end, word]).astype(float))
        share *= counts[word]
        return np.stack([np.bincount(piece, share[:, c], len(prob)) for c in range(prob.shape[1])], 1)


def words_of(text: str | None) -> list[str]:
    return ["\u2581" + w for w in (text or "").lower().split()]


def cut(words: list[str]) -> list[str]:
    """For learning alone: words in parts of at most ``LEARN_CHARS`` characters."""
    return [w[i : i + LEARN_CHARS] for w in words for i in range(0, len(w), LEARN_CHARS)] if words and max(map(len, words)) > LEARN_CHARS else words


class Model:
    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray, log_prior: np.ndarray):
        self.pieces, self.langs, self.prob, self.log_prior = pieces, langs, prob, log_prior
        self.key = hashlib.sha256(prob.tobytes() + "\0".join(langs).encode()).hexdigest()


class _Scorer:
    """A worker's table of word likelihoods, within a bound."""

    def __init__(self, m: Model):
        self.m, self.lattice = m, Lattice(m.pieces)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(self.m.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.at) > MEMO_WORDS:
            self.clear()
        docs = [words_of(t) for t in texts]
        new = list({w for d in docs for w in d if w not in self.at})
        while len(self.at) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            n = len(self.at)
            self.rows[n : n + len(part)] = self.lattice.log_likelihood(part, self.m.prob)
            self.at.update(zip(part, range(n, n + len(part)), strict=True))
        langs, scores = [], []
        for t, d in zip(texts, docs, strict=True):
            if not d or not self.m.langs or not _LETTER.search(t):
                langs.append("und")
                scores.append(0.0)
                continue
            z = self.rows[np.fromiter(map(self.at.__getitem__, d), np.int64, len(d))].sum(0, dtype=np.float64) + self.m.log_prior
            best = int(z.argmax())
            langs.append(self.m.langs[best])
            scores.append(float(1 / np.exp(np.minimum(z - z[best], 0)).sum()))
        return langs, scores


_SCORERS: dict[str, _Scorer] = {}


def scorer(m: Model) -> _Scorer:
    claim_cache("langid", _SCORERS.clear)
    if m.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[m.key] = _Scorer(m)
    return _SCORERS[m.key]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, path: str | None = None) -> Model:
    """Learns from text and non-null lang of documents outside the held-out fold."""
    spark = docs.sparkSession
    pieces = read_pieces(path)
    there = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 5) != 0))
    prior = {r.lang: r["count"] for r in there.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()}  # languages, not rows
    if len(prior) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = list(prior)
    if not langs:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    sample = hash_sample(there.select("doc_id", "lang", "text"), "doc_id", sample_rows, sum(prior.values()))
    index = {x: i for i, x in enumerate(langs)}

    def words(batches):
        from collections import Counter

        n: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                k = index.get(lang)
                if k is not None:
                    n.update((w, k) for w in cut(words_of(text)))
            if len(n) > 200_000:
                yield _pairs(n)
                n.clear()
        yield _pairs(n)

    scratch = Scratch(spark, "langid")
    counted = sample.mapInArrow(words, "word string, k int, n long").groupBy("word").agg(F.collect_list(F.struct("k", "n")).alias("ks"))
    counted = scratch.keep(counted, "words")
    prob = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    for _ in range(ROUNDS):

        def e_step(batches, prob=prob):
            lattice = Lattice(pieces)
            total = np.zeros(prob.shape)
            for b in batches:
                ws, ks = b.column("word").to_pylist(), b.column("ks").to_pylist()
                order = sorted(range(len(ws)), key=lambda i: len(ws[i]))
                while order:
                    # The longest words first, as many as their states' table may hold.
                    size = max(1, min(4096, CELLS // ((len(ws[order[-1]]) + 1) * prob.shape[1])))
                    part, order = order[-size:], order[:-size]
                    c = np.zeros((len(part), prob.shape[1]))
                    for row, i in enumerate(part):
                        for x in ks[i]:
                            c[row, x["k"]] += x["n"]
                    total += lattice.expected([ws[i] for i in part], c, prob)
            p, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(total[p, k])], ["piece", "k", "n"])

        got = counted.mapInArrow(e_step, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(prob.shape, PRIOR)
        total[got.piece, got.k] += got.n
        prob = total / total.sum(0)
    scratch.drop(counted)
    return Model(pieces, langs, prob, np.log(np.array(list(prior.values()), float) / sum(prior.values())))


def _pairs(n: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([k for _, k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["word", "k", "n"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone. No shuffle."""

    def f(x: dict) -> dict:
        langs, scores = scorer(model).predict(x["text"])
        return {"doc_id": x["doc_id"], "lang_pred": langs, "score": scores}

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(src, f, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", rows=500)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least this score; ``und`` goes. Columns stay as they are."""

    def f(texts: list) -> list[bool]:
        langs, scores = scorer(model).predict(texts)
        return [x != "und" and s >= least for x, s in zip(langs, scores, strict=True)]

    return filter_rows(docs, ["text"], f, rows=200)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
