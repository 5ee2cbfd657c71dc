"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Both factors are softmaxes over hashed features, trained alike.

* A word's class comes from its ending and the marks after it: endings are clustered by which endings stand beside
  them in the training documents. Two classes are special: the end of a text, and "the word before once more".
* History is the three events before: their classes, and for the nearest one the word itself if it is among the ``UNITS`` most frequent.
  Class features are the nearest (n-grams), the nearest two, and those further back (skips).
* Within a class the ``SLOTS`` - 1 most frequent words have a slot each and the rest share one. Slots are chosen by features of the class with the nearest
  event, with its word, and with the event before that (a skip). A word of the shared slot then has its share of that slot's training
  tokens; words never seen have the mass of those seen once.
* Weights are trained on all training documents in rounds: each task starts from the current weights, takes gradient steps over its documents
  of the round as they stream by, and gives its weights, whose mean (by tokens) starts the next round. Equal histories of a piece of the stream are
  one row of a step, weighted by how often they stand there. Each document has its round by the hash of its id, at every size of table.

Texts are parsed once; what follows reads a table of 64-bit words (55 bits of hash, 9 of type). Counts are taken over every training document and
grow with it: they stay a table. Only the counts of the most frequent words, ``TOP`` at most, travel with the tasks (which also takes the hot
keys out of the join); a document's other words meet their counts in one join by word, and sums by document follow.

Defined results: a null or empty text is the end token alone; without training tokens every score is that
of an untrained model (uniform classes); rows that repeat are scored as rows of their own. A word is known by its 64 bits. A class
keeps the mass that the word before has in it, though that word would be the event "once more": probabilities sum to at most 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyTable, Scratch, claim_cache, crc_mod

#: Training rounds; a document is trained on in one of them.
ROUNDS = 4
#: Documents that a training task gets, about.
TASK_ROWS = 8_192
#: Tokens of a piece of the training stream; distinct histories of a gradient step; tokens that are scored at a time.
PIECE, BATCH, SCORED = 1 << 19, 1_024, 1 << 18
#: Weight rows of a block that is averaged as one.
BLOCK = 64
#: Most frequent words whose counts travel with the tasks, at most.
TOP = 1 << 18
TYPES, CLASSES, SLOTS, UNITS = 512, 40, 64, 256
#: Classes 0 and 1: the end of a text; the word before once more. As history, CLASSES is "before the text".
END, AGAIN = 0, 1
PAST, NEAR = CLASSES + 1, CLASSES + 1 + UNITS
#: Hashed weight rows of each factor.
ROWS = 1 << 12
MEMO_WORDS = 250_000
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


def word_token(word: bytes) -> int:
    """64 bits: a hash of the word, and in the lowest nine its type, hashed from its last two letters and the marks after them."""
    stem = word.rstrip(_MARKS)
    marks = word[len(stem) :]
    last = stem[-2:] if stem.isascii() else stem.decode("utf-8", "replace")[-2:].encode()
    return xxhash.xxh3_64_intdigest(word) & -TYPES | zlib.crc32(b"%s|%s%d" % (last, marks[:1], min(2, len(marks)))) % TYPES


END_TOKEN = word_token(b"\n")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = word_token(word)
        return got


_WORDS = _Words()


def tokens_of(text: str | None) -> np.ndarray:
    """The words of a whole text, without the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    claim_cache("lm", _WORDS.clear)
    if len(_WORDS) > MEMO_WORDS:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def tokenized(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, learn, tokens): each document's words as little-endian 64-bit numbers."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("learn"), pa.array([tokens_of(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "learn", "tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, learn boolean, tokens binary")


def pieces(batches, size: int):
    """Lists of (id or None, words) of a stream, each of about ``size`` tokens."""
    docs, n = [], 0
    for b in batches:
        ids = b.column("doc_id").to_pylist() if "doc_id" in b.schema.names else [None] * b.num_rows
        for i, x in zip(ids, b.column("tokens"), strict=True):
            docs.append((i, np.frombuffer(x.as_py(), "<u8")))
            n += len(docs[-1][1]) + 1
            if n >= size:
                yield docs
                docs, n = [], 0
    if docs:
        yield docs


def _sums(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[first], np.add.reduceat(n, first) if len(first) else n


def count_tokens(train: DataFrame) -> DataFrame:
    """(beside, h, c): the count of every training token h; and, where ``beside``, of types b after a, as h = a * TYPES + b."""

    def run(batches):
        pairs, ends = np.zeros(TYPES * TYPES, np.int64), 0
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = lambda kind, h, c: pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind)), pa.array(h.view(np.int64)), pa.array(c)], ["beside", "h", "c"])
        for docs in pieces(batches, PIECE):
            one = [x for _, x in docs]
            kinds = [(x & np.uint64(TYPES - 1)).astype(np.int64) for x in one]
            pairs += np.bincount(np.concatenate([t[:-1] * TYPES + t[1:] for t in kinds]), minlength=len(pairs))
            ends += len(one)
            got, n = np.unique(np.concatenate(one), return_counts=True)
            h, c = _sums(np.concatenate([h, got]), np.concatenate([c, n]))
            if len(h) > 1_000_000:
                yield out(False, h, c)
                h, c = h[:0], c[:0]
        if ends:
            yield out(False, np.append(h, np.uint64(END_TOKEN)), np.append(c, ends))
            at = np.flatnonzero(pairs)
            yield out(True, at, pairs[at])

    return train.select("tokens").mapInArrow(run, "beside boolean, h long, c long").groupBy("beside", "h").agg(F.sum("c").alias("c"))


def leading(x: np.ndarray, directions: int, rounds: int = 40) -> np.ndarray:
    """``x`` projected to the leading directions of its columns' space: block power iteration on ``x x'``, which has no way not to converge."""
    g = x @ x.T
    g /= max(float(np.abs(g).max()), 1e-300)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((len(g), directions)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(g @ q + 1e-12 * q)[0]
    return q @ (q.T @ x)


def cluster_types(beside: np.ndarray) -> np.ndarray:
    """Classes of word types, from how often type b follows type a: k-means on the leading directions of their positive PMI. Types without any are dealt out in turn."""
    if not np.isfinite(beside).all() or (beside < 0).any():
        raise ValueError(f"counts of neighbouring types must be finite and not negative: {np.count_nonzero(~(beside >= 0))} aren't")
    left, right = beside.sum(1), beside.sum(0)
    pmi = np.log(np.maximum(beside, 0.1) * (beside.sum() + 1) / np.outer(left + 1, right + 1))
    e = leading(np.maximum(np.hstack([pmi, pmi.T]), 0), 24)
    norm = np.linalg.norm(e, axis=1, keepdims=True)
    e = np.where(norm > 1e-9, e / np.maximum(norm, 1e-9), 0)
    weight = np.sqrt(left + right)
    centre = e[np.argsort(-weight, kind="stable")[: CLASSES - 2]]
    own = np.zeros(len(e), np.int64)
    for _ in range(20):
        own = (e @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (at := own == c).any():
                m = (e[at] * weight[at, None]).sum(0)
                centre[c] = m / (np.linalg.norm(m) + 1e-9)
    return 2 + np.where(norm[:, 0] > 1e-9, own, np.arange(len(e)) % (CLASSES - 2))


def _hashed(template: int, value: np.ndarray) -> np.ndarray:
    x = (value.astype(np.uint64) * np.uint64(16) + np.uint64(template + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _grouped(key: np.ndarray, targets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct histories, and for each of their targets: place of the history, target, count."""
    key, n = np.unique(key, return_counts=True)
    history, target = key // targets, key % targets
    new = np.r_[True, history[1:] != history[:-1]][: len(history)]
    return history[new], new.cumsum() - 1, target, n


class Factor:
    """A softmax over ``targets``: rows of weights by hashed features, and unhashed ones (biases)."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = self.bias[b]
        for c in range(f.shape[1]):
            z += self.weights[f[:, c]]
        return z

    def train(self, f: np.ndarray, b: np.ndarray, at: np.ndarray, target: np.ndarray, n: np.ndarray, g2: tuple[np.ndarray, np.ndarray], rng) -> None:
        """AdaGrad steps over distinct histories (features f, bias rows b) whose targets stand n times, in shuffled batches."""
        place = rng.permutation(len(f))
        by = np.argsort(place[at], kind="stable")
        place_of, target, n = place[at][by], target[by], n[by]
        back = np.argsort(place)
        ends = np.searchsorted(place_of, np.arange(0, len(f) + BATCH, BATCH))
        for i, s in enumerate(range(0, len(f), BATCH)):
            ix = back[s : s + BATCH]
            a, t, m = (x[ends[i] : ends[i + 1]] for x in (place_of, target, n))
            times = np.bincount(a - s, m, len(ix)).astype(np.float32)
            p = np.exp(_log_softmax(self.logits(f[ix], b[ix]))) * times[:, None]
            p[a - s, t] -= m
            for w, g, rows in ((self.bias, g2[1], b[ix]), *((self.weights, g2[0], f[ix, c]) for c in range(f.shape[1]))):
                order = np.argsort(rows, kind="stable")
                rows = rows[order]
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                grad = np.add.reduceat(p[order], first, 0) / np.sqrt(np.add.reduceat(times[order], first))[:, None]
                r = rows[first]
                g[r] += (grad * grad).mean(1)
                w[r] -= 0.05 * grad / np.sqrt(g[r])[:, None]


class Model:
    """Classes, slots and units of words; both factors' weights."""

    def __init__(self, class_of: np.ndarray, words: np.ndarray, slot: np.ndarray, unit: np.ndarray, share: np.ndarray, first: np.ndarray):
        """``words`` have the slots and units (-1: none) given; ``share[class, slot]`` and ``first[class]`` are counts that the biases start from."""
        self.class_of, self.table = class_of, KeyTable(words)
        self.slot, self.unit = np.append(slot, 0), np.append(unit, -1)
        self.class_of_near = np.r_[np.arange(PAST), np.zeros(UNITS, np.int64)]
        has = unit >= 0
        self.class_of_near[PAST + unit[has]] = class_of[(words[has] & np.uint64(TYPES - 1)).astype(np.int64)]
        f32 = lambda x: x.astype(np.float32)
        self.classes = Factor(np.zeros((ROWS, CLASSES), np.float32), f32(np.log(first + 0.5) - np.log((first + 0.5).sum()))[None])
        # A slot without a word can't be chosen.
        empty = (share <= 0) & (np.arange(SLOTS) > 0)
        self.words = Factor(np.zeros((ROWS, SLOTS), np.float32), f32(np.where(empty, -1e4, np.log(np.maximum(share, 0.5)))))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.classes.weights, self.classes.bias, self.words.weights, self.words.bias]

    def events(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of every token and the end of each text: event (class or AGAIN), slot, and the histories of both factors as numbers."""
        lens = np.array([len(x) + 1 for x in docs])
        ends = lens.cumsum()
        tok = np.full(int(ends[-1]), END_TOKEN, np.uint64)
        inner = np.ones(len(tok), bool)
        inner[ends - 1] = False
        tok[inner] = np.concatenate(docs)
        within = np.arange(len(tok)) - np.repeat(ends - lens, lens)
        k = self.class_of[(tok & np.uint64(TYPES - 1)).astype(np.int64)]
        k[1:][(tok[1:] == tok[:-1]) & (within[1:] > 0)] = AGAIN
        k[ends - 1] = END
        place = self.table.find(tok)
        unit = self.unit[place]
        near = np.where((unit >= 0) & (k > AGAIN), PAST + unit, k)

        def back(x, d):
            out = np.full(len(x), CLASSES)
            out[d:] = x[: len(x) - d] if d < len(x) else x[:0]
            out[within < d] = CLASSES
            return out

        near, p2, p3 = back(near, 1), back(k, 2), back(k, 3)
        return k, self.slot[place], (near * PAST + p2) * PAST + p3, (k * NEAR + near) * PAST + p2

    def class_features(self, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, p2, p3 = history // (PAST * PAST), history // PAST % PAST, history % PAST
        p1 = self.class_of_near[near]
        return np.stack([_hashed(t, x) for t, x in enumerate((p1, near, p1 * PAST + p2, p2, p3))], 1), np.zeros(len(history), np.int64)

    def word_features(self, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, near, p2 = history // (PAST * NEAR), history // PAST % NEAR, history % PAST
        return np.stack([_hashed(t, x) for t, x in enumerate((k * PAST + self.class_of_near[near], k * NEAR + near, k * PAST + p2))], 1), k

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 of every token's two factors, and its event and slot. The second factor is that of its slot."""
        k, slot, ch, wh = self.events(docs)
        out = []
        for factor, features, history, target, size in ((self.classes, self.class_features, ch, k, CLASSES), (self.words, self.word_features, wh, slot, SLOTS)):
            key, back = np.unique((history * size + target).astype(np.int32), return_inverse=True)
            distinct, at = np.unique(key // size, return_inverse=True)
            value = np.empty(len(key), np.float32)
            ends = np.searchsorted(at, np.arange(0, len(distinct) + BATCH, BATCH))
            for i, s in enumerate(range(0, len(distinct), BATCH)):
                z = _log_softmax(factor.logits(*features(distinct[s : s + BATCH].astype(np.int64))))
                part = slice(ends[i], ends[i + 1])
                value[part] = z[at[part] - s, key[part] % size]
            out.append(value[back] / np.log(10))
        out[1][k < 2] = 0
        return out[0], out[1], k, slot

    def train(self, docs: list[np.ndarray], g2: list, seed: int) -> None:
        """One pass of gradient steps over documents; step sizes go on from earlier passes of the task."""
        rng = np.random.default_rng(seed)
        k, slot, ch, wh = self.events(docs)
        at = k > AGAIN
        for factor, features, key, size, g in ((self.classes, self.class_features, ch * CLASSES + k, CLASSES, g2[0]), (self.words, self.word_features, (wh * SLOTS + slot)[at], SLOTS, g2[1])):
            history, place, target, n = _grouped(key.astype(np.int32), size)
            if len(history):
                factor.train(*features(history.astype(np.int64)), place, target, n, g, rng)

    def step_sizes(self) -> list:
        return [tuple(np.full(len(w), 1e-3, np.float32) for w in (f.weights, f.bias)) for f in (self.classes, self.words)]


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most TOP, and their counts: all words from a count on."""
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    words, least = 0, None
    for r in sorted(counts.groupBy(bin_of.alias("bin")).count().collect(), reverse=True):  # sixteen bins for a doubling of the count
        words += r["count"]
        if words > TOP:
            break
        least = r.bin
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    got = counts.where(bin_of >= least).select("h", "c").toArrow()
    h, c = np.asarray(got.column("h")).view(np.uint64), np.asarray(got.column("c")).astype(float)
    order = np.lexsort((h, -c))
    return h[order], c[order]


class Statistics:
    """What the counts say: totals, class totals, the most frequent words."""

    def __init__(self, counts: DataFrame):
        pairs = counts.where("beside").select("h", "c").toArrow()  # at most TYPES**2 rows
        beside = np.zeros(TYPES * TYPES)
        beside[np.asarray(pairs.column("h"))] = np.asarray(pairs.column("c"))
        self.class_of = cluster_types(beside.reshape(TYPES, TYPES))
        self.counts = counts = counts.where("not beside").select("h", "c")
        end = F.col("h") == F.lit(int(np.uint64(END_TOKEN).view(np.int64)))
        kind = F.when(end, -1).otherwise(F.col("h").bitwiseAND(TYPES - 1)).alias("type")
        self.n, self.ones, self.distinct = np.zeros(CLASSES), np.zeros(CLASSES), 0
        for r in counts.groupBy(kind).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("ones")).collect():  # types, not words
            k = END if r.type < 0 else self.class_of[r.type]
            self.n[k] += r.n
            self.ones[k] += r.ones if k != END else 0
            self.distinct += r.v
        self.total = int(self.n.sum())
        self.z = self.total + 0.1 * (self.distinct + 1)
        self.top, self.top_c = frequent(counts)

    def model(self) -> tuple[Model, np.ndarray, np.ndarray]:
        """The untrained model; each class's training tokens that have no slot; the mass of words never seen in them."""
        end = self.top == np.uint64(END_TOKEN)
        words, c = self.top[~end], self.top_c[~end]
        k = self.class_of[(words & np.uint64(TYPES - 1)).astype(np.int64)]
        order = np.argsort(k, kind="stable")
        first = np.searchsorted(k[order], np.arange(CLASSES))
        rank = np.empty(len(k), np.int64)
        rank[order] = np.arange(len(k)) - first[k[order]]
        slot, unit = np.where(rank < SLOTS - 1, rank + 1, 0), np.where(np.arange(len(words)) < UNITS, np.arange(len(words)), -1)
        share = np.zeros((CLASSES, SLOTS))
        np.add.at(share, (k, slot), c)
        share[:, 0] = self.n - share[:, 1:].sum(1)
        held = (slot > 0) | (unit >= 0)
        rest = share[:, 0]
        once = self.ones - np.bincount(k[(slot > 0) & (c == 1)], minlength=CLASSES)
        fresh = np.where(rest > 0, np.clip((once + 0.5) / (rest + 1), 1e-9, 0.9), 1.0)
        return Model(self.class_of, words[held], slot[held], unit[held], share, self.n if self.total else np.ones(CLASSES)), rest, fresh


def fit(model: Model, train: DataFrame, total: int) -> Model:
    """``model`` with weights from all training documents (doc_id, tokens)."""
    tasks = max(1, -(-total // TASK_ROWS))
    dealt = train.coalesce(tasks)
    salts = int(np.ceil(np.sqrt(tasks)))
    for r in range(ROUNDS):

        def steps(batches, r=r):
            # Weights as the round found them; a task's own steps stay its own.
            g2, seen, m = model.step_sizes(), 0, model
            for docs in pieces(batches, PIECE):
                m.train([x for _, x in docs], g2, r)
                seen += sum(len(x) + 1 for _, x in docs)
            if seen:
                flat = [x.reshape(-1) for w in m.weights for x in np.array_split(w, max(1, len(w) // BLOCK))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(np.full(len(flat), TaskContext.get().partitionId() % salts), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array(np.full(len(flat), seen))], ["block", "salt", "w", "n"])

        def mean(t: pa.Table) -> pa.Table:
            n = np.asarray(t.column("n"))
            w = np.zeros(len(t.column("w")[0].as_py()) // 4)
            for x, m in zip(t.column("w"), n, strict=True):
                w += np.frombuffer(x.as_py(), np.float32) * (m / n.sum())
            return pa.table({"block": t.column("block")[:1], "salt": t.column("salt")[:1], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "n": pa.array([int(n.sum())])})

        of_round = dealt.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)) == r)
        out = "block int, salt int, w binary, n long"
        met = of_round.select("tokens").mapInArrow(steps, out)
        if salts > 4:  # many tasks' weights meet in two steps
            met = met.groupBy("block", "salt").applyInArrow(mean, out)
        got = {x.block: x.w for x in met.groupBy("block").applyInArrow(mean, out).collect()}  # the weights: of fixed size, however many tasks there are
        at = 0
        for w in model.weights:
            for x in np.array_split(w, max(1, len(w) // BLOCK)):
                if at in got:
                    x[:] = np.frombuffer(got[at], np.float32).reshape(x.shape)
                at += 1
    return model


def score_documents(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` under a model learnt from those that ``learn`` names (all)."""
    scratch = Scratch(docs.sparkSession, "lm")
    table = scratch.keep(tokenized(docs, F.lit(True) if learn is None else learn), "tokens")
    train = table.where("learn").select("doc_id", "tokens")
    stats = Statistics(scratch.keep(count_tokens(train), "counts"))
    model, rest, fresh = stats.model()
    if stats.total:
        fit(model, train, int(stats.n[END]))
    by = np.argsort(stats.top)
    top_h, top_c = stats.top[by], stats.top_c[by]
    z, end_c = stats.z, stats.n[END]
    in_rest = np.log10(np.maximum(1 - fresh, 1e-300) / np.maximum(rest, 1))  # of a word's share of its class's shared slot, without its count

    def run(batches):
        part, row = TaskContext.get().partitionId() << 33, 0
        for told in pieces(batches, SCORED):
            ids, docs = [i for i, _ in told], [x for _, x in told]
            n, sizes = len(docs), np.array([len(x) + 1 for x in docs])
            of_class, of_slot, k, slot = model.score(docs)
            doc = np.repeat(np.arange(n), sizes)
            score = np.bincount(doc, of_class.astype(float) + of_slot, n)
            inner = np.ones(len(doc), bool)
            inner[sizes.cumsum() - 1] = False
            # Distinct words of each document: how often they stand there, and how often not right after themselves.
            doc, h, k, slot = doc[inner], np.concatenate(docs), k[inner], slot[inner]
            order = np.concatenate([np.argsort(x) + a for x, a in zip(docs, np.r_[0, (sizes - 1).cumsum()[:-1]], strict=True)]) if n else doc
            h, doc, new, slot = h[order], doc[order], k[order] != AGAIN, slot[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[first, len(h)])
            nr = np.add.reduceat(new.astype(np.int64), first) if len(first) else tf
            h, doc, slot = h[first], doc[first], slot[first]
            kind = model.class_of[(h & np.uint64(TYPES - 1)).astype(np.int64)]
            place = np.minimum(np.searchsorted(top_h, h), max(0, len(top_h) - 1))
            hit = top_h[place] == h if len(top_h) else np.zeros(len(h), bool)
            c, d = top_c[place[hit]], doc[hit]
            base = np.bincount(d, tf[hit] * np.log10((c + 0.1) / z), n) + np.log10((end_c + 0.1) / z)
            score += np.bincount(d, nr[hit] * np.where(slot[hit] > 0, 0, in_rest[kind[hit]] + np.log10(c)), n)
            known = np.bincount(d, tf[hit], n).astype(np.int64) + int(end_c > 0)
            rare = ~hit
            m = int(rare.sum())
            rows = part + row + np.arange(n)
            row += n
            mixed = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            pad = lambda a, t: pa.concat_arrays([pa.array(a, t), pa.nulls(m, t)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[doc[rare]]])), pa.array(np.concatenate([mixed, h[rare]]).view(np.int64)),
                    pa.array(np.concatenate([sizes << 27 | known, 1 << 62 | kind[rare].astype(np.int64) << 54 | tf[rare] << 27 | nr[rare]])),
                    pad(ids, pa.int64()), pad(base, pa.float64()), pad(score, pa.float64()),
                ], ["row", "h", "x", "doc_id", "base", "score"],
            )

    rows = table.select("doc_id", "tokens").mapInArrow(run, "row long, h long, x long, doc_id long, base double, score double")
    # A row tells of a document, or (bit 62) of one of its words; a hot word is among the most frequent and never here, so the join's keys are rare ones.
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    word = F.col("x") >= F.lit(1 << 62)
    k = F.shiftright("x", 54).bitwiseAND(255).cast("int")
    high, low = F.shiftright("x", 27).bitwiseAND((1 << 27) - 1), F.col("x").bitwiseAND((1 << 27) - 1)
    of_kind = lambda a: F.element_at(F.array(*[F.lit(float(v)) for v in a]), k + 1)
    share = F.when(c > 0, of_kind(in_rest) + F.log10(F.greatest(c, F.lit(1.0)))).otherwise(of_kind(np.log10(fresh)))
    met = rows.join(stats.counts, "h", "left").select(
        "row", "doc_id", F.when(~word, high).alias("n_tokens"), F.when(~word, low).when(c > 0, high).otherwise(0).alias("known"),
        F.when(~word, F.col("base")).otherwise(high * F.log10((c + 0.1) / z)).alias("base"), F.when(~word, F.col("score")).when(low > 0, low * share).otherwise(0.0).alias("score"),
    )
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(stats.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, crc_mod("doc_id", 10) != 0)
    return out.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
