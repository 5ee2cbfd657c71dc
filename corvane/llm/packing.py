"""Lexical retrieval packing: windows of related documents, found by a sharded BM25 index.

1. One pass writes every document's ids and counts the document frequency of each id, the documents and their mean length; the sums over all
   documents are the statistics of BM25 everywhere below.
2. A document's key is its two weightiest ids that other documents have too. Documents with one first id are a group; groups of more than
   ``SHARD_DOCS`` documents or ``SHARD_TOKENS`` ids are salted by the second id, and what is still too large by document; small groups
   that follow each other are one shard. So a shard holds related documents, wherever they were read, and doesn't depend on files.
3. A shard builds an inverted index over its documents' ids; a seed document (the first unused one) opens a window, the index ranks the
   shard's unused documents by BM25 against all the seed's ids, and the ranked neighbours fill the window greedily. The document that reaches
   the window's end is cut there, and the rest of it opens the next window as its seed.

A seed doesn't query other shards: neighbours that share neither key with it can stand elsewhere.

Only the last window of a shard isn't full; its pieces are cut into sequences whose lengths are powers of two, which
need no padding. So no sequence is padded at all.

Ids are those of the tokenizers library. The vocabulary lower-cases and splits texts into words, so the different words of
a few megabytes of text are looked up once each, and each worker remembers their parts' ids (within a bound); texts with
characters beyond Latin letters, with special tokens or with control characters go to the library whole.

Defined results: a null or empty text is one piece that holds the closing id alone; repeated rows are packed as rows
of their own; an empty table gives no rows. Sequence numbers are unique and the same however the table is dealt out.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, claim_cache, with_broadcast

WINDOW = 2048
#: The id that closes each document.
CLOSE = 1
SHARD_DOCS = 1_024
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: Words' parts that a worker's memo holds, about 150 bytes each; then it begins anew.
MEMO_WORDS = 500_000
#: Bytes of text whose different words are looked up at a time, and the last text beyond.
TEXT_BYTES = 4 << 20
#: Neighbours that are ranked at a time.
RANKED = 16

#: What the word memo may serve: Latin letters up to U+017F and common marks, without control characters but tab to carriage return.
_EASY = re.compile(r"[\t-\r\x20-\x7e\xa0-įı-ſ‐-‧]*")
_L, _N = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼½¾"
#: The vocabulary's own splitting pattern, with its classes spelt out for those characters.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \xa0{_L}{_N}]+")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer(dict):
    """The library's ids of whole texts as little-endian integers of the fewest bytes, with a bounded memo of the parts of what stands between white space."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if max(self.library.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        # Letters alone are one part (of easy texts), as is a mark after them; what else has several is looked up part by part.
        if not word.isalpha():
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return self[word[:-1]] + self[word[-1]]
            if (parts := _SPLIT.findall(word)) != [word]:
                return b"".join(map(self.__getitem__, parts))
        if len(self) >= MEMO_WORDS:
            self.clear()
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        out = self[word] = array(self.dtype.char, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return out

    def easy(self, text: str) -> bool:
        """Whether the memo may serve this text."""
        return bool(_EASY.fullmatch(text)) and unicodedata.is_normalized("NFC", text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A word is looked up once, however often these texts have it."""
        easy = [self.easy(t) for t in texts]
        # Nothing that the pattern finds holds white space, and of easy texts' characters Arrow lower-cases the same as the library and knows the same white space.
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t for t, ok in zip(texts, easy, strict=True) if ok], pa.large_string())))
        words = split.flatten().dictionary_encode()
        got = pa.array(list(map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary())
        got = got.take(words.indices)  # one after the other, these are the ids
        raw = got.buffers()[2]
        ids = np.frombuffer(raw or b"", self.dtype, (raw.size if raw else 0) // self.dtype.itemsize)
        at = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)[split.offsets.to_numpy()] // self.dtype.itemsize
        served = iter(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return [ids[slice(*next(served))] if ok else np.array(self.library.encode(t, add_special_tokens=False).ids, self.dtype) for t, ok in zip(texts, easy, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        return self.encode([text])[0]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(spec: str) -> WordTokenizer:
    claim_cache("packing", _TOKENIZERS.clear)
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(spec)
    return _TOKENIZERS[key]


class Corpus:
    """Document frequencies (by id), number and mean length of all documents."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.df, self.mean = df, tokens / max(1, n)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        """The two weightiest ids of each document that other documents have too, ties to the smaller; -1 where there are none."""
        out = np.full((len(docs), 2), -1, np.int64)
        held = [np.sort(d[:-1], kind="stable") for d in docs]  # without the closing id
        size = np.array([len(x) for x in held], np.int64)
        term, doc = np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(docs)), size)
        at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])][: len(term)])
        tf, term, doc = np.diff(np.r_[at, len(term)]), term[at], doc[at]
        ok = self.df[term] > 1
        tf, term, doc = tf[ok], term[ok], doc[ok]
        weight = self.idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * (size + 1) / self.mean))[doc])
        for k in range(2):
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
            best = np.maximum.reduceat(weight, first) if len(first) else weight
            at = np.flatnonzero(weight == np.repeat(best, np.diff(np.r_[first, len(doc)])))
            at = at[np.r_[True, doc[at[1:]] != doc[at[:-1]]][: len(at)]]  # terms ascend: the first is the smallest
            out[doc[at], k] = term[at]
            doc, term, weight = (np.delete(x, at) for x in (doc, term, weight))
        return out


class Index:
    """BM25 over one shard's documents, by the statistics of the corpus (of the shard if none are given); used documents are passed over."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        self.lens = np.array([len(d) for d in docs])
        mean = corpus.mean if corpus else self.lens.mean()
        norm = K1 * (1 - B + B * self.lens / max(1.0, mean))
        # One sort of (document, id) keys for the whole shard gives distinct ids and their counts.
        key = np.concatenate([d.astype(np.int64) | i << 20 for i, d in enumerate(docs)])
        key.sort()
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf = np.diff(np.r_[at, len(key)])
        doc, term = key[at] >> 20, key[at] & 0xFFFFF
        self.doc_at = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        df = np.bincount(term)
        self.shared = df > 1  # others find no other document
        idf = corpus.idf if corpus else np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], self.weight[order]
        self.post_at = np.concatenate([[0], df.cumsum()])
        # Ids of a quarter of the documents have a row of weights each (at most four times the postings); others have postings.
        heavy = np.flatnonzero((df > 1) & (df * 4 > n))
        self.row_of = np.full(len(df), -1)
        self.row_of[heavy] = np.arange(len(heavy))
        self.rows = np.zeros((len(heavy), n), np.float32)
        held = self.row_of[term] >= 0
        self.rows[self.row_of[term[held]], doc[held]] = self.weight[held]

    def neighbours(self, seed: int, used: np.ndarray, most: int | None = None) -> np.ndarray:
        """The unused documents that share a query term with the seed, best first, ties by place; if ``most`` is given, the best so many and their ties."""
        terms = self.terms[self.doc_at[seed] : self.doc_at[seed + 1]]
        row = self.row_of[terms]
        score = self.rows[row[row >= 0]].sum(0, dtype=np.float64)
        light = terms[(row < 0) & self.shared[terms]]
        first, size = self.post_at[light], self.post_at[light + 1] - self.post_at[light]
        at = np.arange(int(size.sum())) + np.repeat(first - size.cumsum() + size, size)
        score += np.bincount(self.post_doc[at], self.post_weight[at], len(used))
        score[used] = 0
        at = np.flatnonzero(score)
        if most and len(at) > most:
            at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most]]
        return at[np.argsort(-score[at], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard; sequences are numbered from 0."""
    index = Index(docs, corpus)
    used = np.zeros(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    last: list[tuple[int, int, int]] = []
    sequence, fill, first = 0, 0, 0
    seed: int | None = None
    queue: list[int] = []

    def put(doc: int, start: int) -> int:
        """Adds what fits of the document from ``start`` on; returns where its rest begins."""
        nonlocal fill
        take = min(window - fill, len(docs[doc]) - start)
        last.append((doc, start, take))
        fill += take
        return start + take

    def close() -> None:
        nonlocal sequence, fill, last
        offset = 0
        for doc, start, take in last:
            pieces.append((doc, start, take, sequence, offset))
            offset += take
        sequence, fill, last = sequence + 1, 0, []

    def ask() -> list[int]:
        """The seed's best unused neighbours, the best last."""
        return index.neighbours(seed, used, RANKED)[::-1].tolist()

    while True:
        # The next document: the seed's best unused neighbour, or else the first unused one, which asks the index anew.
        if seed is not None and not queue:
            queue = ask()
        if queue:
            doc = queue.pop()
        else:
            while first < len(docs) and used[first]:
                first += 1
            if first == len(docs):
                break
            doc, seed = first, None
        used[doc] = True
        if seed is None:
            seed = doc
        at = put(doc, 0)
        while fill == window:
            close()
            seed = None
            queue = []
            if at < len(docs[doc]):
                at = put(doc, at)  # the rest seeds the next window
                if fill < window:
                    seed = doc
    # The last window, cut at powers of two from the largest down.
    left = fill
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        offset = 0
        while offset < size:
            doc, start, take = last[0]
            cut = min(take, size - offset)
            pieces.append((doc, start, cut, sequence, offset))
            offset += cut
            last[0] = (doc, start + cut, take - cut)
            if cut == take:
                last.pop(0)
        sequence += 1
    return pieces


#: A sequence's number is its shard's, and this many bits for its place there.
SEQUENCE_BITS = 20
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, ids, digest, seen): the ids of each document with the closing one, and their digest; ``seen`` is null in these rows.

    The last row of each task holds in ``seen`` what the task saw, as 64-bit integers: ids, documents, and the documents that have id 0, 1, ...
    """
    names = ["doc_id", "ids", "digest", "seen"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tok, df, n, tokens = tokenizer(spec), np.zeros(0, np.int64), 0, 0
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(upto // TEXT_BYTES)) + 1).tolist(), b.num_rows]
            for at, end in itertools.pairwise(cuts):
                part = b.slice(at, end - at)
                if not part.num_rows:
                    continue
                ids = [np.append(x, tok.dtype.type(CLOSE)) for x in tok.encode([t or "" for t in part.column("text").to_pylist()])]
                held = [np.sort(x, kind="stable") for x in ids]
                held = np.bincount(np.concatenate([x[np.r_[True, x[1:] != x[:-1]]] for x in held]), minlength=len(df))
                held[: len(df)] += df
                df = held
                tokens += sum(map(len, ids))
                n += len(ids)
                raw = [x.tobytes() for x in ids]
                digest = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary()), pa.array(digest, pa.int64()), pa.nulls(len(raw), pa.binary())], names)
                none = part.slice(0, 1).column("doc_id").take(pa.array([None], pa.int64()))
        if n:
            yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([np.r_[tokens, n, df].astype("<i8").tobytes()], pa.binary())], names)

    return docs.mapInArrow(run, f"doc_id {kind}, ids binary, digest long, seen binary")


def corpus_of(seen: DataFrame) -> Corpus:
    """Counts over all documents; at most one row for each id of the vocabulary comes to the driver."""

    def run(batches):
        total = np.zeros(2, np.int64)
        for b in batches:
            for x in b.column("seen"):
                v = np.frombuffer(x.as_py(), "<i8")
                total = np.append(total, np.zeros(max(0, len(v) - len(total)), np.int64))
                total[: len(v)] += v
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at - 2), pa.array(total[at])], ["term", "n"])

    got = {r.term: r.n for r in seen.select("seen").where("seen is not null").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(max([*got, 0]) + 1, np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return Corpus(df, got.get(-1, 0), got.get(-2, 0))


def keyed(ids: DataFrame, corpus: Corpus, dtype: np.dtype) -> DataFrame:
    """``ids`` with the keys k1, k2 and the number of ids n."""
    kept = ids.columns

    def run(batches):
        claim_cache("packing.keys", lambda: None)  # words' ids aren't asked for any more
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                docs = [np.frombuffer(x, dtype) for x in part.column("ids").to_pylist()]
                keys = corpus.keys(docs)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(d) for d in docs], pa.int64())], [*kept, "k1", "k2", "n"])

    return ids.mapInArrow(run, ", ".join([*(f"{c} {ids.schema[c].dataType.simpleString()}" for c in kept), "k1 long", "k2 long", "n long"]))


def _parts():
    return F.greatest(F.ceil(F.sum("m") / F.lit(SHARD_DOCS)), F.ceil(F.sum("n") / F.lit(SHARD_TOKENS))).cast("long").alias("parts")


def sharded(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Keyed ``docs`` with the number of their shard, from ``sizes`` (k1, k2, documents m, ids n). Shards are numbered without gaps from 0: those of a group
    follow each other, first one for each value of the second salt, then what the third salt splits off."""
    spark = docs.sparkSession
    groups = sorted((r.k1, r.m, r.n, r.parts) for r in sizes.groupBy("k1").agg(_parts(), F.sum("m").alias("m"), F.sum("n").alias("n")).collect())  # a row an id at most
    # Small groups that follow each other share a shard.
    of, g, m, n = [], -1, 0, 0
    for k, dm, dn, parts in groups:
        if parts > 1 or g < 0 or m + dm > SHARD_DOCS or n + dn > SHARD_TOKENS:
            g, m, n = g + 1, 0, 0
        m, n = m + dm, n + dn
        of.append((k, g, parts))
    side = F.broadcast(spark.createDataFrame([(k, g, parts, 0) for k, g, parts in of], "k1 long, g long, p2 long, first long"))
    second = F.pmod(F.xxhash64(F.lit("second"), "k2"), F.col("p2")).alias("s2")
    large = sizes.join(side, "k1").where("p2 > 1").groupBy("g", second).agg(_parts()).where("parts > 1").withColumnRenamed("parts", "p3")
    before = W.partitionBy("g").orderBy("s2").rowsBetween(W.unboundedPreceding, -1)
    large = large.withColumn("extra", F.coalesce(F.sum(F.col("p3") - 1).over(before), F.lit(0)))
    split = {r.g: r.n for r in large.groupBy("g").agg(F.sum(F.col("p3") - 1).alias("n")).collect()}  # a row a group at most
    first, at = {}, 0
    for _, g, parts in of:
        if g not in first:
            first[g] = at
            at += parts + split.get(g, 0)
    side = F.broadcast(spark.createDataFrame([(k, g, parts, first[g]) for k, g, parts in of], "k1 long, g long, p2 long, first long"))
    docs = docs.join(side, "k1").withColumn("s2", second).join(with_broadcast(large), ["g", "s2"], "left")
    s3 = F.when(F.col("p3").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("third"), "doc_id", "digest"), F.col("p3"))).cast("long")
    docs = docs.withColumn("s3", s3)
    return docs.withColumn("shard", F.col("first") + F.when(F.col("s3") == 0, F.col("s2")).otherwise(F.col("p2") + F.col("extra") + F.col("s3") - 1))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids (binary, little-endian 32-bit)."""
    spec = open(path or word_bpe_path(), encoding="utf-8").read()
    scratch = Scratch(docs.sparkSession, "packing")
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = SCHEMA.format(src.schema["doc_id"].dataType.simpleString()) + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    dtype = WordTokenizer(spec).dtype
    told = scratch.keep(tokenized(src, spec), "ids")
    corpus, ids = corpus_of(told), told.where("seen is null").select("doc_id", "ids", "digest")
    keys = scratch.keep(keyed(ids, corpus, dtype), "keyed")  # documents are keyed once
    scratch.drop(told)
    sizes = scratch.keep(keys.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.sum("n").alias("n")), "sizes")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("digest", "ascending"), ("doc_id", "ascending")])
        held = [np.frombuffer(x, dtype) for x in t.column("ids").to_pylist()]
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pack_shard(held, window, corpus), strict=True))
        raw = [held[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        base = t.column("shard")[0].as_py() << SEQUENCE_BITS
        if seq.max() >> SEQUENCE_BITS:
            raise OverflowError(f"a shard of {seq.max() + 1} sequences: its numbers would run into the next shard's")
        cols = [t.column("doc_id").take(pa.array(doc)), start, length, [zlib.crc32(b) for b in raw], np.array([len(x) for x in held])[doc], seq + base, offset]
        cols = [*cols, pa.array(raw, pa.binary())] if with_ids else cols
        return pa.table(dict(zip(names, cols, strict=True)))

    dealt = sharded(keys, sizes)
    return dealt.select("doc_id", "ids", "digest", "shard").groupBy("shard").applyInArrow(run, schema)


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
