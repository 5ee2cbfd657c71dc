"""Benchmark decontamination by training suffix arrays.

1. The benchmark's words are numbered in byte order. A task lays the documents it reads out as *shards* of about ``SHARD`` words, each word as its
   number, 0 where no item has it, and sorts the shard's suffixes into a suffix array: first by as many words as fit into 64 bits, then by
   prefix doubling within what is still equal, until no order deeper than the longest item is open. The ranks of every doubling step are kept: they
   give the common prefix of any two suffixes in as many steps. A suffix whose first words aren't all words of the benchmark can't begin with
   a window and is left out of the array.
2. Every test suffix is binary-searched in the array of every shard, all suffixes of a shard at once. The suffixes that begin with a window
   (the first ``window`` words of a test suffix, or the whole item if it has fewer) are one range of the array: their places are the window's
   occurrences. The longest match at a place is its common prefix with its neighbour among the test suffixes, which also says where in which item.
3. Hit words, longest matches and items are put together per document in the task that read it. Nothing is shuffled, a task may be run again,
   and ``decontaminate`` drops the affected documents.

The benchmark travels with the tasks in blocks of at most ``BLOCK_BYTES``, measured; with several, documents pass one block after the other in
the same job and carry along what was found. A task holds one shard (about 100 bytes a word) and one block. A document longer than a shard
stands in several, which overlap by the longest item.

Defined results: words are longest runs of digits, letters and non-ASCII characters, A-Z lower-cased; null or wordless texts are clean; null or wordless items have no
window; items that share an id are one item of several texts; an item without an id has the empty id; repeated rows are judged each by itself;
extra columns stay as they are, whatever their names; without documents there are no rows, and without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
SHARD = 500_000
BLOCK_BYTES = 4 << 20
#: Bytes of text that are split into words at once.
PIECE = 1 << 20

_UPPER = range(ord("A"), ord("Z") + 1)
#: Bytes to themselves in lower case where a word may have them, else to a blank: what is not ASCII is part of words.
_WORD_BYTES = bytes(b + 32 if b in _UPPER else b if b >= 128 or ord("a") <= b <= ord("z") or ord("0") <= b <= ord("9") else 32 for b in range(256))


def split_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, some at a time."""
    text, at = text.translate(_WORD_BYTES), 0
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


@dataclass
class Items:
    """One block of the benchmark: numbered words, and all items one after the other, each ended by -1."""

    number: dict[bytes, int]
    words: np.ndarray  #: int64 numbers from 1, -1 after each item
    left: np.ndarray  #: at each word: words to its item's end, itself included; 0 at ends
    item: np.ndarray  #: at each word: which item
    start: np.ndarray  #: by item: where it begins
    ids: list[str]  #: by item
    window: int

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]], window: int) -> Items:
        split = [(i, [w for part in split_words((t or "").encode("utf-8", "replace")) for w in part]) for i, t in rows]
        split = [(i, w) for i, w in split if w]
        number = {w: n for n, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        words = np.array([n for _, ws in split for n in (*map(number.__getitem__, ws), -1)], np.int64)
        size = np.array([len(w) + 1 for _, w in split], np.int64)
        start = size.cumsum() - size
        item = np.repeat(np.arange(len(split)), size)
        return cls(number, words, np.repeat(start + size - 1, size) - np.arange(len(words)), item, start, [i for i, _ in split], window)

    @property
    def longest(self) -> int:
        return int(self.left.max(initial=0))

    @property
    def least(self) -> int:
        """Words of the shortest window."""
        return int(min(self.window, self.left[self.start].min())) if len(self.start) else self.window


class SuffixArray:
    """Suffixes of a shard and of the items in one order: those of the shard that may begin with a window, and all of the items.

    ``ranks[k]`` numbers the suffixes by their first ``span * 2**k`` words: equal numbers mean equal words as far as an item has them, in which a word
    that no item has counts as an end. What can't match has a number of its own below 0.
    """

    def __init__(self, shard: np.ndarray, items: Items):
        n, depth = len(shard), items.longest
        text = np.concatenate([shard, [0], items.words])
        self.items_at = n + 1
        self.total = len(text)
        bits = max(1, len(items.number).bit_length())
        self.span = max(1, min(62 // bits, depth))
        known = np.concatenate([text, np.zeros(self.span, np.int64)])
        key = np.zeros(self.total, np.int64)
        whole = np.ones(self.total, bool)
        for i in range(self.span):
            part = known[i : i + self.total]
            key = key << bits | np.maximum(part, 0)
            whole &= part > 0
            if i + 1 == min(self.span, items.least):
                member = whole.copy()
        member[self.items_at :] = items.words > 0
        order = np.flatnonzero(member)
        by = np.argsort(key[order], kind="stable")
        order = order[by]
        sorted_key = key[order]
        self.sorted = order
        place = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(order) else np.zeros(0, np.int64)
        first = np.repeat(place, np.diff(np.append(place, len(order))))
        rank = -1 - np.arange(self.total)
        rank[order] = first
        self.ranks = [rank]
        self.key, self.bits = key, bits
        self.left = np.concatenate([np.zeros(n + 1, np.int64), items.left])
        reach = self.span
        open_ = np.flatnonzero(np.diff(np.append(place, len(order))) > 1)
        lo, size = place[open_], np.diff(np.append(place, len(order)))[open_]
        while reach < depth and len(lo):
            rank = self.ranks[-1]
            at = np.repeat(lo - (size.cumsum() - size), size) + np.arange(int(size.sum()))  # places of what is still equal
            group = np.repeat(np.arange(len(lo)), size)
            pos = self.sorted[at]
            ahead = pos + reach
            # A suffix that isn't whole has ended or left the benchmark's words inside its key: nothing follows that counts.
            follow = np.where(whole[pos] & (ahead < self.total), rank[np.minimum(ahead, self.total - 1)], -1 - pos)
            by = np.lexsort((follow, group))
            self.sorted[at] = pos = pos[by]
            follow = follow[by]
            new = np.concatenate([[True], (follow[1:] != follow[:-1]) | (group[1:] != group[:-1])])
            start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            rank = rank.copy()
            rank[pos] = start
            self.ranks.append(rank)
            place = np.flatnonzero(new)
            count = np.diff(np.append(place, len(at)))
            lo, size = at[place[count > 1]], count[count > 1]
            reach *= 2
        self.final = self.ranks[-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and those of items at ``b`` begin with in common."""
        got, top = np.zeros(len(a), np.int64), self.total - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = np.minimum(a + got, top), np.minimum(b + got, top)
            got += np.where((self.left[y] >= self.span << k) & (self.ranks[k][x] == self.ranks[k][y]), self.span << k, 0)
        # What is left is less than a key: its leading equal words.
        x, y = self.key[np.minimum(a + got, top)], self.key[np.minimum(b + got, top)]
        going, word = np.ones(len(a), bool), (1 << self.bits) - 1
        for i in range(self.span):
            shift = (self.span - 1 - i) * self.bits
            going &= ((x ^ y) >> shift == 0) & (y >> shift & word > 0)
            got += going
        return got


def _edge(inside: np.ndarray, outside: np.ndarray, holds) -> np.ndarray:
    """The last place from ``inside``, where ``holds``, towards ``outside``, where it doesn't; binary search for all at once."""
    while (wide := np.abs(outside - inside) > 1).any():
        mid = np.where(wide, (inside + outside) // 2, inside)
        ok = holds(mid)
        inside, outside = np.where(ok, mid, inside), np.where(ok, outside, mid)
    return inside


def search(shard: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard of the items' windows.

    Returns (place, words, item) of the occurrences (an item once for each window text it has there) and (place, longest, at) of the different
    places: the most words that any item has in common from there on, and where in the items' words.
    """
    none = np.zeros(0, np.int64)
    a = SuffixArray(shard, items)
    train, test = a.sorted[a.sorted < len(shard)], a.sorted[a.sorted > len(shard)]
    if not len(train) or not len(test):
        return (none,) * 6
    first = test - a.items_at
    left = items.left[first]
    words = np.where((items.start[items.item[first]] == first) | (left >= items.window), np.minimum(left, items.window), 0)
    test, words = test[words > 0], words[words > 0]
    rank = a.final[train]
    at = np.searchsorted(rank, a.final[test])
    # The suffixes that begin with a window lie around its own place in the order.
    below, above = np.maximum(at - 1, 0), np.minimum(at, len(train) - 1)
    holds_below, holds_above = a.common(train[below], test) >= words, a.common(train[above], test) >= words
    found = holds_below | holds_above
    test, words, inside = test[found], words[found], np.where(holds_above, above, below)[found]
    holds = lambda place: a.common(train[place], test) >= words
    # Places beyond the array's ends never hold and are never asked: the search stays between inside and outside.
    lo, hi = _edge(inside, np.full(len(test), -1), holds), _edge(inside, np.full(len(test), len(train)), holds) + 1
    window, which = np.unique(np.stack([lo, hi, words]), axis=1, return_inverse=True)
    lo, hi, words = window
    size = hi - lo
    place = train[np.arange(int(size.sum())) - np.repeat(size.cumsum() - size - lo, size)]
    occurs = np.repeat(np.arange(len(size)), size)
    # Windows to items, each once.
    owner = np.unique(np.stack([which.reshape(-1), items.item[test - a.items_at]]), axis=1)
    begin = np.searchsorted(owner[0], np.arange(len(size) + 1))

    starts = np.unique(place)
    order = a.sorted[a.sorted > len(shard)]
    near = np.searchsorted(a.final[order], a.final[starts])
    one, two = order[np.maximum(near - 1, 0)], order[np.minimum(near, len(order) - 1)]
    m1, m2 = a.common(starts, one), a.common(starts, two)
    return place, words[occurs], (occurs, begin, owner[1]), starts, np.maximum(m1, m2), np.where(m1 > m2, one, two) - a.items_at


class Found:
    """What was found in one document: hit words as (first, end), longest matches as (first, words, item, first word in it), items."""

    __slots__ = ("items", "matches", "spans")

    def __init__(self, spans: list = (), matches: list = (), items: list = ()):
        self.spans, self.matches, self.items = list(spans), list(matches), set(items)

    def tidy(self) -> Found:
        """Spans joined up, and no match inside another."""
        spans: list[list[int]] = []
        for lo, hi in sorted(self.spans):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        matches, end = [], -1
        for m in sorted(self.matches, key=lambda m: (m[0], -m[1], m[2], m[3])):
            if m[0] + m[1] > end:
                matches.append(m)
                end = m[0] + m[1]
        return Found([(lo, hi) for lo, hi in spans], matches, self.items)


class Shard:
    """Documents, or parts of them, laid out until there are enough words to sort."""

    def __init__(self, items: Items, size: int):
        self.items, self.size = items, size
        self.found: dict[int, Found] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.doc: list[int] = []
        self.offset: list[int] = []  #: words of the document before the part
        self.own: list[int] = []  #: words of the part whose matches aren't left to the next part
        self.words = 0

    def add(self, doc: int, text: bytes | None) -> int:
        """Lays out a document and returns its number of words."""
        get, n = self.items.number.get, 0
        held: list[np.ndarray] = []
        for part in split_words(text or b""):
            held.append(np.array([get(w, 0) for w in part], np.int64))
            n += len(part)
            while sum(map(len, held)) >= self.size + self.items.longest:
                whole = np.concatenate(held)
                self._part(doc, n - len(whole), whole[: self.size + self.items.longest], self.size)
                held = [whole[self.size :]]
        if left := sum(map(len, held)):
            self._part(doc, n - left, np.concatenate(held), left)
        return n

    def _part(self, doc: int, offset: int, words: np.ndarray, own: int) -> None:
        self.parts += [words, np.zeros(1, np.int64)]
        self.doc.append(doc)
        self.offset.append(offset)
        self.own.append(own)
        self.words += len(words) + 1
        if self.words >= self.size:
            self.flush()

    def flush(self) -> None:
        """Sorts and searches what was laid out."""
        if not self.words or not len(self.items.words):
            self.clear()
            return
        size = np.array([len(x) for x in self.parts[::2]]) + 1
        begin = size.cumsum() - size
        place, words, owner, starts, longest, at = search(np.concatenate(self.parts), self.items)
        if len(place):
            occurs, posting, items = owner
            part = np.searchsorted(begin, place, "right") - 1
            # Hit words: runs of what any occurrence covers.
            cover = np.zeros(self.words + 1, np.int64)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + words, -1)
            edge = np.diff(np.concatenate([[0], cover.cumsum() > 0]).astype(np.int8))
            lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            for k, x, y in zip((np.searchsorted(begin, lo, "right") - 1).tolist(), lo.tolist(), hi.tolist(), strict=True):
                self._of(k).spans.append((x - int(begin[k]) + self.offset[k], y - int(begin[k]) + self.offset[k]))
            # Items of a document: those of its different windows.
            pairs = np.unique(np.stack([part, occurs]), axis=1)
            for k, w in pairs.T.tolist():
                self._of(k).items.update(self.items.ids[i] for i in items[posting[w] : posting[w + 1]].tolist())
            # Longest matches, from where no match began before that reaches as far.
            part = np.searchsorted(begin, starts, "right") - 1
            end = starts + longest
            new = np.concatenate([[True], (end[1:] > end[:-1]) | (part[1:] != part[:-1])])
            for k, p, m, y in zip(part[new].tolist(), starts[new].tolist(), longest[new].tolist(), at[new].tolist(), strict=True):
                if (p := p - int(begin[k])) < self.own[k]:
                    i = int(self.items.item[y])
                    self._of(k).matches.append((p + self.offset[k], m, self.items.ids[i], y - int(self.items.start[i])))
        self.clear()

    def _of(self, part: int) -> Found:
        return self.found.setdefault(self.doc[part], Found())


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType())]))
#: What contamination() adds to a table's columns.
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("matches", _MATCHES), T.StructField("items", T.ArrayType(T.StringType()))])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items as (id, text), in parts of about ``BLOCK_BYTES`` at most."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("id") + 16)).first()[0] or 0
    n = int(-(-total // BLOCK_BYTES))
    return [rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)]


def _pass(df: DataFrame, k: int, text_at: int, block: Broadcast | None, first: bool, size: int) -> DataFrame:
    """``df``, of k columns c0, c1, ... and what earlier passes found, with what this block finds added."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*df.schema.fields[:k], *FOUND.fields])
    kinds = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value if block else Items.of([], WINDOW)
        for b in batches:
            shard = Shard(items, max(size, 2 * len(items.words)))
            texts = b.column(text_at).cast(pa.binary())
            n_words = [shard.add(i, texts[i].as_py()) for i in range(b.num_rows)]
            shard.flush()
            got = [shard.found[i].tidy() if i in shard.found else None for i in range(b.num_rows)]
            if not first:
                old = [b.column(k + 1 + i) for i in range(3)]
                for i, f in enumerate(got):
                    if len(old[0][i]) and f:
                        was = [x[i].as_py() for x in old]
                        got[i] = Found([*f.spans, *((s["start"], s["end"]) for s in was[0])], [*f.matches, *(tuple(m.values()) for m in was[1])], [*f.items, *was[2]]).tidy()
                    elif not f:
                        got[i] = Found(((s["start"], s["end"]) for s in old[0][i].as_py()), (tuple(m.values()) for m in old[1][i].as_py()), old[2][i].as_py()) if len(old[0][i]) else None
            spans = [[{"start": lo, "end": hi} for lo, hi in f.spans] if f else [] for f in got]
            matches = [[dict(zip(("start", "words", "item_id", "item_start"), m, strict=True)) for m in f.matches] if f else [] for f in got]
            made = [n_words, spans, matches, [sorted(f.items, key=lambda s: s.encode()) if f else [] for f in got]]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *[pa.array(x, t.type) for x, t in zip(made, kinds, strict=True)]], [f.name for f in out])

    return df.mapInArrow(run, out)


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` with, after their own columns, the word count, the hit words as spans [start, end), the longest verbatim matches with their
    places in document and item, and the ids of the items with a window in the document, in UTF-8 order."""
    k, names = len(docs.columns), docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(k)])
    text_at = names.index(text_col)
    out = out.withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    blocks = _blocks(items, item_id, item_text)
    context = docs.sparkSession.sparkContext
    for i, rows in enumerate(blocks or [None]):
        block = context.broadcast(Items.of([(r.id, r.text) for r in rows.orderBy("id", "text").collect()], window)) if rows is not None else None
        out = _pass(out, k, text_at, block, i == 0, shard)
    return out.toDF(*names, *FOUND.names)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a hit word, all columns as they are."""
    found = contamination(docs, items, **options)
    k = len(docs.columns)
    clean = found.toDF(*[f"c{i}" for i in range(len(found.columns))]).where(F.size(f"c{k + 1}") == 0)
    return clean.select(*[f"c{i}" for i in range(k)]).toDF(*docs.columns)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = """
with it as (
    select coalesce(item_id::varchar, '') as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
    select distinct id, least(len(w), 10) as size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as window_ from (select id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from it where len(w) > 0)
), d as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), places as (
    select r, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from win) where len(w) >= size
), hit as (
    select p.r, p.i, p.size, win.id from places p join win on win.size = p.size and win.window_ = array_to_string(list_slice(p.w, p.i, p.i + p.size - 1), ' ')
), words as (
    select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + size)) as place from (select distinct r, i, size from hit)) group by r
), ids as (
    select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, id from hit) group by r
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(words.n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words using (r) left join ids using (r)
"""
