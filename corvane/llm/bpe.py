"""Byte-level BPE by a deterministic automaton over tokens, compiled merge by merge.

**Automaton.** Its letters are tokens; it accepts exactly the token sequences that BPE yields. At first one state
loops over all single bytes. Each merge ``a b -> c`` then applies one gadget, in order of rank: the arcs labelled
``a`` are led to a fresh copy of their target without its arc ``b`` (so ``a b`` can no longer be read), and
wherever ``a`` then ``b`` could be read before, a new arc ``c`` leads to where ``b`` led. All arcs with one label
end in one state, so a state is stored as (parent state, label it lost): a difference table of two integers for
each merge, and a label's arcs are known from the label it began as. Building takes one pass over the merges.

**Encoding.** Every prefix of a word has one accepted path, so ``last[i]``, the label that ends at byte ``i``, is
the one token ``t`` ending there with an arc ``t`` from the state that ``last[i - len(t)]`` leads to. That
transition is looked up in a table filled on demand. Words come from the byte-level pre-tokenizer's pattern
and are remembered by each worker, within a bound.

**Decoding** emits each arc's label: the bytes of its token.

Defined results: a null text is empty; an empty text has no ids. Special tokens standing in a text become
their ids, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim_cache, map_batches

#: Entries that a worker's table of words may hold before it starts anew.
MEMO_WORDS = 600_000

#: The byte-level pre-tokenizer's pattern, with white space spelt out as Unicode's property has it.
_SPACES = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
#: Within Latin-1 the two classes are short, and the standard library's engine is quicker.
_L1, _N1 = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
LATIN1_ONLY = re.compile(r"[\x00-\xff]*")
LATIN1_PATTERN = PATTERN.replace(r"[^" + _SPACES + r"\p{L}\p{N}]", f"[^{_SPACES}{_L1}{_N1}]").replace(r"\p{L}", f"[{_L1}]").replace(r"\p{N}", f"[{_N1}]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

#: Transitions that a worker remembers, at most.
ARCS = 2_000_000


class MergeAutomaton:
    """``labels[t]`` are token t's bytes; ``parent``/``lost`` describe states, ``state_of[t]`` where arcs labelled t end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        back = {c: b for b, c in byte_letters().items()}
        raw = {s: bytes(back[c] for c in s) for s in vocab if s not in special}
        self.special = special
        self.labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for s, b in raw.items():
            self.labels[vocab[s]] = b
        for s, i in special.items():
            self.labels[i] = s.encode()
        self.parent, self.lost = [-1], [-1]
        self.state_of: dict[int, int] = {vocab[s]: 0 for s, b in raw.items() if len(b) == 1}
        self.left: dict[int, tuple[int, int]] = {}  # token -> the label it began as, and the copy that its gadget made
        for a, b in merges:
            self._gadget(vocab[a], vocab[b], vocab[a + b])
        self.token = {self.labels[t]: t for t in self.state_of}
        self.longest = max(map(len, self.token), default=1)
        self._arc: dict[int, bool] = {}

    def _gadget(self, a: int, b: int, c: int) -> None:
        if a not in self.state_of or b not in self.state_of or c in self.state_of:
            return
        q, r = self.state_of[a], self.state_of[b]
        if not self._has(q, b):
            return  # "a b" can't be read any more, so this merge never applies
        self.left[c] = (a, len(self.parent))
        self.state_of[c] = r
        self.parent.append(q)
        self.lost.append(b)
        self.state_of[a] = len(self.parent) - 1

    def _has(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc ``label``: neither it nor an ancestor lost it since the label was made, and
        the state (or its ancestor) of that time had the arc that the label began as."""
        while True:
            made = self.left.get(label)
            born = made[1] if made else 0
            while state > born:
                if self.lost[state] == label:
                    return False
                state = self.parent[state]
            if made is None:
                return True
            label = made[0]

    def arc(self, last: int, token: int) -> bool:
        """The transition table, filled on demand: may ``token`` follow ``last``?"""
        key = last << 20 | token
        if len(self._arc) > ARCS:
            self._arc.clear()
        got = self._arc.get(key)
        if got is None:
            got = self._arc[key] = self._has(self.state_of[last], token)
        return got

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.token.get(word)
        n = len(word)
        last, token, arcs = [-1] * (n + 1), self.token, self._arc
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = token.get(word[j:i])
                if t is None:
                    continue
                if j == 0:
                    last[i] = t
                    break
                p = last[j]
                if p < 0:
                    continue
                ok = arcs.get(p << 20 | t)
                if ok or ok is None and self.arc(p, t):
                    last[i] = t
                    break
            if last[i] < 0:
                raise ValueError(f"byte {word[i - 1]} has no token")
        if whole is not None:
            return [whole]
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.labels[last[i]])
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts with a compiled automaton."""

    def __init__(self, spec: dict):
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.automaton = MergeAutomaton(model["vocab"], merges, special)
        self.words = _Words(self.automaton)
        self.latin1 = re.compile(LATIN1_PATTERN).findall
        self.other = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut and self.cut.search(text):
            return b"".join(np.uint32(self.automaton.special[s]).tobytes() if i % 2 else self._plain(s) for i, s in enumerate(self.cut.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        split = self.latin1 if LATIN1_ONLY.fullmatch(text) else self.other
        return b"".join(map(self.words.__getitem__, split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        got = self[word] = np.array(self.automaton.encode_word(word.encode("utf-8", "replace")), "<u4").tobytes()
        return got


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The worker's codec for the tokenizer file with this content."""
    claim_cache("bpe", _CODECS.clear)
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(json.loads(spec))
    return _CODECS[key]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each whole text's ids as little-endian unsigned 32-bit integers.

    The file is read on the driver and travels with the tasks (its size is fixed); executors need no copy.
    """
    spec = open(path or byte_bpe_path(), encoding="utf-8").read()

    def f(x: dict) -> dict:
        return {id_col: x["id"], "ids": [c.encode(t or "") for c in [codec(spec)] for t in x["text"]]}

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(src, f, f"{id_col} {src.schema['id'].dataType.simpleString()}, ids binary", rows=500)


def bpe_decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of (id, ids); a null is empty; bytes that aren't UTF-8 become U+FFFD."""
    spec = open(path or byte_bpe_path(), encoding="utf-8").read()

    def f(x: dict) -> dict:
        return {id_col: x["id"], "text": [c.decode(b or b"") for c in [codec(spec)] for b in x["ids"]]}

    src = encoded.select(F.col(id_col).alias("id"), "ids")
    return map_batches(src, f, f"{id_col} {src.schema['id'].dataType.simpleString()}, text string", rows=500)


def op5_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text, encoded and decoded again in one pass, as counts and digests of ids and decoded text."""
    spec = open(path or byte_bpe_path(), encoding="utf-8").read()

    def f(x: dict) -> dict:
        c = codec(spec)
        ids = [c.encode(t or "") for t in x["text"]]
        return {
            "doc_id": x["doc_id"], "n_tokens": [len(b) // 4 for b in ids], "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
            "decoded_sha256": [hashlib.sha256(c.decode(b).encode("utf-8", "replace")).hexdigest() for b in ids],
        }

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(docs, f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=500)


__all__ = ["Codec", "MergeAutomaton", "bpe_decode", "bpe_encode", "op5_bpe_codec"]
