"""JSON documents without a fixed schema as rows of (path, kind, value), and their differences.

Trees: documents are parsed once to VARIANT and taken apart level by level: each level replaces a container by itself and its children, in one projection and
one explode, so nothing is parsed or read again. The number of levels is that of the deepest document, found beforehand from its brackets.

Differences: documents of equal keys meet in one join; each pair is descended at once, in Arrow batches, and only what differs leaves the descent. What is JSON
and how values are told is Spark's to say in both.
"""

from __future__ import annotations

import json as js
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import written

#: Kinds of values: what JSON tells apart, with whole numbers apart from others.
OBJECT, ARRAY, MISSING, INVALID = "object", "array", "missing", "invalid"

#: What isn't a bracket: strings, and runs of other characters.
_REST = r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++'


def depth(docs: DataFrame, json: str) -> int:
    """Levels of containers of the deepest document: brackets open at once, strings left out. Documents of one shape are counted once."""
    shapes = docs.select(F.regexp_replace(F.col(json), _REST, "").alias("brackets")).distinct()
    open_ = F.aggregate(
        F.split("brackets", ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")),
    )
    return shapes.select(F.max(open_["most"])).first()[0] or 0


_KINDS = {"OBJECT": OBJECT, "ARRAY": ARRAY, "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}


def _kind(v: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)), F.lit("number"))


def _named(key: Column) -> Column:
    """The path of a key below ``path``."""
    dot = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
    quoted = F.concat("path", F.lit('["'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('"]'))
    return F.when(key.rlike(r"^[\w-]+\z"), F.concat(dot, key)).otherwise(quoted)


def json_tree(docs: DataFrame, keys: list[str], json: str, levels: int | None = None, only: list[str] | None = None) -> DataFrame:
    """(keys, path, parent, key, kind, value) of every value of every document, the root's path being empty.

    Paths are keys joined by dots and places in brackets (``a.b[0]``), keys of other than letters, digits, ``_`` and ``-`` in brackets and quotes; ``key`` is the last key, null for places. An array's value is its length, an object's its
    number of keys; numbers with a fraction or exponent are doubles. A null document is one row of kind ``missing``, one that isn't JSON (or names a key of an
    object twice) one of kind ``invalid`` with its text. With ``only``, just the rows whose last key is one of these: other values are left where they are met.
    """
    n = depth(docs, json) if levels is None else levels
    parsed = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(json).alias("text"), F.try_parse_json(F.col(json)).alias("v"))
    none = F.lit(None).cast("string")
    # The text goes on where it isn't JSON alone.
    rows = parsed.select(*[f"k{i}" for i in range(len(keys))], F.when(F.col("v").isNull(), F.col("text")).otherwise("").alias("text"), F.lit("").alias("path"), none.alias("parent"), none.alias("key"), F.col("v"), F.lit(True).alias("open"))
    names = [f"k{i}" for i in range(len(keys))]
    for _ in range(n):
        # What is open is replaced by itself, closed, and its children, open.
        rows = rows.withColumns({c: F.when(F.col("open"), F.col("v").try_cast(of)) for c, of in (("fields", "map<string, variant>"), ("items", "array<variant>"))})
        below = lambda path, key, v: F.struct(path.alias("path"), F.col("path").alias("parent"), key.alias("key"), v.alias("v"), F.lit(True).alias("open"))
        own = F.array(F.struct(F.col("path").alias("path"), F.col("parent").alias("parent"), F.col("key").alias("key"), F.col("v").alias("v"), F.lit(False).alias("open")))
        entries = F.map_entries("fields")
        items = F.transform("items", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        if only is not None:
            holds = lambda v: v.try_cast("map<string, variant>").isNotNull() | v.try_cast("array<variant>").isNotNull()
            own = F.filter(own, lambda r: F.coalesce(r["key"].isin(*only), F.lit(False)))
            entries = F.filter(entries, lambda e: e["key"].isin(*only) | F.coalesce(holds(e["value"]), F.lit(False)))
            items = F.filter(items, lambda x: F.coalesce(holds(x["x"]), F.lit(False)))
        of_object = F.transform(entries, lambda e: below(_named(e["key"]), e["key"], e["value"]))
        of_array = F.transform(items, lambda x: below(F.concat("path", F.lit("["), x["i"].cast("string"), F.lit("]")), none, x["x"]))
        rows = rows.select(*names, "text", F.explode(F.concat(own, F.coalesce(of_object, of_array, F.slice(own, 2, 1)))).alias("r")).select(*names, "text", "r.*")
    if only is not None:
        rows = rows.where(F.col("key").isin(*only))
    rows = rows.withColumn("kind", F.when(F.col("text").isNull(), MISSING).when(F.col("v").isNull(), INVALID).otherwise(_kind(F.col("v"))))
    kind, size = F.col("kind"), lambda of: F.size(F.expr(f"try_cast(v as {of})")).cast("string")
    value = F.when(kind == OBJECT, size("map<string, variant>")).when(kind == ARRAY, size("array<variant>")).when(kind == "number", F.expr("try_variant_get(v, '$', 'double')").cast("string"))
    value = value.when(kind == INVALID, F.col("text")).when(kind == MISSING, none).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
    return rows.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "path", "parent", "key", "kind", value.alias("value"))


def pattern(path: Column) -> Column:
    """A path with its places made alike: ``a[3].b`` becomes ``a[*].b``."""
    return F.regexp_replace(path, r"\[\d+\]", "[*]")


_PLAIN = re.compile(r"[\w-]+", re.ASCII)
#: Numbers stay as written, in bytes: nothing else is, so what is equal is of one kind, however deep.
_DECODER = js.JSONDecoder(strict=False, parse_int=str.encode, parse_float=str.encode)


def _parsed(text: str) -> object:
    return _DECODER.raw_decode(text.lstrip(" \t\r\n"))[0]


def _below(path: str, key: str) -> str:
    """As ``_named``."""
    if _PLAIN.fullmatch(key):
        return f"{path}.{key}" if path else key
    return f'{path}["{key.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"]'


def _value(v: object) -> tuple[str, str | None, float | None]:
    """(kind, value, and that of a number, which is told as Spark tells doubles)."""
    of = type(v)
    if of is str:
        return "string", v, None
    if of is bytes:
        text = v.decode().lower()
        # Whole numbers that are no longs are numbers; a zero has a sign only if it is written with an exponent.
        if not ("." in text or "e" in text) and len(text) < 21 and -(1 << 63) <= int(text) < 1 << 63:
            return "integer", str(int(text)), None
        return "number", None, float(text) if "e" in text else float(text) + 0.0
    if of is bool:
        return "boolean", "true" if v else "false", None
    return ("null", None, None) if v is None else (OBJECT if of is dict else ARRAY, str(len(v)), None)


def _differences(b: object, a: object) -> Iterator[tuple]:
    """(path, change, value before, value after) of what differs between two values, as ``_value`` tells them."""
    pairs = [] if b == a else [("", b, a)]
    while pairs:
        path, b, a = pairs.pop()
        kind = type(b)
        if kind is type(a) and kind is dict:
            for k, v in b.items():
                if k not in a:
                    yield _below(path, k), "removed", _value(v), None
                elif v != (w := a[k]):
                    pairs.append((_below(path, k), v, w))
            for k, w in a.items():
                if k not in b:
                    yield _below(path, k), "added", None, _value(w)
        elif kind is type(a) and kind is list:
            if len(b) != len(a):
                yield f"{path}.length", "length", _value(b), _value(a)
            pairs.extend((f"{path}[{i}]", v, w) for i, (v, w) in enumerate(zip(b, a, strict=False)) if v != w)
        else:
            old, new = _value(b), _value(a)
            if old[0] != new[0]:
                yield path, "kind", old, new
            elif old != new or (old[2] == 0 and str(old[2]) != str(new[2])):
                yield path, "value", old, new


def _compared(met: DataFrame, names: list[str]) -> DataFrame:
    """(names, path, change, old, new) of pairs of documents (names, and of both sides ``b`` and ``a`` the text, whether it is there and whether it is JSON)."""
    told = [T.StructField(f"{x}{c}", of) for x in ("old", "new") for c, of in (("", T.StringType()), ("n", T.DoubleType()))]
    out = T.StructType([*(met.schema[n] for n in names), T.StructField("path", T.StringType()), T.StructField("change", T.StringType()), *told])
    arrow = to_arrow_schema(out)

    def whole(text: str | None, there: bool, known: bool) -> tuple[str, str | None, float | None] | None:
        """What a side is if it can't be descended: not there, missing or no JSON; with ``known`` it is JSON."""
        return None if not there else (MISSING, None, None) if text is None else _value(_parsed(text)) if known else (INVALID, text, None)

    def strings(values: list[str | None]) -> pa.Array:
        try:
            return pa.array(values, pa.string())
        except UnicodeEncodeError:  # halves of surrogate pairs are no text
            return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, changes, values = [], [], [], ([], [], [], [])
            columns = [batch.column(c).to_pylist() for c in ("btext", "atext", "bthere", "athere", "bjson", "ajson")]
            for i, (bt, at_, bthere, athere, bjson, ajson) in enumerate(zip(*columns, strict=True)):
                if bthere and athere and bjson and ajson:
                    found = _differences(_parsed(bt), _parsed(at_))
                else:
                    old, new = whole(bt, bthere, bjson), whole(at_, athere, ajson)
                    change = "added" if old is None else "removed" if new is None else "kind" if old[0] != new[0] else "value" if old != new else None
                    found = [("", change, old, new)] if change else []
                for path, change, old, new in found:
                    at.append(i)
                    paths.append(path)
                    changes.append(change)
                    for k, v in enumerate((old, new)):
                        values[2 * k].append(v and v[1])
                        values[2 * k + 1].append(v and v[2])
            if at:
                own = batch.select(names).take(pa.array(at))
                told = [strings(values[0]), pa.array(values[1], pa.float64()), strings(values[2]), pa.array(values[3], pa.float64())]
                yield from pa.table([*own.columns, strings(paths), pa.array(changes, pa.string()), *told], out.names).cast(arrow).to_batches()

    found = met.mapInArrow(run, out)
    return found.select(*names, "path", "change", *[F.coalesce(x, F.col(f"{x}n").cast("string")).alias(x) for x in ("old", "new")])


def json_difference(before: DataFrame, after: DataFrame, keys: list[str], json: str, allowed: DataFrame | None = None) -> DataFrame:
    """(keys, path, change, old, new, allowed) of what differs between documents of equal keys.

    A part that only one side has is one row at its root (change ``removed`` or ``added``), not one for each value inside; so is a value of another kind
    (``kind``). Arrays of different lengths are one row at ``path.length`` and compared as far as both go. Keys that only one side has are rows of the
    empty path. ``allowed`` (pattern, value) names parts that may be removed, by ``pattern`` of their path, with any value where that is null.
    """
    names = [f"k{i}" for i in range(len(keys))]
    side = lambda df, n: df.select(*[F.col(k).alias(f"{n}{i}") for i, k in enumerate(keys)], F.col(json).alias(f"{n}text"), F.lit(True).alias(f"{n}there"))
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"b{i}").eqNullSafe(F.col(f"a{i}"))
    met = side(before, "b").join(side(after, "a"), same, "full_outer")
    # Equal texts don't differ and aren't parsed.
    met = met.where(~(F.coalesce("bthere", F.lit(False)) & F.coalesce("athere", F.lit(False)) & F.col("btext").eqNullSafe(F.col("atext"))))
    flags = [v for x in "ba" for v in (F.coalesce(f"{x}there", F.lit(False)).alias(f"{x}there"), F.try_parse_json(f"{x}text").isNotNull().alias(f"{x}json"))]
    rows = written(_compared(met.select(*[F.coalesce(f"b{i}", f"a{i}").alias(n) for i, n in enumerate(names)], "btext", "atext", *flags), names), "differences")
    out = rows.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "path", "change", "old", "new")
    if allowed is None:
        return out.withColumn("allowed", F.lit(False))
    names = allowed.groupBy(F.col("pattern").alias("__pattern")).agg(F.collect_set("value").alias("__values"), F.bool_or(F.col("value").isNull()).alias("__any"))
    out = out.join(names, (pattern(F.col("path")) == F.col("__pattern")) & (F.col("change") == "removed"), "left")
    return out.withColumn("allowed", F.coalesce(F.col("__any") | F.array_contains("__values", F.col("old")), F.lit(False))).drop("__pattern", "__values", "__any")


def named_keys(tree: DataFrame, names: list[str]) -> DataFrame:
    """The rows of a ``json_tree`` whose last key is one of ``names``, wherever it stands."""
    return tree.where(F.col("key").isin(*names))
