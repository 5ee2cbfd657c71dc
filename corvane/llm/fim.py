"""Fill-in-middle examples: DuckDB inside ``mapInArrow``.

Every batch is registered with a DuckDB connection of the worker, cut and rearranged by one SQL statement (``regexp_extract_all`` into
units, ``list_slice`` and ``array_to_string`` into prefix, middle and suffix, ``sha256`` for what decides), and returned as Arrow. No Python
runs per row, nothing is shuffled, and a row depends on its own id and text only: any task may be run again.

A text of n units has its prefix end after the smaller of h1 % (n + 1) and h2 % (n + 1) units and its middle after the larger; h1 to h4 are the
first four groups of eight hex digits of sha256(``<seed>:<id>``). The form is ``plain`` (the text itself) if the text is empty, contains a
marker, or h3 % 100 >= ``rate``; else ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle) if h4 % 100 < ``spm``, else ``psm``
(``<P>`` prefix ``<S>`` suffix ``<M>`` middle). As a text with a marker stays plain and no marker can arise across a seam (each has ``<`` first
and ``>`` last only), ``restore`` is exact.

Defined results: a null text is the empty one, a null id the empty id; repeated rows give equal rows; extra columns stay as they are, whatever
their names; an empty table gives an empty table. A worker holds about ``UNIT_BYTES`` bytes for each unit of a slice of ``UNITS`` units, and a longer
text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_cache

#: Bytes of text that one statement gets at most, unless a single text is longer.
UNITS = 2_000_000
#: What DuckDB holds for a unit at once, about: list entries of the units and of three slices.
UNIT_BYTES = 64

_CUT = """
with given as (
    select row, text, sha256($seed || ':' || id) as h from batch
), units as (
    select row, text, regexp_extract_all(text, '.', 0, 's') as u, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
        ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4
    from given
), cuts as (
    select row, text, u, len(u)::bigint as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::bigint as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::bigint as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= $rate then 'plain' when h4 % 100 < $spm then 'spm' else 'psm' end as form
    from units
), parts as (
    select row, text, n, form, a, b, case when form <> 'plain' then array_to_string(list_slice(u, 1, a), '') end as prefix,
        case when form <> 'plain' then array_to_string(list_slice(u, a + 1, b), '') end as middle, case when form <> 'plain' then array_to_string(list_slice(u, b + 1, n), '') end as suffix
    from cuts
)
select n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output
from parts order by row
"""

_RESTORE = """
with body as (
    select row, form, output, substr(output, 4) as x from batch
), halves as (
    select row, form, output, split_part(x, case form when 'psm' then '<S>' else '<P>' end, 1) as one, split_part(x, case form when 'psm' then '<S>' else '<P>' end, 2) as rest from body
)
select case form when 'plain' then output when 'psm' then one || split_part(rest, '<M>', 2) || split_part(rest, '<M>', 1) else split_part(rest, '<M>', 1) || split_part(rest, '<M>', 2) || one end as restored
from halves order by row
"""

_CONNECTION: list[duckdb.DuckDBPyConnection] = []


def _connection() -> duckdb.DuckDBPyConnection:
    """This worker's own database: in memory, one thread, nothing ever written beside it."""
    claim_cache("fim", _CONNECTION.clear)
    if not _CONNECTION:
        c = duckdb.connect(config={"threads": 1})
        c.execute("set temp_directory = ''")
        _CONNECTION.append(c)
    return _CONNECTION[0]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, rows) of slices whose texts have at most ``UNITS`` bytes, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64).cumsum()
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + UNITS, "right")))
        yield at, to - at
        at = to


def _through_duckdb(df: DataFrame, inputs: dict[str, Column], sized: str, sql: str, values: dict, added: str) -> DataFrame:
    """``df``, all its columns as they are, and those of ``sql`` over a table ``batch`` of ``inputs`` and the row number ``row``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    k, new = len(df.columns), _parse_datatype_string(added)
    fed = df.toDF(*[f"c{i}" for i in range(k)])
    fed = fed.select("*", *[x.alias(f"i{n}") for n, x in enumerate(inputs.values())])
    out = T.StructType([*fed.schema.fields[:k], *[T.StructField(f"o{i}", f.dataType) for i, f in enumerate(new)]])
    kinds = to_arrow_schema(new)
    names, at = [*inputs], [*inputs].index(sized)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in _slices(batch.column(k + at)):
                part = batch.slice(first, rows)
                c = _connection()
                c.register("batch", pa.table([*part.columns[k:], pa.array(np.arange(rows))], [*names, "row"]))
                got = c.sql(sql, params=values).to_arrow_table().combine_chunks()
                c.unregister("batch")
                made = [x.combine_chunks().cast(t.type) if isinstance(x, pa.ChunkedArray) else x.cast(t.type) for x, t in zip(got.columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *made], [f.name for f in out])

    return fed.mapInArrow(run, out).toDF(*df.columns, *[f.name for f in new])


def _named(df: DataFrame, name: str) -> Column:
    """The first column of that name by its place in ``c0, c1, ...``."""
    return F.col(f"c{df.columns.index(name)}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """The rows of ``docs`` with (n, form, prefix_chars, middle_chars, output) after their own columns; lengths are null where the form is plain."""
    text, key = (F.coalesce(_named(docs, c).cast("string"), F.lit("")) for c in (text_col, id_col))
    return _through_duckdb(docs, {"text": text, "id": key}, "text", _CUT, {"seed": seed, "rate": rate, "spm": spm}, "n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """The rows of ``made`` with the column restored: the text that (form, output) came from."""
    return _through_duckdb(made, {"form": _named(made, "form"), "output": _named(made, "output")}, "output", _RESTORE, {}, "restored string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")])


#: The cuts by substring instead of units, the digests' groups through their own expression.
ORACLE = """
with h as (
    select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents
), g as (
    select doc_id, t, length(t) as n, [('0x' || substr(d, i * 8 + 1, 8))::ubigint for i in [0, 1, 2, 3]] as h from h
), c as (
    select doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1))::bigint as a, greatest(h[1] % (n + 1), h[2] % (n + 1))::bigint as b,
        case when t = '' or regexp_matches(t, '<[PSM]>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form
    from g
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
        else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end) as output_sha256,
    sha256(t) as restored_sha256
from c
"""
