"""Label-based evaluation: frame joins, confusion counts, event recall, optimal one-to-one matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .assign import assign


def ratio(part: Column, whole: Column) -> Column:
    """Null on a zero denominator."""
    return part / F.nullif(whole, F.lit(0))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1, rounded; null where a denominator is zero."""
    return [F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")]


def box_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box of a with that of b; boxes are rows (lo x y z, hi x y z)."""
    inter = np.clip(np.minimum(a[:, 3:], b[:, 3:]) - np.maximum(a[:, :3], b[:, :3]), 0, None).prod(1)
    union = (a[:, 3:] - a[:, :3]).prod(1) + (b[:, 3:] - b[:, :3]).prod(1) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def match_boxes(predictions: DataFrame, truth: DataFrame, minimum_iou: float, keys: tuple[str, ...] = ("bag", "frame")) -> DataFrame:
    """(keys, prediction, truth, iou): the one-to-one matches of each frame with the most valid pairs, then the most overlap.

    Both sides hold (keys, id, x0, y0, z0, x1, y1, z1). A frame's boxes are few, so they are gathered to arrays; all pairs
    of a batch of frames are weighed at once, and frames are solved one by one only where several boxes on both sides contend.
    """
    cols = ["x0", "y0", "z0", "x1", "y1", "z1"]

    box = F.struct("id", *cols)
    side = lambda df, n: df.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias(n))  # noqa: E731  a scan's boxes are few
    j = side(predictions, "ps").join(side(truth, "ts"), list(keys))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            np_, nt = (pc.list_value_length(b.column(n)).to_numpy() for n in ("ps", "ts"))
            flat = [b.column(n).flatten() for n in ("ps", "ts")]
            p, t = (np.column_stack([x.field(c).to_numpy(zero_copy_only=False) for c in cols]) for x in flat)
            n = np_ * nt
            of, start = np.arange(len(n)).repeat(n), n.cumsum() - n
            at = np.arange(n.sum()) - start[of]
            i, k = (np_.cumsum() - np_)[of] + at // nt[of], (nt.cumsum() - nt)[of] + at % nt[of]
            iou = box_ious(p[i], t[k])
            valid = iou >= minimum_iou
            taken = [np.bincount(x[valid], minlength=m) for x, m in ((i, len(p)), (k, len(t)))]
            contends = np.bincount(of, weights=valid & ((taken[0][i] > 1) | (taken[1][k] > 1)), minlength=len(n)) > 0
            keep = [np.flatnonzero(valid & ~contends[of])]
            single = np.flatnonzero(contends[of] & (np.minimum(np_, nt) == 1)[of])
            best = single[np.lexsort((single, -iou[single], of[single]))]
            keep.append(best[np.r_[True, of[best][1:] != of[best][:-1]]] if len(best) else best)
            for f in np.flatnonzero(contends & (np.minimum(np_, nt) > 1)):
                m = iou[start[f] : start[f] + n[f]].reshape(np_[f], nt[f])
                keep.append(start[f] + np.array([x * nt[f] + y for x, y in assign(-((m >= minimum_iou) * (min(m.shape) + 1.0) + m)) if m[x, y] >= minimum_iou], np.int64))
            got = np.concatenate(keep)
            ids = [x.field("id").take(pa.array(y[got])).cast(pa.int64()) for x, y in zip(flat, (i, k), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(of[got])) for x in range(len(keys))), *ids, pa.array(iou[got])], schema=out)

    schema = T.StructType([*(predictions.schema[k] for k in keys), T.StructField("prediction", T.LongType()), T.StructField("truth", T.LongType()), T.StructField("iou", T.DoubleType())])
    out = to_arrow_schema(schema)
    return j.mapInArrow(solve, schema)


#: Pairs of boxes whose volumes are found together: 220 triples of planes each.
PAIRS = 1024


def oriented_ious(pairs: DataFrame) -> DataFrame:
    """(id, iou) of pairs of oriented boxes given as arrays: ca, sa, ra (9 numbers), cb, sb, rb."""
    from .assign import oriented_ious as ious

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PAIRS):
                b = whole.iloc[at : at + PAIRS]
                side = lambda s: (np.stack(b[f"c{s}"]), np.stack(b[f"s{s}"]), np.stack(b[f"r{s}"]).reshape(-1, 3, 3))  # noqa: B023, E731
                yield pd.DataFrame({"id": b["id"], "iou": ious(side("a"), side("b"))})

    # Few bytes make much work here, so Spark isn't left to read a small file in one task.
    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.mapInPandas(run, "id long, iou double")
