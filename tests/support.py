"""Order-free comparison of two results."""

from __future__ import annotations

import math

import pandas as pd


def _value(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA or v is pd.NaT:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if hasattr(v, "__float__") and not isinstance(v, str):
        return repr(float(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_value(v) for v in r) for r in df.itertuples(index=False))
