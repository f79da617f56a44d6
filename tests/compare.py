"""Order-free comparison of a Spark result with a DuckDB one."""

from __future__ import annotations

import pandas as pd


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith(("float", "int", "Int")):
            df[c] = df[c].astype("float64").round(6) + 0.0
    df = df.astype(object).where(df.notna(), None)
    return sorted(str([None if v is None else v if isinstance(v, (float, bool)) else str(v) for v in r]) for r in df.values.tolist())
