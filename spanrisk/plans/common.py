"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.functions.columns import dround

KEY = ("STATE_CODE", "STRUCTURE_NUMBER")
OKEY = ("state_code", "structure_number")


PRECISE = {"p_collapse_1yr": 12, "median_p_collapse": 12, "p_min": 12, "p_max": 12}


def rounded(df: DataFrame, digits: int = 6, precise: dict[str, int] | None = None) -> DataFrame:
    """Round every DOUBLE column for cross-engine comparison (names kept).

    Probability columns (tiny values) keep 12 decimals."""
    precise = PRECISE if precise is None else precise
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = dround(c, precise.get(f.name, digits))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def project(df: DataFrame, cols, key=KEY) -> DataFrame:
    want = list(key) + [c for c in cols if c not in key]
    return rounded(df.select(*[c if not isinstance(c, str) else F.col(c) for c in want]))
