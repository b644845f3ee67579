"""Query registry: name -> (Spark query, oracle SQL or None).

``queries()`` and ``oracle_sql()`` in ``__spark_entry__`` are views of this
registry. Each Spark query takes ``(spark, sf_dir)`` and returns a lazy
DataFrame; each oracle is DuckDB SQL over the same parquet tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    section: str


REGISTRY: dict[str, Entry] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; Spark's is BIGINT. Wrap every call in a cast."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(tok) - 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def query(name: str, section: str, sql: str | None = None):
    """Register a query function under ``name`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, bigint_counts(sql) if sql else sql, section)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules registers their queries
    import importlib

    for mod in MODULES:
        importlib.import_module(f"spanrisk.plans.{mod}")
    return REGISTRY


MODULES = ("q_sources", "q_clean", "q_features", "q_model", "q_rank", "q_maplayer", "q_analysis",
           "q_regions", "q_exposure")
