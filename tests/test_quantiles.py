"""Medians by repeated histograms against numpy, on values that are hard to tell apart, and in a small heap."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanrisk.operators import quantiles as Q
from tests.conftest import ROOT


def columns(n=40_000, seed=1):
    rng = np.random.default_rng(seed)
    step = 2.0 ** -52
    return {
        "unit": rng.random(n), "signed": rng.normal(size=n) * 1e6,
        "wide": np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-307, 307, n),
        "close": 1.0 + step * rng.integers(0, 30_000, n), "tiny": 5e-324 * rng.integers(0, 20_000, n),
        "few": rng.integers(0, 3, n).astype(float), "same": np.full(n, -7.25),
        "edge": np.where(rng.random(n) < 0.5, np.nextafter(2.0, 0), 2.0),
        "infinite": np.where(rng.random(n) < 0.6, np.inf, -np.inf), "zero": np.where(rng.random(n) < 0.7, 0.0, -0.0),
    }


def middles(x):
    x = np.sort(x[~np.isnan(x)])
    return (float(x[(len(x) - 1) // 2]), float(x[len(x) // 2])) if len(x) else None


@pytest.mark.parametrize("n", [40_000, 40_001])
def test_columns(spark, n, monkeypatch):
    import pandas as pd

    passes = []
    real = Q._pass
    monkeypatch.setattr(Q, "_pass", lambda *a: (passes.append(1), real(*a))[1])
    data = pd.DataFrame(columns(n))
    data.loc[data.index % 11 == 0, "signed"] = np.nan
    df = spark.createDataFrame(data).repartition(7)
    got = Q.middle_values(df, list(data.columns))[()]
    assert got == [middles(data[c].to_numpy()) for c in data.columns]
    assert len(passes) <= 4


def test_groups(spark):
    import pandas as pd

    data = pd.DataFrame(columns(30_000, 3))
    data["g"] = pd.Series(np.random.default_rng(4).choice(["a", "b", "c"], len(data), p=[0.8, 0.15, 0.05]))
    df = spark.createDataFrame(data).withColumn("g", F.when(F.col("g") != "c", F.col("g")))
    got = Q.middle_values(df, ["unit", "close", "wide"], ["g"])
    for g, sub in data.groupby("g"):
        assert got[(None if g == "c" else g,)] == [middles(sub[c].to_numpy()) for c in ("unit", "close", "wide")]


def test_nothing_to_find(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 2.0, None), ("b", 3.0, float("nan"))], "g string, v double, w double")
    assert Q.medians(df, ["v", "w"], ["g"]) == {("b",): [2.5, None]}
    assert Q.medians(df.filter("g = 'a'"), ["v", "w"]) == {}
    assert Q.median_table(df.filter("g = 'a'"), {"v": "m"}).collect()[0]["m"] is None
    assert Q.median_table(df.filter("g = 'a'"), {"v": "m"}, ["g"]).collect() == []


SMALL_HEAP = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from spanrisk.operators.model import fill_values
spark = (SparkSession.builder.master("local[4]").config("spark.driver.memory", "700m").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8").getOrCreate())
df = spark.range(3_000_000).select(*[F.rand(i).alias(f"c{i}") for i in range(12)])
fills = fill_values(df, [f"c{i}" for i in range(12)])
assert len(fills) == 12 and all(abs(v - 0.5) < 0.005 for v in fills.values()), fills
print("filled")
"""


def test_twelve_columns_of_three_million_values_in_a_small_heap():
    done = subprocess.run([sys.executable, "-c", SMALL_HEAP, ROOT], capture_output=True, text=True, timeout=900,
                          env={k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"})
    assert "filled" in done.stdout, done.stderr[-2000:]


def test_other_places(spark):
    import pandas as pd

    data = pd.DataFrame(columns(20_000, 6))
    want = [0, 1, 137, 6666, 6667, 13333, 19_999]
    got = Q.order_values(spark.createDataFrame(data), list(data.columns), [lambda n, k=k: F.lit(k) for k in [*want, 20_000]])
    for c, found in zip(data.columns, got[()]):
        assert found == (*np.sort(data[c].to_numpy())[want].tolist(), None)
