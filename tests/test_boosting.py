"""Boosted trees over blocks of binned rows: the same model as plain code, few bytes a row, Spark ML's persistence."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from spanrisk.operators import boosting as B
from spanrisk.operators import model as M
from spanrisk.params import ML_FEATURE_COLS, ModelParams
from spanrisk.session import scratch_path


def _rows(spark, n: int, partitions: int = 4):
    """Inputs of few and of many values, with nulls and NaN, and a label that follows some of them."""
    x = [F.rand(i) if i % 3 else F.floor(F.rand(i) * 5) / 5 for i in range(len(ML_FEATURE_COLS))]
    df = spark.range(n, numPartitions=partitions).select("id", *[c.alias(k) for c, k in zip(x, ML_FEATURE_COLS)])
    a, b, c = ML_FEATURE_COLS[:3]
    df = df.withColumn("label", (F.col(a) + F.col(b) * F.col(c) + 0.3 * F.randn(99) > 0.7).cast("int"))
    df = df.withColumn(a, F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.lit(float("nan")))
                       .otherwise(F.col(a)))
    path = scratch_path(spark, "boosting-test")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _plain(x: np.ndarray, y: np.ndarray, cuts: list, n_trees: int, depth: int, step: float):
    """Scores after every tree, all rows drawn: every split by comparing values, no histograms."""
    score = np.zeros(len(y))
    for t in range(n_trees):
        target = y if t == 0 else 4 * y / (1 + np.exp(2 * y * score))

        def grow(rows, left):
            best = (1e-12, None)
            for f, at in ((f, c) for f in range(x.shape[1]) for c in cuts[f]) if left else ():
                go = x[rows, f] <= at
                if go.any() and not go.all():
                    a, b = target[rows[go]], target[rows[~go]]
                    gain = target[rows].var() - (len(a) * a.var() + len(b) * b.var()) / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (go,))
            if best[1] is None:
                value[rows] = target[rows].mean()
            else:
                go, = best[1]
                grow(rows[go], left - 1)
                grow(rows[~go], left - 1)

        value = np.zeros(len(y))
        grow(np.arange(len(y)), depth)
        score += value * (1.0 if t == 0 else step)
    return score


def test_same_scores_as_plain_code(spark, monkeypatch):
    monkeypatch.setattr(B, "STATE_TREES", 2)
    monkeypatch.setattr(B, "CHECKPOINT", 1)
    df = _rows(spark, 1500)
    p = ModelParams(n_trees=6, max_depth=3, subsample=1.0)
    model = M.fit_gbt(df, p)
    fills = M.fill_values(df)
    cuts = B.find_thresholds(df, list(fills), list(fills.values()))
    pdf = df.toPandas()
    x = np.stack([pdf[c].fillna(fills[c]).to_numpy() for c in fills], axis=1)
    want = _plain(x, np.where(pdf["label"] > 0, 1.0, -1.0), cuts, 6, 3, p.learning_rate)
    got = model.transform(df).select("id", M._p1().alias("p")).toPandas().set_index("id")["p"][pdf["id"]].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-2 * want)), atol=1e-9)


def test_quality_and_persistence(spark):
    df = _rows(spark, 20_000)
    p = ModelParams(n_trees=20)
    new, fills = M.fit_gbt(df, p), M.fill_values(df)
    old = M.gbt_pipeline(fills, p).fit(df)
    auc = [M.ranking_metrics(m.transform(df).select("label", M._p1().alias("s")), "s", "label").first()["roc_auc"]
           for m in (new, old)]
    assert auc[0] > auc[1] - 0.01 and new.stages[-1].getNumTrees == 20
    assert abs(sum(v for _, v in M.gbt_importances(new)) - 1) < 1e-9
    path = scratch_path(spark, "boosting-model")
    new.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    both = loaded.transform(new.transform(df).select(*ML_FEATURE_COLS, M._p1().alias("p")))
    assert both.filter(~F.col("p").eqNullSafe(M._p1())).isEmpty()
    assert loaded.stages[-1].getStepSize() == p.learning_rate and loaded.stages[-1].treeWeights == new.stages[-1].treeWeights


def test_few_bytes_a_row_are_held(spark):
    n, most, on = 400_000, [0], [True]
    df = _rows(spark, n)
    info = spark.sparkContext._jsc.sc().getRDDStorageInfo

    def watch():
        while on[0]:
            most[0] = max(most[0], sum(x.memSize() + x.diskSize() for x in info()))
            time.sleep(0.02)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        M.fit_gbt(df, ModelParams(n_trees=9))
    finally:
        on[0] = False
        thread.join()
    assert 0 < most[0] < 60 * n  # two states; Spark ML held 256 bytes a row
    assert not [x for x in info() if x.memSize()]


def test_edges(spark):
    df = _rows(spark, 300)
    p = ModelParams(n_trees=3)
    one = M.fit_gbt(df.withColumn("label", F.lit(1)), p)
    assert one.stages[-1].totalNumNodes == 3 and one.transform(df).filter(M._p1() < 0.8).isEmpty()
    flat = M.fit_gbt(df.withColumns({c: F.lit(None).cast("double") for c in ML_FEATURE_COLS}), p)
    assert flat.transform(df).select(M._p1()).distinct().count() == 1
    with pytest.raises(ValueError):
        M.fit_gbt(df.limit(0), p)


def test_cuts_of_a_value_that_most_rows_have(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 300, F.col("id") / 1000).otherwise(F.lit(5.0)).alias("v"))
    cut, = B.find_thresholds(df, ["v"], [0.0])
    assert len(cut) < B.BINS and (cut < 5.0).any()
