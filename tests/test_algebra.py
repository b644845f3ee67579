"""Algebraic properties of the distributed operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanrisk.operators.exposure import exact_median
from spanrisk.operators.model import ranking_metrics, stratified_folds
from spanrisk.operators.rank import global_rank, prefix_sums
from spanrisk.plans import pipeline as P
from tests.conftest import SF_SMALL


def _skewed(spark, n=3000):
    # a third of all rows share one score value (hot key), plus nulls
    return spark.range(n).select(
        F.col("id").cast("string").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).when(F.col("id") % 97 == 0, F.lit(None))
        .otherwise((F.col("id") * 7919 % 1000) / 1000.0).alias("s"),
        (F.col("id") % 5 == 0).cast("int").alias("y"))


def test_global_rank_is_plain_window_on_hot_key(spark):
    df = _skewed(spark)
    order = [F.col("s").desc_nulls_last(), F.col("k").asc()]
    got = global_rank(df, order=order, rank_col="r", num_partitions=7)
    ref = df.withColumn("r2", F.row_number().over(Window.orderBy(*order)))
    j = got.join(ref, "k")
    assert j.filter(F.col("r") != F.col("r2")).count() == 0
    assert got.agg(F.countDistinct("r")).first()[0] == df.count()


def test_prefix_sums_match_window(spark):
    df = _skewed(spark).withColumn("v", F.lit(1)).withColumn("w", F.col("y"))
    order = [F.col("k").asc()]
    got = prefix_sums(df, order, ["v", "w"], num_partitions=5)
    win = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = df.select("k", F.sum("v").over(win).alias("rv"), F.sum("w").over(win).alias("rw"))
    j = got.join(ref, "k")
    assert j.filter((F.col("cum_v") != F.col("rv")) | (F.col("cum_w") != F.col("rw"))).count() == 0


def test_exact_median_matches_numpy(spark):
    df = _skewed(spark).withColumn("g", (F.col("k").cast("int") % 3).cast("string"))
    got = {r["g"]: r["median"] for r in exact_median(df, "s", ["g"]).collect()}
    pdf = df.toPandas()
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx(float(np.median(sub["s"].dropna())))
    whole = exact_median(df, "s").first()["median"]
    assert whole == pytest.approx(float(np.median(pdf["s"].dropna())))


def _brute_auc_ap(scores, labels):
    scores, labels = np.asarray(scores), np.asarray(labels)
    pos, neg = scores[labels == 1], scores[labels == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    auc = gt / (len(pos) * len(neg))
    ap = 0.0
    for t in np.unique(scores)[::-1]:
        sel = scores >= t
        tp = (labels[sel] == 1).sum()
        ap += (labels[scores == t] == 1).sum() / len(pos) * tp / sel.sum()
    return auc, ap


def test_ranking_metrics_brute_force(spark):
    df = _skewed(spark, 1500).dropna()
    got = ranking_metrics(df, "s", "y").first()
    pdf = df.toPandas()
    auc, ap = _brute_auc_ap(pdf["s"].values, pdf["y"].values)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert got["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_folds_are_stratified(spark):
    df = _skewed(spark).withColumnRenamed("y", "label").withColumnRenamed("k", "STATE_CODE") \
        .withColumn("STRUCTURE_NUMBER", F.col("STATE_CODE"))
    f = stratified_folds(df, "label", 3, 42)
    sizes = f.groupBy("label", "fold").count().toPandas()
    for _, g in sizes.groupby("label"):
        assert g["count"].max() - g["count"].min() <= 8


def test_tiers_and_rates(spark):
    ex = P.exposure_table(spark, SF_SMALL, with_rank=True)
    n = ex.count()
    assert sum(r["count"] for r in ex.groupBy("severity").count().collect()) == n
    bad = ex.filter((F.col("fatality_rate") + F.col("injury_rate") > 1.0 + 1e-9) | (F.col("fatality_rate") < 0))
    assert bad.count() == 0
    ranks = ex.agg(F.min("severity_rank"), F.max("severity_rank"), F.countDistinct("severity_rank")).first()
    assert tuple(ranks) == (1, n, n)
