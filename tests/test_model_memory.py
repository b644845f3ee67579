"""Fits of many rows run one at a time: side by side their cached rows would not fit into memory."""

import threading
import time

from pyspark.sql import functions as F

from spanrisk.operators import model as M
from spanrisk.params import ML_FEATURE_COLS, ModelParams


class _Half:
    """A fitted model that gives every row one half."""

    def transform(self, df):
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))


def _most_at_once(spark, monkeypatch, rows_at_once: int) -> int:
    running, most, lock = [0], [0], threading.Lock()

    def fit(fm, p):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.5)
        with lock:
            running[0] -= 1
        return _Half()

    monkeypatch.setattr(M, "fit_gbt", fit)
    monkeypatch.setattr(M, "ROWS_AT_ONCE", rows_at_once, raising=False)
    df = spark.range(300).select(
        F.lit("16").alias("STATE_CODE"), F.col("id").cast("string").alias("STRUCTURE_NUMBER"),
        *[F.rand(1).alias(c) for c in ML_FEATURE_COLS], (F.col("id") % 3 == 0).cast("int").alias("label"))
    assert M.oof_probability(df, ModelParams(n_folds=3)).count() == 300
    return most[0]


def test_large_fits_run_one_at_a_time(spark, monkeypatch):
    assert _most_at_once(spark, monkeypatch, rows_at_once=250) == 1  # 200 rows in each training set


def test_small_fits_still_overlap(spark, monkeypatch):
    assert _most_at_once(spark, monkeypatch, rows_at_once=600) == 3


def test_fits_at_once():
    assert M.fits_at_once(24_000_000, 3) == 1
    assert M.fits_at_once(400_000, 4) == 4
    assert M.fits_at_once(0, 3) == 3
    assert M.fits_at_once(400_000, 0) == 1
