"""Forward checks against published figures: the published top records and
calibration points must follow from our expressions."""

import pytest
from pyspark.sql import functions as F

from spanrisk.functions.columns import round_half_even
from spanrisk.operators.exposure import collapse_probability
from spanrisk.operators.maplayer import odds_label

# FIXED VALUES — two published top-exposure records:
# (p_collapse_1yr, rush_hour_persons, fatality_rate, injury_rate,
#  expected_fatalities, expected_injuries, expected_affected)
PUBLISHED_RECORDS = [
    (0.0005316783052378325, 1222.5749999999998, 0.71, 0.22, 0.46151, 0.143, 0.65002),
    (0.00021522833776338148, 1639.041403895, 0.4, 0.45, 0.14111, 0.15875, 0.35277),
]


def test_expected_casualties_recompute(spark):
    df = spark.createDataFrame(PUBLISHED_RECORDS, "p double, n double, fr double, ir double, ef double, ei double, ea double")
    out = df.select(round_half_even(F.col("p") * F.col("n") * F.col("fr"), 5).alias("ef2"),
                    round_half_even(F.col("p") * F.col("n") * F.col("ir"), 5).alias("ei2"),
                    round_half_even(F.col("p") * F.col("n"), 5).alias("ea2"), "ef", "ei", "ea").collect()
    for r in out:
        assert (r["ef2"], r["ei2"], r["ea2"]) == (r["ef"], r["ei"], r["ea"])


def test_collapse_calibration_and_odds(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,)], "s double")
    rows = df.select(collapse_probability(F.col("s")).alias("p")).select(
        "p", odds_label(F.col("p")).alias("odds")).collect()
    assert rows[0]["p"] == pytest.approx(1.3e-5)
    assert rows[-1]["p"] == pytest.approx(2.5e-3)
    assert [r["odds"] for r in rows] == ["1 in 76,923", "1 in 20,657", "1 in 5,547", "1 in 1,490", "1 in 400"]
