"""The clean stage is derived and written in one pass, and its numbers are parsed as before."""

from itertools import product

from pyspark.sql import functions as F

from spanrisk import stages
from spanrisk.functions.columns import strip_ws
from spanrisk.operators.clean import coerce_conditions, coerce_numeric, coerce_ratings
from spanrisk.plans import pipeline as P
from spanrisk.plans.q_sources import q_stage_parquet
from tests.conftest import SF_SMALL


def test_clean_stage_needs_no_typed_stage(spark, monkeypatch):
    monkeypatch.setattr(stages, "_CURRENT", {})
    back = q_stage_parquet(spark, SF_SMALL)
    assert not [key for key in stages._CURRENT if key[1] == "typed"]
    monkeypatch.setattr(stages, "_CURRENT", {})
    once, staged = P.cleaned_once(spark, SF_SMALL), P.cleaned(spark, SF_SMALL)
    assert once.schema == staged.schema
    assert back.count() == staged.count() > 0
    assert once.exceptAll(staged).isEmpty() and staged.exceptAll(once).isEmpty()


def test_clean_stage_reads_a_typed_stage_that_is_there(spark, monkeypatch):
    monkeypatch.setattr(stages, "_CURRENT", {})
    P.cleaned(spark, SF_SMALL)
    assert "CollectMetrics" not in P.cleaned_once(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_row_filters_stay_above_the_typing(spark, monkeypatch):
    """Pushed into the derivation, a filter on a coordinate would repeat its decoding many times."""
    monkeypatch.setattr(stages, "_CURRENT", {})
    plan = P.cleaned_once(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("CollectMetrics")
    assert "LAT_016" not in plan[:plan.index("CollectMetrics")]


def test_codes_of_ratings_do_not_reach_the_parser(spark):
    df = spark.createDataFrame([("N",)], "SCOUR_CRITICAL string")
    assert "octet_length" in coerce_ratings(df)._jdf.queryExecution().analyzed().toString()


def test_numbers_with_white_space(spark):
    ends = ["", " ", "\t", "\n", "\x0b", "\x0c", " \t", "\x00", "\xa0"]
    texts = ["5", "N", "U", "-3", "1e3", ".5", "nan", "-inf", "5d", "", "A1", "1 2", ":"]
    rows = [(a + x + b,) * 3 for a, x, b in product(ends, texts, ends)] + [(None,) * 3]
    df = spark.createDataFrame(rows, "ADT string, DECK_COND string, SCOUR_CRITICAL string")
    got = coerce_ratings(coerce_conditions(coerce_numeric(df.withColumn("text", F.col("ADT")))))
    want = strip_ws(F.col("text")).try_cast("double")
    for c in ("ADT", "DECK_COND", "SCOUR_CRITICAL"):
        assert got.filter(~F.col(c).eqNullSafe(want)).isEmpty(), c
