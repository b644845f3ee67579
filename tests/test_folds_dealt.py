"""Folds are dealt row by row in hash order, and rows of one key are numbered like all others."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanrisk.operators import model as M


@pytest.mark.parametrize("partitions", [1, 7])
def test_rows_are_dealt_in_turn(spark, partitions):
    df = spark.range(500).selectExpr("cast(id % 60 as string) STATE_CODE", "cast(id as string) STRUCTURE_NUMBER",
                                     "if(id % 7 = 0, null, cast(id % 3 = 0 as int)) label").repartition(partitions)
    rows = M.stratified_folds(df).collect()
    want = {}
    for label in (0, 1, None):
        keys = [(r["STATE_CODE"], r["STRUCTURE_NUMBER"]) for r in rows if r["label"] == label]
        keys.sort(key=lambda k: (hashlib.md5("|".join([*k, "42"]).encode()).hexdigest(), k))
        want |= {k: i % 3 for i, k in enumerate(keys)}
    assert len(rows) == 500 and {(r["STATE_CODE"], r["STRUCTURE_NUMBER"]): r["fold"] for r in rows} == want
    assert rows[0].__fields__ == ["STATE_CODE", "STRUCTURE_NUMBER", "label", "fold"]


def test_rows_of_one_key_are_dealt_too(spark):
    df = spark.range(301).select(F.lit(None).cast("string").alias("STATE_CODE"), F.lit("x").alias("STRUCTURE_NUMBER"),
                                 F.lit(1).alias("label")).repartition(5)
    assert sorted(r["count"] for r in M.stratified_folds(df).groupBy("fold").count().collect()) == [100, 100, 101]


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_interval_folds_of_repeated_keys(spark, share):
    df = spark.range(3002).selectExpr(
        f"if(id < 3002 * {share}, null, cast(id % 60 as string)) STATE_CODE",
        f"if(id < 3002 * {share}, 'x', cast(id div 3 as string)) STRUCTURE_NUMBER", "cast(id % 5 = 0 as int) label",
        "id row").repartition(4)
    rows = M.interval_folds(df).collect()
    assert sorted(r["row"] for r in rows) == list(range(3002))
    for label in (0, 1):
        sizes = [sum(r["label"] == label and r["fold"] == f for r in rows) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
