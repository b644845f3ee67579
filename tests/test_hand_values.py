"""Hand-worked inputs and results of the feature, index and exposure rules, and of empty, null and one-class input."""

import pytest
from pyspark.sql import functions as F

from spanrisk.operators import exposure as X
from spanrisk.operators import features as E
from spanrisk.operators import model as M
from spanrisk.operators import summary as S
from spanrisk.operators.clean import decode_latitude, decode_longitude
from spanrisk.operators.rank import format_output, state_summary
from spanrisk.plans import pipeline as P
from tests.conftest import SF_SMALL


def values(spark, schema, rows, col):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    c = col(df) if col.__code__.co_argcount else col()
    return [r[0] for r in df.select(c.alias("y")).collect()]


@pytest.mark.parametrize("schema, rows, col, want", [
    ("x string", ["39300000", "9300000", "39301234", None, "abc"], lambda: decode_latitude(F.col("x")),
     [39.5, 9.5, 39.5034277778, None, None]),
    ("x string", ["104450000", "080000036", None], lambda: decode_longitude(F.col("x")), [-104.75, -80.0001, None]),
    ("x double", [2024.0, 1904.0, 1800.0, None, 2030.0], lambda: E.age_norm(E.age_years(F.col("x"))),
     [0.0, 1.0, 1.0, 0.5 ** 0.7, 0.5 ** 0.7]),
    ("x double", [0.0, 200000.0, 900000.0, None], lambda: E.traffic_log_norm(F.col("x")), [0.0, 1.0, 1.0, 0.0]),
    ("x double", [5.0, 0.0, 2.5, None, 9.0], lambda: E.load_posted(F.col("x")), [0.0, 1.0, 0.5, 0.0, 0.0]),
    ("a double, b double, c double", [(1.0, 0.0, 0.0), (0.2, 0.4, 0.6)],
     lambda: E.bridge_struct_risk(F.col("a"), F.col("b"), F.col("c")), [0.45, 0.35]),
    ("a double, b double", [(0.4, 0.5), (1.0, 1.0), (0.0, 1.0)],
     lambda: E.scour_interaction(F.col("a"), F.col("b")), [0.5, 1.0, 0.0]),
    ("x string", ["Y24", "N", None, "y"], lambda: E.fracture_flag(F.col("x")), [1, 0, 0, 0]),
    ("x string", ["K", " P ", "A", None], lambda: E.closed_flag(F.col("x")), [1, 1, 0, 0]),
    ("x double", [0.0, 1.0, 2.0, -1.0], lambda: X.collapse_probability(F.col("x")),
     [1.3e-5, 2.5e-3, 2.5e-3, 1.3e-5]),
    ("x double", [None, 50.0, 130.0, -3.0], lambda: X.truck_fraction(F.col("x")), [0.1, 0.5, 1.0, 0.0]),
    ("a double, b double", [(0.25, 0.0), (0.25, 1.0), (0.25, 0.5), (0.95, 1.0)],
     lambda: X.truck_adjusted_fatality(F.col("a"), F.col("b")), [0.25, 0.4, 0.325, 1.0]),
    # 80 km/h over 80 m is 0.001 h; over 40 m at 40 km/h too; lengths are held between 5 and 5,000 m
    ("structure_len_m double, bridge_posting double, adt double, pct_truck double",
     [(80.0, 5.0, 100000.0, 0.0), (40.0, 3.0, 100000.0, 100.0), (80.0, None, 100000.0, 50.0), (1.0, 5.0, 16000.0, 0.0),
      (80.0, 5.0, None, 0.0), (80.0, 5.0, -4.0, 0.0)],
     lambda df: X.rush_hour_occupancy(df), [16.7, 11.0, 13.85, 0.167, 0.0, 0.0]),
])
def test_rules(spark, schema, rows, col, want):
    assert values(spark, schema, rows, col) == [w if w is None else pytest.approx(w, abs=1e-9) for w in want]


def test_condition_risk_cases(spark):
    rows = [(None, None, None, 3.0), (5.0, None, None, None), (5.0, 5.0, 5.0, 3.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "DECK_COND double, SUPERSTR_COND double, SUBSTR_COND double, CULVERT_COND double")
    got = [r[0] for r in df.select(E.condition_risk(df, F.lit(0.2), F.lit(0.6))).collect()]
    assert got == pytest.approx([0.6, 0.2, 0.4, 0.2])


def test_medians(spark):
    rows = [("a", 1.0)] * 700 + [("a", 5.0), ("a", 7.0), ("b", 4.0), ("b", 2.0), ("c", None), ("d", 3.0)] + [("e", 0.0)] * 4
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["median"] for r in X.exact_median(df, "v", ["g"]).collect()}
    assert got == {"a": 1.0, "b": 3.0, "d": 3.0, "e": 0.0}
    assert X.exact_median(df.filter("g IN ('b', 'd')"), "v").first()["median"] == 3.0
    assert X.exact_median(df.filter("g = 'c'"), "v").first()["median"] is None


def test_median_leaves_no_files(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    df = spark.createDataFrame([("a", float(i)) for i in range(50)], "g string, v double")
    before = set(os.listdir(folder))
    X.exact_median(df, "v", ["g"]).collect()
    assert set(os.listdir(folder)) == before


def test_tier_plans_do_not_move_rows_by_tier(spark):
    """With small broadcasts switched off, no exchange on the tier stands above the rows themselves."""
    ex = P.exposure_table(spark, SF_SMALL).select("severity", F.col("risk_score").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = X.tier_histogram(ex, "v", "severity", 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below_scan = [x for x in plan.split("\n") if "Exchange" in x]
    assert all("HashAggregate" in plan for _ in below_scan) and "SortMergeJoin" in plan
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("partitions", [8, 200, 2000])
def test_folds_do_not_depend_on_the_session(spark, partitions):
    df = spark.range(3001).selectExpr("cast(id % 60 as string) STATE_CODE", "cast(id as string) STRUCTURE_NUMBER",
                                      "cast(id % 7 = 0 as int) label")
    base = {(r[0], r[1]): r[2] for r in M.stratified_folds(df).select(*M.KEY, "fold").collect()}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = M.stratified_folds(df).select(*M.KEY, "label", "fold").collect()
        assert {(r[0], r[1]): r[3] for r in rows} == base
        for label in (0, 1):
            sizes = [sum(r[2] == label and r[3] == f for r in rows) for f in range(3)]
            assert max(sizes) - min(sizes) <= 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_rows_nulls_and_one_class(spark):
    ex = P.exposure_table(spark, SF_SMALL)
    assert X.exposure_totals(ex.limit(0)).first()["water_crossings_pct"] is None
    out = format_output(P.scored(spark, SF_SMALL))
    no_age = out.withColumn("bridge_age", F.lit(None).cast("double"))
    conds = ("deck_condition", "superstr_condition", "substr_condition", "culvert_condition")
    no_age = no_age.withColumns({c: F.lit(None).cast("double") for c in conds})
    rec = S.statistics_record(no_age, state_summary(P.scored(spark, SF_SMALL))).first()
    assert rec["median_age"] is None and rec["pct_over_50"] is None and rec["pct_min_cond_poor"] is None
    assert rec["total_bridges"] == out.count() and rec["riskiest_state"]
    empty = S.statistics_record(out.limit(0), state_summary(P.scored(spark, SF_SMALL).limit(0))).first()
    assert empty["total_bridges"] == 0 and empty["pct_critical"] is None and empty["riskiest_state"] is None
    one = spark.createDataFrame([(0.5, 1), (0.7, 1)], "s double, y int")
    assert M.ranking_metrics(one, "s", "y").first()["roc_auc"] is None
    none = M.ranking_metrics(one.withColumn("y", F.lit(0)), "s", "y").first()
    assert none["roc_auc"] is None and none["average_precision"] is None


def test_local_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from spanrisk.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
