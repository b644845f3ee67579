"""What the plans promise: method sizes, pushed bounds, no shuffle of wide rows, reads that do not depend on the data."""

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from spanrisk import stages as T
from spanrisk.operators import exposure as X
from spanrisk.operators import model as M
from spanrisk.operators import summary as S
from spanrisk.operators.clean import typed, valid_rows
from spanrisk.operators.features import engineer_features
from spanrisk.operators.rank import OUTPUT_COLUMNS, format_output, rank_stage
from spanrisk.operators.score import score
from spanrisk.plans import pipeline as P
from spanrisk.session import scratch_path, scratch_scope
from tests.conftest import SF_SMALL

JIT_LIMIT = 8000


def explained(df, mode):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def method_sizes(df):
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", explained(df, "codegen"))]


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    types = T.staged_table(spark, "typed", P.inventory_inputs(SF_SMALL), lambda: typed(P.renamed(spark, SF_SMALL)))
    features = P.featured(spark, SF_SMALL)
    for df in (typed(P.renamed(spark, SF_SMALL)), engineer_features(valid_rows(types)), score(features, "proxy"),
               X.exposure(P.output_unranked(spark, SF_SMALL)), X.exposure(P.ranked_output(spark, SF_SMALL))):
        sizes = method_sizes(df)
        assert sizes and max(sizes) < JIT_LIMIT


def test_stages_are_written_by_compiled_methods(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    P.scored(spark, SF_SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= JIT_LIMIT


def test_a_row_is_stored_as_few_times_as_it_is_needed(spark):
    """Features and scores in one stage, exposure on read, and no unpublished column moved to its rank."""
    T.forget_stages()
    assert "SDI" not in P.featured(spark, SF_SMALL).columns
    for ranked in (False, True):
        assert "expected_affected" in P.exposure_table(spark, SF_SMALL, with_rank=ranked).columns
    assert {key[1] for key in T._CURRENT} == {"typed", "scored_proxy", "ranked_proxy"}
    held = P.ranked_stage(spark, SF_SMALL).stored
    assert set(held.columns) <= {*OUTPUT_COLUMNS, "_pid", "_pos"}


def test_row_filters_reach_the_scan(spark):
    plan = explained(P.cleaned(spark, SF_SMALL), "formatted")
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(LAT,", plan)


def test_first_ranks_read_the_first_files(spark):
    plan = explained(P.ranked_stage(spark, SF_SMALL).upto(100), "formatted")
    assert re.search(r"PushedFilters: .*LessThanOrEqual\(_pid,", plan)
    df = spark.range(5000).withColumn("s", F.col("id") % 7).repartition(6)
    stage = rank_stage(df, [F.col("s").desc(), F.col("id").asc()], "r", 9)
    for n in (0, 1, 600, 4999, 5000, 6000):
        got = [r["r"] for r in stage.upto(n).select("r").collect()]
        assert sorted(got) == list(range(1, min(n, 5000) + 1))
    some = stage.upto(300)
    read = {r[0] for r in some.select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(read) <= 2


def jobs(spark, name, fn):
    spark.sparkContext.setJobGroup(name, name)
    try:
        fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_sample_reads_twice_whatever_it_samples(spark):
    df = spark.range(20_000).selectExpr("cast(id % 50 as string) state_code", "cast(id as string) structure_number")
    h = F.md5(F.concat_ws("|", "state_code", "structure_number", F.lit("42")))
    counts = set()
    for n in (0, 1, 10, 3000, 20_000, 50_000):
        got = []
        counts.add(jobs(spark, f"sample{n}", lambda n=n: got.extend(S.exact_sample(df, n, 42).collect())))
        want = df.withColumn("h", h).orderBy("h").limit(n).drop("h").collect()
        assert sorted(got) == sorted(want)
    assert max(counts) <= 6  # adaptive execution runs each shuffle of the two reads as a job


def test_folds_shuffle_no_wide_rows(spark):
    feats = P.featured(spark, SF_SMALL).withColumn("label", F.coalesce("IS_POOR", F.lit(0)))
    plan = explained(M.stratified_folds(feats), "formatted")
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_folds_of_repeated_keys(spark, share):
    """Rows of one key (null, or repeated) may be a large part; sizes still differ by one at most, and no row is lost."""
    df = spark.range(3002).selectExpr(
        f"if(id < 3002 * {share}, null, cast(id % 60 as string)) STATE_CODE",
        f"if(id < 3002 * {share}, 'x', cast(id div 3 as string)) STRUCTURE_NUMBER", "cast(id % 5 = 0 as int) label",
        "id row").repartition(4)
    rows = M.stratified_folds(df).collect()
    assert sorted(r["row"] for r in rows) == list(range(3002))
    for label in (0, 1):
        sizes = [sum(r["label"] == label and r["fold"] == f for r in rows) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
    few = spark.createDataFrame([("a", "1", 0), ("a", "2", 0), ("a", "3", 1)], "STATE_CODE string, STRUCTURE_NUMBER string, label int")
    assert len(M.stratified_folds(few).collect()) == 3 and M.stratified_folds(few.limit(0)).collect() == []


def test_stage_follows_its_input(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(10).write.parquet(source)
    built = []

    def read():
        def build():
            built.append(1)
            return spark.read.parquet(source)

        return T.staged_table(spark, "follows", [source], build)

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    stages = lambda: [x for x in os.listdir(folder) if x.startswith("follows-")]
    assert [read().count() for _ in range(3)] == [10] * 3 and len(built) == 1
    for n in range(2, 6):
        spark.range(10 * n).write.mode("overwrite").parquet(source)
        assert read().count() == 10 * n and len(built) == n
        assert len(stages()) <= 2
    T.drop_stages(spark)
    assert stages() == []


def test_scope_deletes_what_was_made_inside(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch_scope(spark):
        spark.range(3).write.parquet(scratch_path(spark, "scoped"))
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before
    assert format_output(P.scored(spark, SF_SMALL)).count() > 0


def test_letter_codes_skip_the_parser(spark):
    """The parser tells of a text that is no number by an exception, which costs many times a number."""
    from spanrisk.functions.columns import to_double
    from spanrisk.operators.clean import coerce_conditions

    want = {"N": None, "": None, "é": None, ".": None, "7": 7.0, "0": 0.0, "-5": -5.0, "1e3": 1000.0, " .5 ": 0.5, "4d": 4.0,
            "inf": float("inf"), "-Infinity": -float("inf"), "NA": None, "x1": None, "٣": None, None: None}
    rows = spark.createDataFrame([(k, k) for k in want], "t string, DECK_COND string")
    df = coerce_conditions(rows).select("t", F.col("DECK_COND").alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == want
    assert "octet_length" in df._jdf.queryExecution().optimizedPlan().toString()
    plain = rows.select("t", to_double(F.trim("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in plain} == want


def test_a_feature_is_read_from_typed_columns(spark):
    """One feature writes no table of all features, and reads the columns that it takes."""
    T.forget_stages()
    plan = explained(P.features(spark, SF_SMALL).select("AGE_NORM"), "formatted")
    assert {key[1] for key in T._CURRENT} == {"typed"}
    read = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"RECORD_TYPE", "YEAR_BUILT", "LAT", "LON"}


def test_rank_moves_no_column_that_follows_from_others(spark):
    T.forget_stages()
    held = P.ranked_stage(spark, SF_SMALL).stored
    assert {key[1] for key in T._CURRENT} == {"typed", "ranked_proxy"}  # no scored table is written for the rank alone
    same = P.scored(spark, SF_SMALL)
    columns = [c for c in OUTPUT_COLUMNS if c in same.columns]
    assert held.select(*columns).exceptAll(same.select(*columns)).isEmpty() and held.count() == same.count()
    assert "AGE_NORM" not in same.columns
