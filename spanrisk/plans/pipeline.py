"""Stage composition: raw inventory -> clean -> features -> scores -> ranked output.

Each stage is a lazy DataFrame; nothing is materialised until an action, so a
query that needs only the state summary never pays for the global rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrisk.operators.clean import typed, valid_rows
from spanrisk.operators.features import age_years, engineer_features
from spanrisk.operators.model import feature_matrix
from spanrisk.operators.rank import OUTPUT_COLUMNS, RankedStage, format_output, rank_stage, state_name
from spanrisk.operators.score import score, severity_tier
from spanrisk.params import DEFAULT_MODEL, ModelParams
from spanrisk.session import compile_small_methods
from spanrisk.sources.delimited import normalise_nulls, rename_columns
from spanrisk.sources.inventory import inventory_inputs, raw_inventory, staged_raw_inventory
from spanrisk.stages import forget_stages, has_stage, stage, staged_table


def stage_once(spark: SparkSession, name: str, sf_dir: str, build, parameters: object = None) -> DataFrame:
    """``build()`` as a stage of the inventory's input tables. Fan-out points (the typed, scored and ranked
    tables) are staged so that every downstream output reads plain columns instead of re-deriving (and re-inlining) the
    whole projection."""
    return staged_table(spark, name, inventory_inputs(sf_dir), build, parameters)


def reset_stages() -> None:
    """Forget staged tables (the benchmark times every stage from scratch)."""
    forget_stages()


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_columns(normalise_nulls(staged_raw_inventory(spark, sf_dir)))


def cleaned(spark: SparkSession, sf_dir: str, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    # made from the derivation itself: the raw texts are stored only for queries that read them
    raw = raw_inventory(spark, sf_dir)
    types = stage_once(spark, "typed", sf_dir, lambda: typed(rename_columns(normalise_nulls(raw)), p), p)
    return valid_rows(types, p)


def cleaned_once(spark: SparkSession, sf_dir: str, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """``cleaned`` for a reader that takes all columns once and stores them itself: where there is no typed stage yet, none
    is written. The count of the typed rows keeps the row filters above it, so that they read decoded columns there too."""
    if has_stage(spark, "typed", inventory_inputs(sf_dir), p):
        return cleaned(spark, sf_dir, p)
    compile_small_methods(spark)
    types = typed(rename_columns(normalise_nulls(raw_inventory(spark, sf_dir))), p)
    return valid_rows(types.observe("typed_rows", F.count(F.lit(1)).alias("n")), p)


#: What scoring adds to the features.
_SCORE_COLS = ("SDI", "ML_PROBA", "RISK_SCORE", "SEVERITY", "STATE_NAME")


def features(spark: SparkSession, sf_dir: str, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """The feature table made on read: a query computes the features that it asks for from the typed columns that they
    take, and none is written. A reader that goes over many features several times stores them (``model_inputs``)."""
    return engineer_features(cleaned(spark, sf_dir, p), p)


def featured(spark: SparkSession, sf_dir: str, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """The feature table as a stage, with the scores beside it, for callers that read most of it many times."""
    rows = stage_once(spark, "scored_proxy", sf_dir, lambda: _score(features(spark, sf_dir, p), "proxy", p), ("all", p))
    return rows.drop(*_SCORE_COLS)


def model_inputs(spark: SparkSession, sf_dir: str, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Key, model inputs and label as a stage: medians, folds and trees read them many times."""
    return stage_once(spark, "model_inputs", sf_dir, lambda: feature_matrix(features(spark, sf_dir, p)), p)


def _score(feats: DataFrame, proba: str, p: ModelParams) -> DataFrame:
    out = score(feats, proba, p)
    return out.withColumn("STATE_NAME", state_name(out["STATE_CODE"]))


def _published(rows: DataFrame, *others: str) -> DataFrame:
    return rows.select(*[c for c in OUTPUT_COLUMNS if c in rows.columns], *others)


def scored(spark: SparkSession, sf_dir: str, proba: str = "proxy", p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Published columns of the scored table and the label: what the outputs are made of. Features are not stored."""
    return stage_once(spark, f"scored_{proba}", sf_dir,
                      lambda: _published(_score(features(spark, sf_dir, p), proba, p), "IS_POOR"), p)


def ranked_stage(spark: SparkSession, sf_dir: str, proba: str = "proxy", p: ModelParams = DEFAULT_MODEL) -> RankedStage:
    """Published columns of the scored table in rank order. The rank's own sorted stage is the stage here, so a scored row
    is written once, in its place; columns that nothing publishes are not moved, and those that follow from others are
    made at their place."""
    def build(path: str) -> RankedStage:
        rows = _published(_score(features(spark, sf_dir, p), proba, p))
        follow = {"SEVERITY": severity_tier(F.col("RISK_SCORE")), "STATE_NAME": state_name(F.col("STATE_CODE")),
                  "BRIDGE_AGE": age_years(F.col("YEAR_BUILT"), p)}
        return rank_stage(rows.drop(*follow), path=path, follow=follow)

    return stage(spark, f"ranked_{proba}", inventory_inputs(sf_dir), build, p).held


def ranked(spark: SparkSession, sf_dir: str, proba: str = "proxy", p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Published columns of the scored table with the global rank."""
    return ranked_stage(spark, sf_dir, proba, p).table()


def ranked_output(spark: SparkSession, sf_dir: str, proba: str = "proxy",
                  p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """The published ranked table (lower-case column names, state name added)."""
    return format_output(ranked(spark, sf_dir, proba, p))


def output_unranked(spark: SparkSession, sf_dir: str, proba: str = "proxy") -> DataFrame:
    """Published output columns without the global rank (for rank-free aggregates)."""
    return format_output(scored(spark, sf_dir, proba))


def exposure_table(spark: SparkSession, sf_dir: str, with_rank: bool = False, proba: str = "proxy") -> DataFrame:
    """Exposure columns over the output table. They are plain expressions over stored columns, so they are made on read,
    those that a query asks for, and not written."""
    from spanrisk.operators.exposure import exposure

    return exposure((ranked_output if with_rank else output_unranked)(spark, sf_dir, proba))
