"""Deficiency index, probability column, composite score and severity tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrisk.functions.columns import clip
from spanrisk.params import DEFAULT_MODEL, TIER_CUTOFFS, ModelParams


def deficiency_index(df: DataFrame, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of present features (NULL counts as 0), clipped to [0, 1]."""
    w = weights if weights is not None else DEFAULT_MODEL.sdi_weights
    terms = [F.lit(float(wt)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
             for c, wt in w.items() if c in df.columns]
    total = reduce(lambda a, b: a + b, terms, F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def proxy_probability(age_norm: Column, scour: Column) -> Column:
    """Deterministic stand-in for the model probability (fixture/oracle runs)."""
    return F.round(1.0 / (1.0 + F.exp(-(6.0 * age_norm + 2.0 * scour - 6.0))), 6)


def composite_score(sdi: Column, proba: Column) -> Column:
    return clip(0.5 * sdi + 0.5 * proba, 0.0, 1.0)


def severity_tier(score: Column) -> Column:
    """>= .75 Critical, >= .5 High, >= .25 Medium, otherwise Low."""
    out = None
    for name, cut in TIER_CUTOFFS:
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out.otherwise("Low")


def with_sdi(df: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    return df.withColumn("SDI", deficiency_index(df, p.sdi_weights))


def score(df: DataFrame, proba: str = "proxy", p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Feature table -> + SDI, ML_PROBA, RISK_SCORE, SEVERITY.

    ``proba`` picks the probability column: ``"proxy"`` (deterministic fixture
    probability), ``"index"`` (the published fallback when labels are too few:
    probability = SDI) or ``"given"`` (an ``ML_PROBA`` column already present,
    e.g. the out-of-fold model output).
    """
    df = with_sdi(df, p)
    if proba == "proxy":
        df = df.withColumn("ML_PROBA", proxy_probability(F.col("AGE_NORM"), F.col("SCOUR_RISK")))
    elif proba == "index":
        df = df.withColumn("ML_PROBA", F.col("SDI"))
    elif proba != "given":
        raise ValueError(f"unknown probability source {proba!r}")
    df = df.withColumn("RISK_SCORE", composite_score(F.col("SDI"), F.col("ML_PROBA")))
    return df.withColumn("SEVERITY", severity_tier(F.col("RISK_SCORE")))
