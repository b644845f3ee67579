"""Map-layer table: the data behind the interactive map (no drawing).

Takes the exposure table as input, so probability, occupancy and casualty
fields are filled (the published map read them from a table that lacked them).
Every label is a Column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrisk.functions.columns import clip, map_lookup, strip_ws, dround
from spanrisk.operators.features import min_structural_condition
from spanrisk.params import CATEGORY_LABELS, CONDITION_LABELS

ICON_MIN, ICON_MAX = 6.0, 30.0
ADT_LOG_MAX = math.log(1_000_000)


def map_filter(ex: DataFrame) -> DataFrame:
    """Critical and High structures only."""
    return ex.filter(F.col("severity").isin("Critical", "High"))


def icon_scale(adt: Column) -> Column:
    """6 + 24 * clip(ln(adt + 1) / ln(1e6), 0, 1)^2 (quadratic), NULL traffic -> 0."""
    norm = clip(F.log(F.coalesce(adt, F.lit(0.0)) + 1.0) / ADT_LOG_MAX, 0.0, 1.0)
    return ICON_MIN + F.pow(norm, 2) * (ICON_MAX - ICON_MIN)


def format_count(c: Column, digits: int = 0) -> Column:
    """Thousands separators, NULL -> 'N/A'."""
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_number(c, digits))


def text_fallback(c: Column, default: str, width: int = 40) -> Column:
    return F.substring(F.coalesce(F.nullif(strip_ws(c), F.lit("")), F.lit(default)), 1, width)


def condition_label(min_cond: Column) -> Column:
    key = F.when(min_cond == F.floor(min_cond), min_cond.cast("int"))
    return map_lookup(key, CONDITION_LABELS, "N/A")


def category_label(cat: Column) -> Column:
    return map_lookup(strip_ws(cat), CATEGORY_LABELS, "N/A")


def odds_label(p: Column) -> Column:
    """'1 in N' with N = round(1/p) and thousands separators; else 'N/A'."""
    return F.when(p > 0, F.concat(F.lit("1 in "), F.format_number(F.round(1.0 / p, 0), 0))).otherwise(F.lit("N/A"))


def _whole(c: Column) -> Column:
    return F.bround(c.cast("decimal(38,15)"), 0).cast("bigint")


def percent_label(rate: Column) -> Column:
    return F.when(rate.isNull(), F.lit("N/A")).otherwise(F.concat(_whole(rate * 100.0).cast("string"), F.lit("%")))


def persons_label(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("N/A")).otherwise(_whole(x).cast("string"))


def layer_counts(ex: DataFrame) -> DataFrame:
    """Features per map layer (Critical, High) with geo present, and the layer name."""
    g = map_filter(ex).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()) \
        .groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("layer_name", F.concat(F.col("severity"), F.lit(" Bridges ("),
                                               F.format_number(F.col("n"), 0), F.lit(")")))


#: Data properties of a map feature, by their names in ``map_properties``.
DATA_PROPERTIES = ["structure_number", "facility", "crosses", "state", "risk_score", "severity", "severity_rank",
                   "adt_text", "built_text", "condition", "rush_persons", "icon_size", "collapse_prob"]


def map_properties(ex: DataFrame) -> DataFrame:
    """One row per mapped structure with every tooltip/popup field as a column."""
    mc = min_structural_condition(F.col("deck_condition"), F.col("superstr_condition"),
                                  F.col("substr_condition"), F.col("culvert_condition"))
    loc = F.col("location") if "location" in ex.columns else F.lit(None).cast("string")
    return map_filter(ex).select(
        "state_code", "structure_number", "lat", "lon", "severity", "severity_rank", "risk_score",
        text_fallback(F.col("facility_carried"), "Unknown").alias("facility"),
        text_fallback(F.col("features_intersected"), "—").alias("crosses"),
        text_fallback(loc, "—").alias("location_text"),
        text_fallback(F.col("state_name"), "Unknown").alias("state"),
        dround(icon_scale(F.col("adt")), 1).alias("icon_size"),
        format_count(F.col("adt")).alias("adt_text"),
        format_count(F.col("year_built")).alias("built_text"),
        format_count(F.col("bridge_age")).alias("age_text"),
        condition_label(mc).alias("condition"),
        category_label(F.col("bridge_condition_category")).alias("category_text"),
        odds_label(F.col("p_collapse_1yr")).alias("collapse_prob"),
        persons_label(F.col("rush_hour_persons")).alias("rush_persons"),
        percent_label(F.col("fatality_rate")).alias("fatality_text"),
        percent_label(F.col("injury_rate")).alias("injury_text"),
        F.when(F.col("is_water_crossing"), "Yes (water)").otherwise("Land").alias("crossing_type"),
    )
