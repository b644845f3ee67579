"""Engineering risk features as one projection over the clean table.

Every feature is a ``Column`` expression; ``engineer_features`` adds them all in
a single ``select`` so the whole step is one codegen stage, no shuffle.
Optional inputs that are absent from the schema get the published constant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrisk.functions.columns import bool_to_int, bounded, bounded_or, cond_to_risk, map_lookup, strip_ws, to_int, zpad
from spanrisk.params import (
    DEFAULT_MODEL, DESIGN_LOAD_RISK_DEFAULT, DESIGN_LOAD_RISK_MAP, SCOUR_RISK_DEFAULT, SCOUR_RISK_MAP,
    ModelParams,
)


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def age_years(year: Column, p: ModelParams = DEFAULT_MODEL) -> Column:
    age = F.lit(float(p.current_year)) - year
    return F.when(age >= 0, age)


def age_norm(age: Column, p: ModelParams = DEFAULT_MODEL) -> Column:
    a = bounded_or(age, 0.0, p.age_cap, p.age_default)
    return F.pow(a / p.age_cap, F.lit(p.age_power))


def bridge_struct_risk(sub: Column, sup: Column, deck: Column) -> Column:
    return 0.45 * sub + 0.35 * sup + 0.20 * deck


def condition_risk(df: DataFrame, bridge: Column, culvert: Column) -> Column:
    has_culvert = F.col("CULVERT_COND").isNotNull()
    has_bridge = (F.col("DECK_COND").isNotNull() | F.col("SUPERSTR_COND").isNotNull()
                  | F.col("SUBSTR_COND").isNotNull())
    out = (F.when(has_culvert & ~has_bridge, culvert)
           .when(has_culvert, 0.5 * bridge + 0.5 * culvert)
           .otherwise(bridge))
    return F.coalesce(out, F.lit(0.45))


def poor_flag(category: Column) -> Column:
    return bool_to_int(category == "P")


def min_condition_poor(*conds: Column) -> Column:
    """1 when the smallest present rating is <= 4; all NULL -> 0."""
    return bool_to_int(F.least(*conds) <= 4)


def min_structural_condition(deck: Column, sup: Column, sub: Column, culvert: Column) -> Column:
    """Documented minimum structural rating: deck/super/sub, plus the culvert when it has one."""
    return F.when(culvert.isNotNull(), F.least(deck, sup, sub, culvert)).otherwise(F.least(deck, sup, sub))


def scour_base(code: Column) -> Column:
    # integer codes only: 4.0 -> 4, 4.5 -> default
    key = F.when(code == F.floor(code), code.cast("int"))
    return map_lookup(key, SCOUR_RISK_MAP, SCOUR_RISK_DEFAULT)


def scour_interaction(base: Column, substr_risk: Column) -> Column:
    return bounded(base * (1.0 + 0.5 * substr_risk), 0.0, 1.0)


def fracture_flag(c: Column) -> Column:
    return F.coalesce(c.startswith("Y"), F.lit(False)).cast("double")


def design_load_risk(c: Column) -> Column:
    return map_lookup(strip_ws(c), DESIGN_LOAD_RISK_MAP, DESIGN_LOAD_RISK_DEFAULT)


def traffic_log_norm(adt: Column, p: ModelParams = DEFAULT_MODEL) -> Column:
    a = bounded_or(adt, 0.0, p.adt_cap, 0.0)
    return F.log1p(a) / math.log1p(p.adt_cap)


def truck_norm(pct: Column) -> Column:
    return bounded_or(pct, 0.0, 100.0, 0.0) / 100.0


def load_posted(posting: Column) -> Column:
    return (5.0 - bounded_or(posting, 0.0, 5.0, 5.0)) / 5.0


def inspection_year(c: Column, p: ModelParams = DEFAULT_MODEL) -> Column:
    """MMYY / MYY text -> four-digit year; yy <= 30 is 20yy, else 19yy."""
    yy = to_int(F.substring(zpad(strip_ws(c), 4), 3, 2))
    return F.when(yy <= p.inspect_pivot_yy, 2000 + yy).otherwise(1900 + yy).cast("double")


def inspection_risk(years_since: Column, p: ModelParams = DEFAULT_MODEL) -> Column:
    share = bounded(years_since, 0.0, p.inspect_cap_years) / p.inspect_cap_years
    return F.when(years_since.isNotNull(), share).otherwise(F.lit(p.inspect_default))


def closed_flag(c: Column) -> Column:
    return bool_to_int(strip_ws(c).isin("K", "P"))


def engineer_features(df: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Clean table -> clean table + 25 feature columns (one projection)."""
    col = F.col
    age = age_years(col("YEAR_BUILT"), p)
    deck = cond_to_risk(col("DECK_COND"), p.cond_fill)
    sup = cond_to_risk(col("SUPERSTR_COND"), p.cond_fill)
    sub = cond_to_risk(col("SUBSTR_COND"), p.cond_fill)
    culv = cond_to_risk(col("CULVERT_COND"), p.cond_fill)

    first = df.select(
        "*",
        age.alias("BRIDGE_AGE"),
        bridge_struct_risk(sub, sup, deck).alias("BRIDGE_STRUCT_RISK"),
        culv.alias("CULVERT_STRUCT_RISK"),
        sub.alias("SUBSTR_RISK"),  # never NULL: a missing rating counts as the fill
        sup.alias("SUPER_RISK"),
        deck.alias("DECK_RISK"),
        (design_load_risk(col("DESIGN_LOAD")) if _has(df, "DESIGN_LOAD")
         else F.lit(DESIGN_LOAD_RISK_DEFAULT)).alias("DESIGN_LOAD_RISK"),
        (inspection_year(col("INSPECT_DATE"), p) if _has(df, "INSPECT_DATE")
         else F.lit(None).cast("double")).alias("INSPECT_YEAR"),
    )
    c = F.col
    out = first.select(
        "*",
        age_norm(c("BRIDGE_AGE"), p).alias("AGE_NORM"),
        condition_risk(first, c("BRIDGE_STRUCT_RISK"), c("CULVERT_STRUCT_RISK")).alias("COND_RISK"),
        poor_flag(c("BRIDGE_CONDITION")).alias("IS_POOR"),
        min_condition_poor(c("DECK_COND"), c("SUPERSTR_COND"), c("SUBSTR_COND"), c("CULVERT_COND"))
        .alias("IS_COND_POOR"),
        scour_interaction(scour_base(c("SCOUR_CRITICAL")) if _has(df, "SCOUR_CRITICAL")
                          else F.lit(SCOUR_RISK_DEFAULT), c("SUBSTR_RISK")).alias("SCOUR_RISK"),
        (fracture_flag(c("FRACTURE")) if _has(df, "FRACTURE") else F.lit(0.0)).alias("FRACTURE_CRITICAL"),
        traffic_log_norm(c("ADT"), p).alias("ADT_LOG_NORM"),
        (truck_norm(c("PCT_TRUCK")) if _has(df, "PCT_TRUCK") else F.lit(0.0)).alias("TRUCK_NORM"),
        (load_posted(c("BRIDGE_POSTING")) if _has(df, "BRIDGE_POSTING") else F.lit(0.0)).alias("LOAD_POSTED"),
        (cond_to_risk(c("CHANNEL_COND"), p.channel_fill) if _has(df, "CHANNEL_COND")
         else F.lit(0.0)).alias("CHANNEL_RISK"),
        (cond_to_risk(c("STRUCT_EVAL"), p.cond_fill) if _has(df, "STRUCT_EVAL")
         else F.lit(0.0)).alias("STRUCT_EVAL_RISK"),
        (cond_to_risk(c("WATERWAY_EVAL"), p.cond_fill) if _has(df, "WATERWAY_EVAL")
         else F.lit(0.0)).alias("WATERWAY_RISK"),
        (F.lit(float(p.current_year)) - c("INSPECT_YEAR")).alias("YEARS_SINCE_INSPECT"),
        (closed_flag(c("OPEN_CLOSED_POSTED")) if _has(df, "OPEN_CLOSED_POSTED") else F.lit(0))
        .alias("IS_CLOSED"),
    )
    return out.select(
        "*",
        (c("ADT_LOG_NORM") * c("AGE_NORM") * (1.0 + c("DESIGN_LOAD_RISK"))).alias("ADT_AGE_STRESS"),
        (c("TRUCK_NORM") * c("DESIGN_LOAD_RISK")).alias("TRUCK_LOAD_STRESS"),
        (inspection_risk(c("YEARS_SINCE_INSPECT"), p) if _has(df, "INSPECT_DATE")
         else F.lit(0.3)).alias("INSPECT_RISK"),
    )
