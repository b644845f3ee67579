"""Queries for the feature expressions.

Each query projects the structure key plus the feature(s) one operator adds;
the Spark side computes them inside ``engineer_features`` (one projection),
the oracle side in the ``ft`` CTE chain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanrisk.functions.columns import cond_to_risk
from spanrisk.operators.features import min_structural_condition, scour_base
from spanrisk.params import FEATURE_COLS
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import project

_K = "STATE_CODE, STRUCTURE_NUMBER"


def _feature_query(name: str, cols: list[str], doc: str) -> None:
    sel = ", ".join(f"round({c}, 6) AS {c}" if c not in ("IS_POOR", "IS_COND_POOR", "IS_CLOSED") else c
                    for c in cols)

    def fn(spark, sf):
        return project(P.features(spark, sf), cols)

    fn.__doc__ = doc
    query(name, "features", sql=f"{O.with_stage('ft')}\nSELECT {_K}, {sel} FROM ft")(fn)


_FEATURE_QUERIES = [
    ("age_years", ["BRIDGE_AGE"], "current year minus year built; negative -> NULL"),
    ("age_norm", ["AGE_NORM"], "(clip(age,0,120), NULL->60)/120 to the power 0.7"),
    ("component_risks", ["DECK_RISK", "SUPER_RISK", "SUBSTR_RISK", "CULVERT_STRUCT_RISK"], "per-component risks"),
    ("bridge_struct_risk", ["BRIDGE_STRUCT_RISK"], "0.45 sub + 0.35 super + 0.20 deck"),
    ("condition_risk", ["COND_RISK"], "culvert/bridge blend"),
    ("poor_flag", ["IS_POOR"], "category P as 0/1"),
    ("min_condition_poor", ["IS_COND_POOR"], "min of 4 ratings <= 4"),
    ("scour_interaction", ["SCOUR_RISK"], "base scour x (1 + 0.5 substructure risk), clipped"),
    ("fracture_flag", ["FRACTURE_CRITICAL"], "text starts with Y"),
    ("design_load_lookup", ["DESIGN_LOAD_RISK"], "design load code lookup"),
    ("traffic_log_norm", ["ADT_LOG_NORM"], "log1p(clip(adt)) / log1p(200000)"),
    ("traffic_age_stress", ["ADT_AGE_STRESS"], "traffic x age x (1 + design risk)"),
    ("truck_norm", ["TRUCK_NORM"], "truck share / 100, NULL -> 0"),
    ("truck_load_stress", ["TRUCK_LOAD_STRESS"], "truck x design risk"),
    ("load_posted", ["LOAD_POSTED"], "graded posting restriction"),
    ("channel_risk", ["CHANNEL_RISK"], "channel condition risk, fill 6"),
    ("struct_eval_risk", ["STRUCT_EVAL_RISK"], "structural appraisal risk"),
    ("waterway_risk", ["WATERWAY_RISK"], "waterway appraisal risk"),
    ("inspection_year", ["INSPECT_YEAR", "YEARS_SINCE_INSPECT"], "MMYY -> year"),
    ("inspection_risk", ["INSPECT_RISK"], "clip(years since, 0, 5)/5, NULL -> 0.5"),
    ("closed_flag", ["IS_CLOSED"], "K or P"),
    ("engineer_features", ["BRIDGE_AGE", "BRIDGE_STRUCT_RISK", "CULVERT_STRUCT_RISK", "INSPECT_YEAR",
                           "YEARS_SINCE_INSPECT", "IS_POOR", "IS_COND_POOR", *FEATURE_COLS], "all features"),
]

for _n, _c, _d in _FEATURE_QUERIES:
    _feature_query(_n, _c, _d)


@query("condition_to_risk", "features", sql=f"""{O.with_stage('cln')}
SELECT {_K}, round({O.risk('DECK_COND')}, 6) AS deck_risk_fill5, round({O.risk('CHANNEL_COND', '6.0E0')}, 6) AS channel_risk_fill6,
 round({O.risk('STRUCT_EVAL', '3.0E0')}, 6) AS eval_risk_fill3 FROM cln""")
def q_condition_to_risk(spark, sf):
    c = P.cleaned(spark, sf)
    return project(c.select(
        "STATE_CODE", "STRUCTURE_NUMBER",
        cond_to_risk(F.col("DECK_COND"), 5.0).alias("deck_risk_fill5"),
        cond_to_risk(F.col("CHANNEL_COND"), 6.0).alias("channel_risk_fill6"),
        cond_to_risk(F.col("STRUCT_EVAL"), 3.0).alias("eval_risk_fill3")),
        ["deck_risk_fill5", "channel_risk_fill6", "eval_risk_fill3"])


@query("min_structural_condition", "features", sql=f"""{O.with_stage('cln')}
SELECT {_K}, CASE WHEN CULVERT_COND IS NOT NULL THEN least(DECK_COND, SUPERSTR_COND, SUBSTR_COND, CULVERT_COND)
 ELSE least(DECK_COND, SUPERSTR_COND, SUBSTR_COND) END AS MIN_STRUCT_COND FROM cln""")
def q_min_structural_condition(spark, sf):
    c = P.cleaned(spark, sf)
    return project(c.withColumn("MIN_STRUCT_COND", min_structural_condition(
        F.col("DECK_COND"), F.col("SUPERSTR_COND"), F.col("SUBSTR_COND"), F.col("CULVERT_COND"))),
        ["MIN_STRUCT_COND"])


@query("scour_base_lookup", "features", sql=f"""{O.with_stage('cln')}
SELECT {_K}, SCOUR_CRITICAL, {O._SCOUR} AS SCOUR_BASE FROM cln""")
def q_scour_base_lookup(spark, sf):
    c = P.cleaned(spark, sf)
    return project(c.withColumn("SCOUR_BASE", scour_base(F.col("SCOUR_CRITICAL"))), ["SCOUR_CRITICAL", "SCOUR_BASE"])
