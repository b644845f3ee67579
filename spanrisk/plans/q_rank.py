"""Queries for tiers, global rank, state summaries and output tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanrisk.operators import rank as R
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import project, rounded

_K = "STATE_CODE, STRUCTURE_NUMBER"

# oracle select list of the ranked output with doubles rounded
OUT_COLS_SQL = """state_code, structure_number, facility_carried, features_intersected, county_code,
 round(lat, 6) AS lat, round(lon, 6) AS lon, year_built, bridge_age, adt, pct_truck, deck_condition,
 superstr_condition, substr_condition, culvert_condition, channel_condition, bridge_condition_category,
 structural_eval, scour_critical, bridge_posting, open_closed_posted, last_inspection, structure_len_m,
 max_span_len_m, lanes_on, round(sdi_score, 6) AS sdi_score, round(ml_risk_proba, 6) AS ml_risk_proba,
 round(risk_score, 6) AS risk_score, severity, severity_rank, state_name"""

SUMMARY_SQL = """ss AS (
 SELECT STATE_CODE, count(RISK_SCORE) AS total_bridges, count_if(SEVERITY = 'Critical') AS critical,
  count_if(SEVERITY = 'High') AS high, count_if(SEVERITY = 'Medium') AS medium, count_if(SEVERITY = 'Low') AS low,
  avg(RISK_SCORE) AS avg_risk, CAST(sum(IS_POOR) AS BIGINT) AS poor_condition,
  {name} AS state_name
 FROM sc WHERE STATE_CODE IS NOT NULL GROUP BY STATE_CODE)""".format(name=O.state_name("STATE_CODE"))


@query("severity_tier", "rank", sql=f"""{O.with_stage('sc')}
SELECT {_K}, round(RISK_SCORE, 6) AS RISK_SCORE, SEVERITY FROM sc""")
def q_severity_tier(spark, sf):
    return project(P.scored(spark, sf), ["RISK_SCORE", "SEVERITY"])


@query("global_rank", "rank", sql=f"""{O.with_stage('rk')}
SELECT {_K}, round(RISK_SCORE, 6) AS RISK_SCORE, SEVERITY_RANK FROM rk""")
def q_global_rank(spark, sf):
    return project(P.ranked(spark, sf), ["RISK_SCORE", "SEVERITY_RANK"])


@query("severity_counts", "rank", sql=f"""{O.with_stage('sc')}
SELECT SEVERITY AS severity, count(*) AS n FROM sc GROUP BY SEVERITY""")
def q_severity_counts(spark, sf):
    return R.severity_counts(P.scored(spark, sf))


@query("state_name_lookup", "rank", sql=f"""{O.with_stage('cln')}
SELECT {_K}, {O.state_name('STATE_CODE')} AS state_name FROM cln""")
def q_state_name_lookup(spark, sf):
    c = P.cleaned(spark, sf)
    return c.select("STATE_CODE", "STRUCTURE_NUMBER", R.state_name(F.col("STATE_CODE")).alias("state_name"))


@query("format_output", "rank", sql=f"""{O.with_stage('outp')}
SELECT {OUT_COLS_SQL} FROM outp""")
def q_format_output(spark, sf):
    return rounded(P.ranked_output(spark, sf))


@query("top_critical", "rank", sql=f"""{O.with_stage('outp')}
SELECT {OUT_COLS_SQL} FROM outp WHERE severity = 'Critical' ORDER BY severity_rank LIMIT 1000""")
def q_top_critical(spark, sf):
    """Critical rows are a prefix of the global order: a rank filter, no top-k merge."""
    return rounded(R.top_critical(R.format_output(P.ranked_stage(spark, sf).upto(1000))))


@query("state_summary", "rank", sql=f"""{O.with_stage('sc', SUMMARY_SQL)}
SELECT STATE_CODE, total_bridges, critical, high, medium, low, round(avg_risk, 6) AS avg_risk, poor_condition, state_name
FROM ss""")
def q_state_summary(spark, sf):
    return rounded(R.state_summary(P.scored(spark, sf)))


@query("state_ranking", "rank", sql=f"""{O.with_stage('sc', SUMMARY_SQL)}
SELECT STATE_CODE, state_name, round(avg_risk, 6) AS avg_risk,
 row_number() OVER (ORDER BY avg_risk DESC, STATE_CODE) AS risk_rank FROM ss""")
def q_state_ranking(spark, sf):
    s = R.state_summary(P.scored(spark, sf))
    w = Window.orderBy(F.col("avg_risk").desc(), "STATE_CODE")  # one row per state
    return rounded(s.select("STATE_CODE", "state_name", "avg_risk",
                            F.row_number().over(w).cast("bigint").alias("risk_rank")))


@query("map_subset", "rank", sql=f"""{O.with_stage('outp')}
SELECT state_code, state_name, structure_number, facility_carried, features_intersected, county_code,
 round(lat, 6) AS lat, round(lon, 6) AS lon, year_built, bridge_age, adt, pct_truck, bridge_condition_category,
 deck_condition, superstr_condition, substr_condition, scour_critical, bridge_posting, open_closed_posted,
 round(sdi_score, 6) AS sdi_score, round(ml_risk_proba, 6) AS ml_risk_proba, round(risk_score, 6) AS risk_score,
 severity, severity_rank FROM outp WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def q_map_subset(spark, sf):
    return rounded(R.map_subset(P.ranked_output(spark, sf)))
