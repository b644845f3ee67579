"""Queries for the region (state) tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanrisk.operators import rank as R
from spanrisk.operators import regions as G
from spanrisk.params import CONUS_SKIP, FIPS_TO_ABBR, OUTSIDE_POOR_RANKING, REGION_NAMES
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import OKEY, rounded
from spanrisk.plans.q_rank import SUMMARY_SQL

_FIPS = O.zpad(O.s("STATE_CODE"), 2)
_SKIP = ", ".join(f"'{c}'" for c in CONUS_SKIP)
_PCT_SQL = f"""pc AS (SELECT {_FIPS} AS fips, state_name,
  100.0E0 * (critical + high + medium) / total_bridges AS pct_medium_plus,
  100.0E0 * (critical + high) / total_bridges AS pct_high_plus FROM ss)"""
_REGIONS_SQL = "rg AS (SELECT * FROM (VALUES " + ", ".join("('" + n + "')" for n in REGION_NAMES) + ") t(name))"
_HIDDEN = "severity IN ('High', 'Critical') AND bridge_condition_category IN ('F', 'G')"


def _summary(spark, sf):
    return R.state_summary(P.scored(spark, sf))


@query("normalise_fips", "regions", sql=f"""{O.with_stage('sc', SUMMARY_SQL)}
SELECT STATE_CODE, {_FIPS} AS fips FROM ss""")
def q_normalise_fips(spark, sf):
    return _summary(spark, sf).select("STATE_CODE", G.fips(F.col("STATE_CODE")).alias("fips"))


@query("region_percentages", "regions", sql=f"""{O.with_stage('sc', SUMMARY_SQL, _PCT_SQL)}
SELECT fips, state_name, round(pct_medium_plus, 6) AS pct_medium_plus, round(pct_high_plus, 6) AS pct_high_plus FROM pc""")
def q_region_percentages(spark, sf):
    return rounded(G.region_percentages(_summary(spark, sf)))


@query("region_join", "regions", sql=f"""{O.with_stage('sc', SUMMARY_SQL, _PCT_SQL, _REGIONS_SQL)}
SELECT name, fips, state_name, round(pct_medium_plus, 6) AS pct_medium_plus, round(pct_high_plus, 6) AS pct_high_plus
FROM rg JOIN pc ON rg.name = pc.state_name WHERE fips NOT IN ({_SKIP})""")
def q_region_join(spark, sf):
    pcts = G.region_percentages(_summary(spark, sf))
    return rounded(G.region_join(pcts, G.region_names(spark)))


@query("region_exclude", "regions", sql=f"""{O.with_stage('sc', SUMMARY_SQL, _PCT_SQL)}
SELECT fips, state_name FROM pc WHERE fips NOT IN ({_SKIP})""")
def q_region_exclude(spark, sf):
    return G.region_exclude(G.region_percentages(_summary(spark, sf))).select("fips", "state_name")


@query("abbreviation_lookup", "regions", sql=f"""{O.with_stage('sc', SUMMARY_SQL, _PCT_SQL)}
SELECT fips, coalesce(CASE fips {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIPS_TO_ABBR.items())} END, '') AS abbr FROM pc""")
def q_abbreviation_lookup(spark, sf):
    p = G.region_percentages(_summary(spark, sf))
    return p.select("fips", G.abbreviation(F.col("fips")).alias("abbr"))


@query("metric_scale", "regions", sql=f"""{O.with_stage('sc', SUMMARY_SQL, _PCT_SQL)},
k AS (SELECT * FROM pc WHERE fips NOT IN ({_SKIP})),
bnd AS (SELECT min(pct_high_plus) AS lo, max(pct_high_plus) AS hi FROM k)
SELECT fips, round(pct_high_plus, 6) AS pct_high_plus,
 round((pct_high_plus - lo) / (hi - lo + 1.0E-9), 6) AS scaled_observed,
 round((pct_high_plus - 0.0E0) / (10.0E0 - 0.0E0 + 1.0E-9), 6) AS scaled_fixed FROM k, bnd""")
def q_metric_scale(spark, sf):
    k = G.region_exclude(G.region_percentages(_summary(spark, sf)))
    obs = G.metric_scale(k, "pct_high_plus").withColumnRenamed("pct_high_plus_scaled", "scaled_observed")
    fixed = G.metric_scale(obs, "pct_high_plus", 0.0, 10.0).withColumnRenamed("pct_high_plus_scaled", "scaled_fixed")
    return rounded(fixed.select("fips", "pct_high_plus", "scaled_observed", "scaled_fixed"))


@query("hidden_risk", "regions", sql=f"""{O.with_stage('outu')}
SELECT state_code, structure_number, severity, bridge_condition_category, round(risk_score, 6) AS risk_score
FROM outu WHERE {_HIDDEN}""")
def q_hidden_risk(spark, sf):
    h = G.hidden_risk(P.output_unranked(spark, sf))
    return rounded(h.select(*OKEY, "severity", "bridge_condition_category", "risk_score"))


@query("hidden_risk_by_state", "regions", sql=f"""{O.with_stage('outu')}
SELECT {O.zpad(O.s('state_code'), 2)} AS fips, count(*) AS total, count_if({_HIDDEN}) AS hidden_count,
 round(100.0E0 * count_if({_HIDDEN}) / count(*), 6) AS hidden_pct FROM outu GROUP BY 1""")
def q_hidden_risk_by_state(spark, sf):
    return rounded(G.hidden_risk_by_state(P.output_unranked(spark, sf)))


@query("state_domain", "regions", sql=f"""{O.with_stage('outu')}
SELECT DISTINCT {O.zpad(O.s('state_code'), 2)} AS fips, state_name FROM outu""")
def q_state_domain(spark, sf):
    return G.state_domain(P.output_unranked(spark, sf))


_TRAFFIC_COLS = ["severity_rank", "state_code", "structure_number", "facility_carried", "features_intersected",
                 "state_name", "year_built", "adt", "risk_score", "bridge_condition_category"]
_TRAFFIC_SQL = ("severity_rank, state_code, structure_number, facility_carried, features_intersected, state_name, "
                "year_built, adt, round(risk_score, 6) AS risk_score, bridge_condition_category")


def _top_traffic(df):
    return rounded(df.orderBy(F.col("adt").desc_nulls_last(), "state_code", "structure_number").limit(10)
                   .select(*_TRAFFIC_COLS))


@query("hidden_risk_top_traffic", "regions", sql=f"""{O.with_stage('outp')}
SELECT {_TRAFFIC_SQL} FROM outp WHERE {_HIDDEN} ORDER BY adt DESC NULLS LAST, state_code, structure_number LIMIT 10""")
def q_hidden_risk_top_traffic(spark, sf):
    return _top_traffic(G.hidden_risk(P.ranked_output(spark, sf)))


@query("high_risk_top_traffic", "regions", sql=f"""{O.with_stage('outp')}
SELECT {_TRAFFIC_SQL} FROM outp WHERE severity IN ('High', 'Critical')
ORDER BY adt DESC NULLS LAST, state_code, structure_number LIMIT 10""")
def q_high_risk_top_traffic(spark, sf):
    o = P.ranked_output(spark, sf)
    return _top_traffic(o.filter(F.col("severity").isin("High", "Critical")))


_OUTSIDE_SQL = "ext AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {i + 1})" for i, n in enumerate(OUTSIDE_POOR_RANKING)) + ") t(state_name, outside_rank))"


@query("external_rank_compare", "regions", sql=f"""{O.with_stage('sc', SUMMARY_SQL, _OUTSIDE_SQL)},
ours AS (SELECT state_name, 100.0E0 * poor_condition / total_bridges AS pct_poor,
  row_number() OVER (ORDER BY 100.0E0 * poor_condition / total_bridges DESC, STATE_CODE) AS our_rank FROM ss)
SELECT ext.state_name, outside_rank, our_rank, round(pct_poor, 6) AS pct_poor, our_rank - outside_rank AS rank_shift,
 our_rank = outside_rank AS exact_match FROM ext JOIN ours ON ext.state_name = ours.state_name""")
def q_external_rank_compare(spark, sf):
    return rounded(G.external_rank_compare(_summary(spark, sf)))
