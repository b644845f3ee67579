"""Queries for the analysis tables and the statistics record."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanrisk.operators import rank as R
from spanrisk.operators import summary as S
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import OKEY, dround, rounded
from spanrisk.operators.exposure import tier_histogram
from spanrisk.plans.q_exposure import tier_histogram_sql
from spanrisk.plans.q_rank import SUMMARY_SQL

_K = "state_code, structure_number"


def _out(spark, sf):
    return P.output_unranked(spark, sf)


@query("severity_distribution", "analysis", sql=f"""{O.with_stage('outu')},
dom AS (SELECT * FROM (VALUES ('Critical', 0), ('High', 1), ('Medium', 2), ('Low', 3)) t(severity, tier_order)),
cnt AS (SELECT severity, count(*) AS n FROM outu GROUP BY severity)
SELECT dom.severity, dom.tier_order, CAST(coalesce(n, 0) AS BIGINT) AS n,
 round(100.0E0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS pct
FROM dom LEFT JOIN cnt ON dom.severity = cnt.severity""")
def q_severity_distribution(spark, sf):
    return rounded(S.severity_distribution(_out(spark, sf)))


@query("score_histogram", "analysis", sql=f"""{O.with_stage('outu')},
rg0 AS (SELECT min(risk_score) AS lo0, max(risk_score) AS hi0 FROM outu),
rg AS (SELECT CASE WHEN hi0 = lo0 THEN lo0 - 0.5E0 ELSE lo0 END AS lo, CASE WHEN hi0 = lo0 THEN hi0 + 0.5E0 ELSE hi0 END AS hi FROM rg0),
cnt AS (SELECT CAST(least(floor((risk_score - lo) / (hi - lo) * 80), 79) AS INTEGER) AS bin, count(*) AS c
  FROM outu, rg WHERE risk_score IS NOT NULL GROUP BY 1),
dom AS (SELECT CAST(unnest(range(0, 80)) AS INTEGER) AS bin),
j AS (SELECT dom.bin, lo + dom.bin * ((hi - lo) / 80) AS blo, lo + (dom.bin + 1) * ((hi - lo) / 80) AS bhi,
  (hi - lo) / 80 AS w, coalesce(c, 0) AS c FROM dom CROSS JOIN rg LEFT JOIN cnt ON dom.bin = cnt.bin)
SELECT bin, round(blo, 6) AS bin_lo, round(bhi, 6) AS bin_hi, round(blo + w / 2, 6) AS mid,
 CASE WHEN blo + w / 2 >= 0 AND blo + w / 2 < 0.25E0 THEN 'Low' WHEN blo + w / 2 >= 0.25E0 AND blo + w / 2 < 0.5E0 THEN 'Medium'
  WHEN blo + w / 2 >= 0.5E0 AND blo + w / 2 < 0.75E0 THEN 'High' WHEN blo + w / 2 >= 0.75E0 AND blo + w / 2 < 1.01E0 THEN 'Critical' END AS tier,
 CAST(c AS BIGINT) AS count FROM j""")
def q_score_histogram(spark, sf):
    return rounded(S.score_histogram(_out(spark, sf), 80))


@query("age_density_by_tier", "analysis", sql=f"""{O.with_stage('outu')},
{tier_histogram_sql('(SELECT * FROM outu WHERE bridge_age BETWEEN 0 AND 150)', 'bridge_age', 50)}""")
def q_age_density_by_tier(spark, sf):
    o = _out(spark, sf).filter(F.col("bridge_age").between(0, 150)).select("severity", F.col("bridge_age").alias("v"))
    return rounded(tier_histogram(o, "v", "severity", 50))


@query("state_at_risk_top", "analysis", sql=f"""{O.with_stage('sc', SUMMARY_SQL)}
SELECT STATE_CODE, state_name, round(100.0E0 * (critical + high) / total_bridges, 6) AS pct_at_risk,
 round(100.0E0 * poor_condition / total_bridges, 6) AS pct_poor, critical + high AS n_at_risk
FROM ss ORDER BY 100.0E0 * (critical + high) / total_bridges DESC, STATE_CODE LIMIT 20""")
def q_state_at_risk_top(spark, sf):
    return rounded(S.state_at_risk_top(R.state_summary(P.scored(spark, sf))))


@query("condition_distribution", "analysis", sql=f"""{O.with_stage('outu')},
l AS (SELECT 'Deck' AS part, deck_condition AS rating FROM outu UNION ALL
      SELECT 'Superstructure', superstr_condition FROM outu UNION ALL
      SELECT 'Substructure', substr_condition FROM outu)
SELECT part, CAST(rating AS INTEGER) AS rating, count(*) AS count,
 CASE WHEN CAST(rating AS INTEGER) <= 2 THEN 'critical' WHEN CAST(rating AS INTEGER) <= 4 THEN 'poor'
  WHEN CAST(rating AS INTEGER) <= 6 THEN 'fair' ELSE 'good' END AS colour_class
FROM l WHERE rating IS NOT NULL GROUP BY 1, 2""")
def q_condition_distribution(spark, sf):
    return S.condition_distribution(_out(spark, sf))


_SAMPLE_SQL = """smp AS (SELECT * FROM outu WHERE bridge_age BETWEEN 0 AND 150
  ORDER BY md5(concat_ws('|', state_code, structure_number, '42')), state_code, structure_number LIMIT 30000)"""


def _sample(spark, sf):
    o = _out(spark, sf).filter(F.col("bridge_age").between(0, 150))
    return S.exact_sample(o, 30000, 42)


@query("exact_sample", "analysis", sql=f"""{O.with_stage('outu', _SAMPLE_SQL)}
SELECT {_K}, bridge_age, round(risk_score, 6) AS risk_score, severity FROM smp""")
def q_exact_sample(spark, sf):
    return rounded(_sample(spark, sf).select(*OKEY, "bridge_age", "risk_score", "severity"))


@query("age_bin_means", "analysis", sql=f"""{O.with_stage('outu')}
SELECT CAST(floor(bridge_age / 5) * 5 AS INTEGER) AS age_bin, round(avg(risk_score), 6) AS mean_risk,
 round(CAST(floor(bridge_age / 5) * 5 AS INTEGER) + 2.5E0, 6) AS x FROM outu WHERE bridge_age BETWEEN 0 AND 150 GROUP BY 1""")
def q_age_bin_means(spark, sf):
    return rounded(S.age_bin_means(_out(spark, sf).filter(F.col("bridge_age").between(0, 150))))


_DECADE_SQL = """dp AS (SELECT CAST(floor(year_built / 10) * 10 AS INTEGER) AS decade,
  count_if(severity = 'Critical') AS Critical, count_if(severity = 'High') AS High,
  count_if(severity = 'Medium') AS Medium, count_if(severity = 'Low') AS Low
 FROM outu WHERE year_built BETWEEN 1880 AND 2025 GROUP BY 1)"""


@query("decade_pivot", "analysis", sql=f"""{O.with_stage('outu', _DECADE_SQL)}
SELECT decade, Critical, High, Medium, Low FROM dp""")
def q_decade_pivot(spark, sf):
    return S.decade_pivot(_out(spark, sf))


@query("decade_stack", "analysis", sql=f"""{O.with_stage('outu', _DECADE_SQL)}
SELECT decade, Critical, High, Medium, Low, CAST(0 AS BIGINT) AS base_Critical, Critical AS base_High,
 Critical + High AS base_Medium, Critical + High + Medium AS base_Low FROM dp""")
def q_decade_stack(spark, sf):
    return S.decade_stack(S.decade_pivot(_out(spark, sf)))


@query("traffic_log_points", "analysis", sql=f"""{O.with_stage('outu')}
SELECT {_K}, round(log10(adt), 6) AS log10_adt, round(risk_score, 6) AS risk_score, severity
FROM outu WHERE adt BETWEEN 1 AND 500000""")
def q_traffic_log_points(spark, sf):
    return rounded(S.traffic_points(_out(spark, sf)))


_MC = "least(deck_condition, superstr_condition, substr_condition, culvert_condition)"


@query("stats_totals", "analysis", sql=f"""{O.with_stage('outu')}
SELECT count(*) AS total_bridges, count_if(lat IS NOT NULL AND lon IS NOT NULL) AS with_geo,
 round(100.0E0 * count_if(bridge_condition_category = 'P') / count(*), 2) AS pct_poor_nbi FROM outu""")
def q_stats_totals(spark, sf):
    s = S.stats_core(_out(spark, sf))
    return s.select("total_bridges", "with_geo", dround("pct_poor_nbi", 2).alias("pct_poor_nbi"))


@query("stats_tiers", "analysis", sql=f"""{O.with_stage('outu')}
SELECT {", ".join(f"count_if(severity = '{t}') AS n_{t.lower()}, round(100.0E0 * count_if(severity = '{t}') / count(*), 2) AS pct_{t.lower()}" for t in ("Critical", "High", "Medium", "Low"))}
FROM outu""")
def q_stats_tiers(spark, sf):
    s = S.stats_core(_out(spark, sf))
    cols = []
    for t in ("critical", "high", "medium", "low"):
        cols += [F.col(f"n_{t}"), dround(f"pct_{t}", 2).alias(f"pct_{t}")]
    return s.select(*cols)


@query("stats_age", "analysis", sql=f"""{O.with_stage('outu')}
SELECT round(median(bridge_age), 1) AS median_age, round(avg(bridge_age), 1) AS mean_age,
 round(100.0E0 * count_if(bridge_age > 50) / count(bridge_age), 1) AS pct_over_50,
 round(100.0E0 * count_if(bridge_age > 75) / count(bridge_age), 1) AS pct_over_75,
 CAST(min(year_built) AS INTEGER) AS oldest_bridge FROM outu""")
def q_stats_age(spark, sf):
    o = _out(spark, sf)
    s = S.stats_core(o)
    med = S.median_age(o).first()["median_age"]  # one scalar
    return s.select(dround(F.lit(med).cast("double"), 1).alias("median_age"), dround("mean_age", 1).alias("mean_age"),
                    dround("pct_over_50", 1).alias("pct_over_50"), dround("pct_over_75", 1).alias("pct_over_75"),
                    "oldest_bridge")


@query("stats_condition", "analysis", sql=f"""{O.with_stage('outu')}
SELECT round(100.0E0 * count_if({_MC} <= 4) / count({_MC}), 2) AS pct_min_cond_poor,
 round(100.0E0 * count_if({_MC} <= 3) / count({_MC}), 2) AS pct_min_cond_serious,
 round(100.0E0 * count_if({_MC} <= 2) / count({_MC}), 2) AS pct_min_cond_critical FROM outu""")
def q_stats_condition(spark, sf):
    s = S.stats_core(_out(spark, sf))
    return s.select(*[dround(c, 2).alias(c) for c in
                      ("pct_min_cond_poor", "pct_min_cond_serious", "pct_min_cond_critical")])


@query("stats_traffic", "analysis", sql=f"""{O.with_stage('outu')}
SELECT CAST(sum(adt) AS BIGINT) AS total_daily_crossings,
 CAST(sum(CASE WHEN severity IN ('Critical', 'High') THEN adt END) AS BIGINT) AS daily_crossings_high_risk FROM outu""")
def q_stats_traffic(spark, sf):
    return S.stats_core(_out(spark, sf)).select("total_daily_crossings", "daily_crossings_high_risk")


@query("riskiest_state", "analysis", sql=f"""{O.with_stage('sc', SUMMARY_SQL)}
SELECT state_name AS riskiest_state, round(avg_risk, 4) AS riskiest_state_avg_risk
FROM ss ORDER BY avg_risk DESC, STATE_CODE LIMIT 1""")
def q_riskiest_state(spark, sf):
    r = S.riskiest_state(R.state_summary(P.scored(spark, sf)))
    return r.select("riskiest_state", dround("riskiest_state_avg_risk", 4).alias("riskiest_state_avg_risk"))
