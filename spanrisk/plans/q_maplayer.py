"""Queries for the map-layer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanrisk.operators import maplayer as M
from spanrisk.operators.features import min_structural_condition
from spanrisk.params import CONDITION_LABELS
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import OKEY, dround, rounded

_K = "state_code, structure_number"
_MAPPED = "severity IN ('Critical', 'High')"


def _ex(spark, sf):
    return P.exposure_table(spark, sf, with_rank=True)


def _fmt(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE format('{{:,}}', CAST(round({c}) AS BIGINT)) END"


def _fallback(c: str, default: str) -> str:
    return f"substring(coalesce(nullif({O.s(c)}, ''), '{default}'), 1, 40)"


def _whole(c: str) -> str:
    return f"CAST(round_even(CAST({c} AS DECIMAL(38,15)), 0) AS BIGINT)"


_COND_LABEL = ("coalesce(CASE WHEN mc = floor(mc) THEN CASE CAST(mc AS INTEGER) "
               + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CONDITION_LABELS.items()) + " END END, 'N/A')")
_MC = ("CASE WHEN culvert_condition IS NOT NULL THEN least(deck_condition, superstr_condition, substr_condition, culvert_condition) "
       "ELSE least(deck_condition, superstr_condition, substr_condition) END")


#: Data properties of a map feature, for rows of ``m`` (mapped records with ``mc``, the minimum rating).
PROPERTIES_SQL = f"""structure_number, {_fallback('facility_carried', 'Unknown')} AS facility,
 {_fallback('features_intersected', '—')} AS crosses, {_fallback('state_name', 'Unknown')} AS state,
 round(risk_score, 6) AS risk_score, severity, severity_rank, {_fmt('adt')} AS adt_text,
 {_fmt('year_built')} AS built_text, {_COND_LABEL} AS condition,
 CASE WHEN rush_hour_persons IS NULL THEN 'N/A' ELSE CAST({_whole('rush_hour_persons')} AS VARCHAR) END AS rush_persons,
 round(6.0E0 + pow(least(greatest(ln(coalesce(adt, 0.0E0) + 1.0E0) / ln(1000000.0E0), 0.0E0), 1.0E0), 2)
 * (30.0E0 - 6.0E0), 1) AS icon_size,
 CASE WHEN p_collapse_1yr > 0 THEN '1 in ' || format('{{:,}}', CAST(round(1.0E0 / p_collapse_1yr) AS BIGINT))
 ELSE 'N/A' END AS collapse_prob"""
MAPPED_SQL = f"m AS (SELECT *, {_MC} AS mc FROM ex WHERE {_MAPPED})"


@query("map_filter", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT {_K}, round(risk_score, 6) AS risk_score, severity, severity_rank, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM ex WHERE {_MAPPED}""")
def q_map_filter(spark, sf):
    return rounded(M.map_filter(_ex(spark, sf)).select(*OKEY, "risk_score", "severity", "severity_rank", "lat", "lon"))


@query("icon_scale", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT {_K}, adt, round(6.0E0 + pow(least(greatest(ln(coalesce(adt, 0.0E0) + 1.0E0) / ln(1000000.0E0), 0.0E0), 1.0E0), 2)
 * (30.0E0 - 6.0E0), 1) AS icon_size FROM ex WHERE {_MAPPED}""")
def q_icon_scale(spark, sf):
    e = M.map_filter(_ex(spark, sf))
    return e.select(*OKEY, "adt", dround(M.icon_scale(F.col("adt")), 1).alias("icon_size"))


@query("format_number", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT {_K}, {_fmt('adt')} AS adt_text, {_fmt('year_built')} AS built_text, {_fmt('bridge_age')} AS age_text
FROM ex WHERE {_MAPPED}""")
def q_format_number(spark, sf):
    e = M.map_filter(_ex(spark, sf))
    return e.select(*OKEY, M.format_count(F.col("adt")).alias("adt_text"),
                    M.format_count(F.col("year_built")).alias("built_text"),
                    M.format_count(F.col("bridge_age")).alias("age_text"))


@query("text_fallback", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT {_K}, {_fallback('facility_carried', 'Unknown')} AS facility, {_fallback('features_intersected', '—')} AS crosses,
 {_fallback('state_name', 'Unknown')} AS state FROM ex WHERE {_MAPPED}""")
def q_text_fallback(spark, sf):
    e = M.map_filter(_ex(spark, sf))
    return e.select(*OKEY, M.text_fallback(F.col("facility_carried"), "Unknown").alias("facility"),
                    M.text_fallback(F.col("features_intersected"), "—").alias("crosses"),
                    M.text_fallback(F.col("state_name"), "Unknown").alias("state"))


@query("condition_label", "maplayer", sql=f"""{O.with_stage('exr')},
m AS (SELECT *, {_MC} AS mc FROM ex WHERE {_MAPPED})
SELECT {_K}, mc AS min_struct_condition, {_COND_LABEL} AS condition FROM m""")
def q_condition_label(spark, sf):
    e = M.map_filter(_ex(spark, sf))
    mc = min_structural_condition(F.col("deck_condition"), F.col("superstr_condition"),
                                  F.col("substr_condition"), F.col("culvert_condition"))
    return e.select(*OKEY, mc.alias("min_struct_condition"), M.condition_label(mc).alias("condition"))


@query("category_label", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT {_K}, coalesce(CASE {O.s('bridge_condition_category')} WHEN 'G' THEN 'Good' WHEN 'F' THEN 'Fair' WHEN 'P' THEN 'Poor' END, 'N/A')
 AS category_text FROM ex WHERE {_MAPPED}""")
def q_category_label(spark, sf):
    e = M.map_filter(_ex(spark, sf))
    return e.select(*OKEY, M.category_label(F.col("bridge_condition_category")).alias("category_text"))


@query("odds_label", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT {_K}, CASE WHEN p_collapse_1yr > 0 THEN '1 in ' || format('{{:,}}', CAST(round(1.0E0 / p_collapse_1yr) AS BIGINT))
 ELSE 'N/A' END AS collapse_prob FROM ex WHERE {_MAPPED}""")
def q_odds_label(spark, sf):
    e = M.map_filter(_ex(spark, sf))
    return e.select(*OKEY, M.odds_label(F.col("p_collapse_1yr")).alias("collapse_prob"))


@query("percent_label", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT {_K}, CAST({_whole('fatality_rate * 100.0E0')} AS VARCHAR) || '%' AS fatality_text,
 CAST({_whole('injury_rate * 100.0E0')} AS VARCHAR) || '%' AS injury_text,
 CAST({_whole('rush_hour_persons')} AS VARCHAR) AS rush_persons FROM ex WHERE {_MAPPED}""")
def q_percent_label(spark, sf):
    e = M.map_filter(_ex(spark, sf))
    return e.select(*OKEY, M.percent_label(F.col("fatality_rate")).alias("fatality_text"),
                    M.percent_label(F.col("injury_rate")).alias("injury_text"),
                    M.persons_label(F.col("rush_hour_persons")).alias("rush_persons"))


@query("layer_counts", "maplayer", sql=f"""{O.with_stage('exr')}
SELECT severity, count(*) AS n, severity || ' Bridges (' || format('{{:,}}', count(*)) || ')' AS layer_name
FROM ex WHERE {_MAPPED} AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY severity""")
def q_layer_counts(spark, sf):
    return M.layer_counts(_ex(spark, sf))
