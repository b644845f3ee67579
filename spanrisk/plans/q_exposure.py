"""Queries for collapse probability and casualty exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanrisk.functions.columns import strip_ws
from spanrisk.operators import exposure as X
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import OKEY, dround, rounded

_K = "state_code, structure_number"


def dsum_sql(c: str, digits: int, factor: str | None = None) -> str:
    total = f"sum(CAST({c} AS DECIMAL(38,5)))"
    if factor is not None:
        total = f"({total} * CAST({factor} AS DECIMAL(4,2)))"
    return f"CAST(round({total}, {digits}) AS DOUBLE)"


def _ex(spark, sf, ranked: bool = False):
    return P.exposure_table(spark, sf, with_rank=ranked)


@query("water_crossing", "exposure", sql=f"""{O.with_stage('exu')}
SELECT {_K}, features_intersected, is_water_crossing FROM ex""")
def q_water_crossing(spark, sf):
    return _ex(spark, sf).select(*OKEY, "features_intersected", "is_water_crossing")


@query("water_crossing_strict", "exposure", sql=f"""{O.with_stage('outu')}
SELECT {_K}, coalesce(regexp_matches(features_intersected, '\\b({O.WATER_RE.replace('BROOK|', 'BROOK|RUN|')})\\b', 'i'), false) AS is_water_strict FROM outu""")
def q_water_crossing_strict(spark, sf):
    out = P.output_unranked(spark, sf)
    return out.select(*OKEY, X.water_crossing_strict(F.col("features_intersected")).alias("is_water_strict"))


@query("collapse_probability", "exposure", sql=f"""{O.with_stage('exu')}
SELECT {_K}, round(risk_score, 6) AS risk_score, round(p_collapse_1yr, 12) AS p_collapse_1yr FROM ex""")
def q_collapse_probability(spark, sf):
    df = _ex(spark, sf).select(*OKEY, dround("risk_score", 6).alias("risk_score"),
                               dround("p_collapse_1yr", 12).alias("p_collapse_1yr"))
    return df


@query("span_category", "exposure", sql=f"""{O.with_stage('outu')}
SELECT {_K}, max_span_len_m, CASE WHEN coalesce(max_span_len_m, 20.0E0) >= 0 AND coalesce(max_span_len_m, 20.0E0) < 20 THEN 'short'
 WHEN coalesce(max_span_len_m, 20.0E0) >= 20 AND coalesce(max_span_len_m, 20.0E0) < 50 THEN 'medium'
 WHEN coalesce(max_span_len_m, 20.0E0) >= 50 AND coalesce(max_span_len_m, 20.0E0) < 9999 THEN 'long' END AS span_category FROM outu""")
def q_span_category(spark, sf):
    out = P.output_unranked(spark, sf)
    return out.select(*OKEY, "max_span_len_m", X.span_category(F.col("max_span_len_m")).alias("span_category"))


@query("casualty_base_rates", "exposure", sql=f"""{O.with_stage('outu', *O.exposure_ctes('outu')[:2])}
SELECT {_K}, fat0 AS base_fatality_rate, inj0 AS base_injury_rate FROM e2""")
def q_casualty_base_rates(spark, sf):
    out = P.output_unranked(spark, sf)
    w = X.water_crossing(F.col("features_intersected"))
    s = X.span_category(F.col("max_span_len_m"))
    return out.select(*OKEY, X.base_fatality_rate(w, s).alias("base_fatality_rate"),
                      X.base_injury_rate(w, s).alias("base_injury_rate"))


@query("truck_adjusted_rates", "exposure", sql=f"""{O.with_stage('exu')}
SELECT {_K}, fatality_rate, injury_rate, unharmed_rate FROM ex""")
def q_truck_adjusted_rates(spark, sf):
    return _ex(spark, sf).select(*OKEY, "fatality_rate", "injury_rate", "unharmed_rate")


@query("rush_hour_occupancy", "exposure", sql=f"""{O.with_stage('exu')}
SELECT {_K}, round(rush_hour_persons, 6) AS rush_hour_persons FROM ex""")
def q_rush_hour_occupancy(spark, sf):
    return rounded(_ex(spark, sf).select(*OKEY, "rush_hour_persons"))


@query("expected_casualties", "exposure", sql=f"""{O.with_stage('exu')}
SELECT {_K}, expected_fatalities, expected_injuries, expected_affected FROM ex""")
def q_expected_casualties(spark, sf):
    return _ex(spark, sf).select(*OKEY, "expected_fatalities", "expected_injuries", "expected_affected")


_EXPO_COLS = ["state_code", "structure_number", "risk_score", "severity", "severity_rank", "p_collapse_1yr",
              "rush_hour_persons", "is_water_crossing", "fatality_rate", "injury_rate", "unharmed_rate",
              "expected_fatalities", "expected_injuries", "expected_affected"]


@query("exposure", "exposure", sql=f"""{O.with_stage('exr')}
SELECT {_K}, round(risk_score, 6) AS risk_score, severity, severity_rank, round(p_collapse_1yr, 12) AS p_collapse_1yr,
 round(rush_hour_persons, 6) AS rush_hour_persons, is_water_crossing, fatality_rate, injury_rate, unharmed_rate,
 expected_fatalities, expected_injuries, expected_affected FROM ex""")
def q_exposure(spark, sf):
    df = _ex(spark, sf, ranked=True).select(*_EXPO_COLS)
    return rounded(df.withColumn("p_collapse_1yr", dround("p_collapse_1yr", 12)))


@query("exposure_ranges", "exposure", sql=f"""{O.with_stage('exu')}
SELECT round(min(p_collapse_1yr), 12) AS p_min, round(max(p_collapse_1yr), 12) AS p_max,
 round(min(rush_hour_persons), 6) AS persons_min, round(max(rush_hour_persons), 6) AS persons_max,
 count_if(is_water_crossing) AS water_crossings, count(*) AS n FROM ex""")
def q_exposure_ranges(spark, sf):
    e = _ex(spark, sf)
    return e.agg(dround(F.min("p_collapse_1yr"), 12).alias("p_min"), dround(F.max("p_collapse_1yr"), 12).alias("p_max"),
                 dround(F.min("rush_hour_persons"), 6).alias("persons_min"),
                 dround(F.max("rush_hour_persons"), 6).alias("persons_max"),
                 F.count_if("is_water_crossing").alias("water_crossings"), F.count(F.lit(1)).alias("n"))


def tier_histogram_sql(src: str, value_expr: str, bins: int) -> str:
    return f"""hv AS (SELECT severity, {value_expr} AS v FROM {src}),
hs0 AS (SELECT severity, min(v) AS lo0, max(v) AS hi0, count(v) AS n FROM hv GROUP BY severity),
hs AS (SELECT severity, n, CASE WHEN hi0 = lo0 THEN lo0 - 0.5E0 ELSE lo0 END AS lo,
  CASE WHEN hi0 = lo0 THEN hi0 + 0.5E0 ELSE hi0 END AS hi FROM hs0),
hc AS (SELECT hv.severity, CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS cnt
  FROM hv JOIN hs ON hv.severity = hs.severity WHERE v IS NOT NULL GROUP BY 1, 2),
hd AS (SELECT severity, n, lo, hi, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM hs)
SELECT hd.severity, hd.bin, round(lo + hd.bin * ((hi - lo) / {bins}), 6) AS bin_lo,
 round(lo + (hd.bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count,
 round(coalesce(cnt, 0) / (n * ((hi - lo) / {bins})), 6) AS density
FROM hd LEFT JOIN hc ON hd.severity = hc.severity AND hd.bin = hc.bin"""


@query("log_prob_density", "exposure", sql=f"""{O.with_stage('exu')},
{tier_histogram_sql('ex', 'log10(greatest(p_collapse_1yr, 1.0E-7))', 40)}""")
def q_log_prob_density(spark, sf):
    e = _ex(spark, sf).select("severity", X.log_label(F.col("p_collapse_1yr")).alias("v"))
    return rounded(X.tier_histogram(e, "v", "severity", 40))


@query("risk_exposure_points", "exposure", sql=f"""{O.with_stage('exu')}
SELECT {_K}, severity, round(log10(greatest(p_collapse_1yr, 1.0E-7)), 6) AS log10_p,
 round(log10(greatest(rush_hour_persons, 0.01E0)), 6) AS log10_persons,
 severity || '/' || CASE WHEN is_water_crossing THEN 'water' ELSE 'land' END AS point_class
FROM ex WHERE severity IN ('Critical', 'High') AND rush_hour_persons > 0""")
def q_risk_exposure_points(spark, sf):
    e = _ex(spark, sf).filter(F.col("severity").isin("Critical", "High") & (F.col("rush_hour_persons") > 0))
    return rounded(e.select(*OKEY, "severity", X.log_label(F.col("p_collapse_1yr")).alias("log10_p"),
                            F.log10(F.greatest(F.col("rush_hour_persons"), F.lit(0.01))).alias("log10_persons"),
                            X.water_class(F.col("severity"), F.col("is_water_crossing")).alias("point_class")))


def _top_order():
    return [F.col("expected_fatalities").desc(), F.col("state_code"), F.col("structure_number")]

_TOP_ORDER_SQL = "expected_fatalities DESC, state_code, structure_number"


@query("top_expected_fatalities", "exposure", sql=f"""{O.with_stage('exu')}
SELECT {_K}, facility_carried, state_name, adt, round(rush_hour_persons, 6) AS rush_hour_persons,
 round(p_collapse_1yr, 12) AS p_collapse_1yr, fatality_rate, injury_rate, expected_fatalities, expected_injuries,
 expected_affected, severity, is_water_crossing,
 substring({O.s('facility_carried')}, 1, 22) || chr(10) || substring(state_name, 1, 12) AS label
FROM ex ORDER BY {_TOP_ORDER_SQL} LIMIT 20""")
def q_top_expected_fatalities(spark, sf):
    e = _ex(spark, sf).orderBy(*_top_order()).limit(20)
    return rounded(e.select(
        *OKEY, "facility_carried", "state_name", "adt", "rush_hour_persons",
        dround("p_collapse_1yr", 12).alias("p_collapse_1yr"), "fatality_rate", "injury_rate",
        "expected_fatalities", "expected_injuries", "expected_affected", "severity", "is_water_crossing",
        F.concat(F.substring(strip_ws(F.col("facility_carried")), 1, 22), F.lit("\n"),
                 F.substring("state_name", 1, 12)).alias("label")))


@query("exposure_totals", "exposure", sql=f"""{O.with_stage('exu')}
SELECT round(sum(p_collapse_1yr), 2) AS total_expected_annual_collapses,
 {dsum_sql('expected_affected', 3)} AS total_expected_annual_affected,
 {dsum_sql('expected_fatalities', 3)} AS total_expected_annual_fatalities,
 {dsum_sql('expected_injuries', 3)} AS total_expected_annual_injuries,
 count_if(is_water_crossing) AS water_crossings_total,
 round(100.0E0 * count_if(is_water_crossing) / count(*), 1) AS water_crossings_pct,
 {dsum_sql('expected_fatalities', 3, "'0.25'")} AS fatalities_any_time_of_day,
 {dsum_sql('expected_injuries', 3, "'0.25'")} AS injuries_any_time_of_day FROM ex""")
def q_exposure_totals(spark, sf):
    return X.exposure_totals(_ex(spark, sf))


@query("exposure_by_tier", "exposure", sql=f"""{O.with_stage('exu')}
SELECT severity, round(median(p_collapse_1yr), 12) AS median_p_collapse,
 round(median(rush_hour_persons), 1) AS median_rush_persons,
 {dsum_sql('expected_fatalities', 4)} AS total_exp_fatalities, {dsum_sql('expected_injuries', 4)} AS total_exp_injuries
FROM ex GROUP BY severity""")
def q_exposure_by_tier(spark, sf):
    return X.exposure_by_tier(_ex(spark, sf))


@query("exposure_top5_nested", "exposure", sql=f"""{O.with_stage('exu')}
SELECT facility_carried, state_name, adt, round(rush_hour_persons, 6) AS rush_hour_persons, is_water_crossing,
 fatality_rate, injury_rate, round(p_collapse_1yr, 12) AS p_collapse_1yr, expected_fatalities, expected_injuries,
 expected_affected, severity FROM ex ORDER BY {_TOP_ORDER_SQL} LIMIT 5""")
def q_exposure_top5_nested(spark, sf):
    """Top five records nested in one report row (list of structs), exploded for checking."""
    nested = X.top_records_nested(_ex(spark, sf), 5)  # at most 5 elements
    flat = nested.select(F.explode("top_by_fatalities").alias("r")).select("r.*")
    return rounded(flat.withColumn("p_collapse_1yr", dround("p_collapse_1yr", 12)))


_TOP1000_COLS = ["severity_rank", "facility_carried", "features_intersected", "state_name", "adt", "lanes_on",
                 "structure_len_m", "max_span_len_m", "risk_score", "severity", "p_collapse_1yr",
                 "rush_hour_persons", "is_water_crossing", "fatality_rate", "injury_rate", "unharmed_rate",
                 "expected_fatalities", "expected_injuries", "expected_affected", "bridge_condition_category",
                 "bridge_age", "last_inspection"]


@query("exposure_top1000", "exposure", sql=f"""{O.with_stage('exu')},
t AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, state_code, structure_number) AS rn FROM ex)
SELECT rn AS severity_rank, facility_carried, features_intersected, state_name, adt, lanes_on, structure_len_m,
 max_span_len_m, round(risk_score, 6) AS risk_score, severity, round(p_collapse_1yr, 12) AS p_collapse_1yr,
 round(rush_hour_persons, 6) AS rush_hour_persons, is_water_crossing, fatality_rate, injury_rate, unharmed_rate,
 expected_fatalities, expected_injuries, expected_affected, bridge_condition_category, bridge_age, last_inspection
FROM t WHERE rn <= 1000""")
def q_exposure_top1000(spark, sf):
    """Top 1000 by score = ranks 1..1000 of the ranked exposure table (a filter)."""
    from spanrisk.operators.rank import top_by_rank

    top = top_by_rank(_ex(spark, sf, ranked=True), 1000)
    return rounded(top.select(*_TOP1000_COLS).withColumn("p_collapse_1yr", dround("p_collapse_1yr", 12)))


_ODDS_SQL = "CASE WHEN {p} > 0 THEN '1 in ' || format('{{:,}}', CAST(round(1.0E0 / {p}) AS BIGINT)) ELSE 'N/A' END"


@query("tier_odds_range", "exposure", sql=f"""{O.with_stage('exu')},
tr AS (SELECT severity, max(p_collapse_1yr) AS p_hi, median(p_collapse_1yr) AS p_med, min(p_collapse_1yr) AS p_lo
 FROM ex GROUP BY severity)
SELECT severity, {_ODDS_SQL.format(p='p_hi')} AS odds_most_likely, {_ODDS_SQL.format(p='p_med')} AS odds_median,
 {_ODDS_SQL.format(p='p_lo')} AS odds_least_likely FROM tr""")
def q_tier_odds_range(spark, sf):
    return X.tier_odds(_ex(spark, sf))
