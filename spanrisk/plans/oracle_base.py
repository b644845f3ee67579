"""Oracle SQL (DuckDB dialect): the shared CTE chain.

Written by hand from the operator semantics, independently of the DataFrame
code: raw view -> renamed -> clean -> features -> scores -> ranked output.
Each oracle query is ``WITH <chain up to the stage it needs>, ... SELECT``.
Every numeric literal is written as a DOUBLE (``E0``) so DuckDB never switches
to DECIMAL arithmetic.
"""

from __future__ import annotations

from spanrisk.params import NULL_TOKENS

RAW = """b AS (
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey,
        cast(floor(l_quantity) as int) AS q, cast(floor(l_extendedprice) as bigint) AS px,
        (l_orderkey*7 + l_linenumber*3 + l_partkey) AS k,
        cast((l_partkey*37 + l_suppkey*11 + l_linenumber*5) % 125 as int) AS age,
        cast(month(l_shipdate) as int) AS mm
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
c AS (
 SELECT *,
  greatest(0, least(9, 9 - cast(floor(age/20) as int) + cast((k*13) % 5 as int) - 2)) AS d0,
  greatest(0, least(9, 9 - cast(floor(age/20) as int) + cast((k*17) % 5 as int) - 2)) AS d1,
  greatest(0, least(9, 9 - cast(floor(age/18) as int) + cast((k*19) % 5 as int) - 2)) AS d2
 FROM b),
raw AS (
SELECT
 lpad(cast(s_nationkey + 16 as string), 2, '0') AS STATE_CODE_001,
 concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) AS STRUCTURE_NUMBER_008,
 CASE WHEN k % 50 = 0 THEN '2' ELSE '1' END AS RECORD_TYPE_005A,
 lpad(cast(k % 200 as string), 3, '0') AS COUNTY_CODE_003,
 CASE k % 8 WHEN 0 THEN 'MILL CREEK' WHEN 1 THEN 'STATE ROUTE 9' WHEN 2 THEN 'Big Sandy River' WHEN 3 THEN 'SEATTLE AVE'
   WHEN 4 THEN 'RAILROAD' WHEN 5 THEN 'WILLOW RUN' WHEN 6 THEN 'SHIP CANAL' ELSE NULL END AS FEATURES_DESC_006A,
 concat('ROUTE ', cast(l_suppkey as string)) AS FACILITY_CARRIED_007,
 concat(lpad(cast(CASE WHEN k % 200 = 7 THEN 5 ELSE 25 + k % 24 END as string), 2, '0'), lpad(cast(k % 60 as string), 2, '0'), lpad(cast((k*31) % 6000 as string), 4, '0')) AS LAT_016,
 concat(lpad(cast(70 + k % 50 as string), 3, '0'), lpad(cast((k*3) % 60 as string), 2, '0'), lpad(cast((k*29) % 6000 as string), 4, '0')) AS LONG_017,
 CASE WHEN k % 97 = 0 THEN NULL WHEN k % 499 = 0 THEN '1700' WHEN k % 503 = 0 THEN '2025' ELSE cast(2024 - age as string) END AS YEAR_BUILT_027,
 cast(1 + k % 6 as string) AS TRAFFIC_LANES_ON_028A,
 CASE WHEN k % 89 = 0 THEN NULL WHEN k % 401 = 0 THEN '250000' ELSE cast(px as string) END AS ADT_029,
 CASE WHEN k % 14 = 13 THEN NULL WHEN k % 14 < 10 THEN cast(k % 14 as string) WHEN k % 14 = 10 THEN 'A' WHEN k % 14 = 11 THEN 'B' ELSE 'Z' END AS DESIGN_LOAD_031,
 CASE k % 20 WHEN 0 THEN 'K' WHEN 1 THEN 'P' WHEN 2 THEN NULL ELSE 'A' END AS OPEN_CLOSED_POSTED_041,
 CASE WHEN k % 31 = 0 THEN NULL ELSE cast(q * 3 as string) END AS MAX_SPAN_LEN_MT_048,
 CASE WHEN k % 37 = 0 THEN NULL ELSE cast(q * 11 as string) END AS STRUCTURE_LEN_MT_049,
 CASE WHEN k % 5 = 0 THEN 'N' ELSE cast(d0 as string) END AS DECK_COND_058,
 CASE WHEN k % 5 = 0 THEN 'N' ELSE cast(d1 as string) END AS SUPERSTRUCTURE_COND_059,
 CASE WHEN k % 5 = 0 OR k % 41 = 0 THEN 'N' ELSE cast(d2 as string) END AS SUBSTRUCTURE_COND_060,
 CASE WHEN k % 6 = 0 THEN 'N' ELSE cast((k*23) % 10 as string) END AS CHANNEL_COND_061,
 CASE WHEN k % 5 = 0 OR k % 101 = 0 THEN cast(d1 as string) ELSE 'N' END AS CULVERT_COND_062,
 CASE WHEN k % 43 = 0 THEN 'N' ELSE cast(least(d1, d2) as string) END AS STRUCTURAL_EVAL_067,
 CASE WHEN k % 47 = 0 THEN NULL WHEN d2 <= 3 THEN cast(k % 5 as string) ELSE '5' END AS POSTING_EVAL_070,
 CASE WHEN k % 6 = 0 THEN 'N' ELSE cast((k*29) % 10 as string) END AS WATERWAY_EVAL_071,
 CASE WHEN k % 53 = 0 THEN NULL WHEN mm < 10 AND k % 3 = 0 THEN concat(cast(mm as string), cast(16 + k % 9 as string))
   ELSE concat(lpad(cast(mm as string), 2, '0'), cast(16 + k % 9 as string)) END AS DATE_OF_INSPECT_090,
 CASE WHEN k % 17 = 0 THEN 'Y24' WHEN k % 19 = 0 THEN NULL ELSE 'N' END AS FRACTURE_092A,
 CASE WHEN k % 13 = 0 THEN NULL ELSE cast(k % 40 as string) END AS PERCENT_ADT_TRUCK_109,
 CASE WHEN k % 11 = 0 THEN 'U' ELSE cast((k*7) % 10 as string) END AS SCOUR_CRITICAL_113,
 CASE WHEN k % 211 = 0 THEN NULL WHEN least(d0, d1, d2) <= 4 THEN 'P' WHEN least(d0, d1, d2) <= 6 THEN 'f ' ELSE 'G' END AS BRIDGE_CONDITION
FROM c)"""

# raw item name -> friendly name, for the columns the derived view has
_RENAMES = [
    ("STATE_CODE_001", "STATE_CODE"), ("STRUCTURE_NUMBER_008", "STRUCTURE_NUMBER"),
    ("RECORD_TYPE_005A", "RECORD_TYPE"), ("COUNTY_CODE_003", "COUNTY_CODE"),
    ("FEATURES_DESC_006A", "FEATURES_INTERSECTED"), ("FACILITY_CARRIED_007", "FACILITY_CARRIED"),
    ("LAT_016", "LATITUDE"), ("LONG_017", "LONGITUDE"), ("YEAR_BUILT_027", "YEAR_BUILT"),
    ("TRAFFIC_LANES_ON_028A", "LANES_ON"), ("ADT_029", "ADT"), ("DESIGN_LOAD_031", "DESIGN_LOAD"),
    ("OPEN_CLOSED_POSTED_041", "OPEN_CLOSED_POSTED"), ("MAX_SPAN_LEN_MT_048", "MAX_SPAN_LEN"),
    ("STRUCTURE_LEN_MT_049", "STRUCTURE_LEN"), ("DECK_COND_058", "DECK_COND"),
    ("SUPERSTRUCTURE_COND_059", "SUPERSTR_COND"), ("SUBSTRUCTURE_COND_060", "SUBSTR_COND"),
    ("CHANNEL_COND_061", "CHANNEL_COND"), ("CULVERT_COND_062", "CULVERT_COND"),
    ("STRUCTURAL_EVAL_067", "STRUCT_EVAL"), ("POSTING_EVAL_070", "BRIDGE_POSTING"),
    ("WATERWAY_EVAL_071", "WATERWAY_EVAL"), ("DATE_OF_INSPECT_090", "INSPECT_DATE"),
    ("FRACTURE_092A", "FRACTURE"), ("PERCENT_ADT_TRUCK_109", "PCT_TRUCK"),
    ("SCOUR_CRITICAL_113", "SCOUR_CRITICAL"), ("BRIDGE_CONDITION", "BRIDGE_CONDITION"),
]

_TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS)


def s(c: str) -> str:
    """Strip all leading/trailing whitespace."""
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def num(c: str) -> str:
    return f"TRY_CAST({s(c)} AS DOUBLE)"


def zpad(c: str, w: int) -> str:
    return (f"(CASE WHEN length({c}) >= {w} THEN {c} WHEN substring({c}, 1, 1) IN ('+', '-') "
            f"THEN substring({c}, 1, 1) || lpad(substring({c}, 2), {w - 1}, '0') ELSE lpad({c}, {w}, '0') END)")


def clip(c: str, lo: str | None, hi: str | None) -> str:
    out = c
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN {c} IS NOT NULL THEN {out} END)"


def risk(c: str, fill: str = "5.0E0") -> str:
    v = f"coalesce({c}, {fill})"
    return (f"least(greatest(CASE WHEN {v} <= 4.0E0 THEN (1.0E0 - {v}/9.0E0) + 0.2E0*(1.0E0 - {v}/4.0E0) "
            f"ELSE 1.0E0 - {v}/9.0E0 END, 0.0E0), 1.0E0)")


def state_name(code: str) -> str:
    from spanrisk.params import STATE_CODES
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_CODES.items())
    return f"coalesce(CASE {zpad(s(code), 2)} {whens} END, 'Unknown')"


REN = "ren AS (SELECT " + ", ".join(
    f"CASE WHEN {a} IN ({_TOKENS}) THEN NULL ELSE {a} END AS {b}" for a, b in _RENAMES) + " FROM raw)"


def _dms(c: str, w: int, d: int) -> str:
    v = zpad(s(c), w)
    return (f"(TRY_CAST(substring({v}, 1, {d}) AS INTEGER) + TRY_CAST(substring({v}, {d + 1}, 2) AS INTEGER)/60.0E0"
            f" + (TRY_CAST(substring({v}, {d + 3}, 4) AS DOUBLE)/100.0E0)/3600.0E0)")


GEO = f"""geo AS (
 SELECT *, {_dms('LATITUDE', 8, 2)} AS LAT, -abs({_dms('LONGITUDE', 9, 3)}) AS LON
 FROM ren WHERE {s('RECORD_TYPE')} = '1')"""

CLN = f"""cln AS (
 SELECT * REPLACE (
  CASE WHEN {num('YEAR_BUILT')} BETWEEN 1800 AND 2025 THEN {num('YEAR_BUILT')} END AS YEAR_BUILT,
  {num('ADT')} AS ADT, {num('LANES_ON')} AS LANES_ON, {num('STRUCTURE_LEN')} AS STRUCTURE_LEN,
  {num('MAX_SPAN_LEN')} AS MAX_SPAN_LEN, {num('PCT_TRUCK')} AS PCT_TRUCK,
  {num('DECK_COND')} AS DECK_COND, {num('SUPERSTR_COND')} AS SUPERSTR_COND, {num('SUBSTR_COND')} AS SUBSTR_COND,
  {num('CHANNEL_COND')} AS CHANNEL_COND, {num('CULVERT_COND')} AS CULVERT_COND,
  {num('STRUCT_EVAL')} AS STRUCT_EVAL, {num('BRIDGE_POSTING')} AS BRIDGE_POSTING,
  {num('SCOUR_CRITICAL')} AS SCOUR_CRITICAL, {num('WATERWAY_EVAL')} AS WATERWAY_EVAL,
  upper({s('BRIDGE_CONDITION')}) AS BRIDGE_CONDITION)
 FROM geo
 WHERE LAT BETWEEN 17.0E0 AND 72.0E0 AND LON BETWEEN -180.0E0 AND -60.0E0)"""

_SCOUR = ("coalesce(CASE WHEN SCOUR_CRITICAL = floor(SCOUR_CRITICAL) THEN CASE CAST(SCOUR_CRITICAL AS INTEGER) "
          "WHEN 0 THEN 0.4E0 WHEN 1 THEN 0.05E0 WHEN 2 THEN 0.05E0 WHEN 3 THEN 0.55E0 WHEN 4 THEN 0.90E0 "
          "WHEN 5 THEN 0.75E0 WHEN 6 THEN 0.65E0 WHEN 7 THEN 1.0E0 WHEN 8 THEN 0.80E0 WHEN 9 THEN 1.0E0 END END, 0.35E0)")
_DESIGN = (f"coalesce(CASE {s('DESIGN_LOAD')} WHEN '0' THEN 0.50E0 WHEN '1' THEN 0.90E0 WHEN '2' THEN 0.80E0 "
           "WHEN '3' THEN 0.75E0 WHEN '4' THEN 0.60E0 WHEN '5' THEN 0.25E0 WHEN '6' THEN 0.20E0 "
           "WHEN '7' THEN 0.10E0 WHEN '8' THEN 0.35E0 WHEN '9' THEN 0.05E0 WHEN 'A' THEN 0.30E0 "
           "WHEN 'B' THEN 0.30E0 WHEN 'C' THEN 0.30E0 END, 0.40E0)")
_YY = f"TRY_CAST(substring({zpad(s('INSPECT_DATE'), 4)}, 3, 2) AS INTEGER)"

FT = f"""f1 AS (
 SELECT *,
  CASE WHEN 2024.0E0 - YEAR_BUILT >= 0 THEN 2024.0E0 - YEAR_BUILT END AS BRIDGE_AGE,
  0.45E0*{risk('SUBSTR_COND')} + 0.35E0*{risk('SUPERSTR_COND')} + 0.20E0*{risk('DECK_COND')} AS BRIDGE_STRUCT_RISK,
  {risk('CULVERT_COND')} AS CULVERT_STRUCT_RISK,
  {risk('SUBSTR_COND')} AS SUBSTR_RISK, {risk('SUPERSTR_COND')} AS SUPER_RISK, {risk('DECK_COND')} AS DECK_RISK,
  {_DESIGN} AS DESIGN_LOAD_RISK,
  CAST(CASE WHEN {_YY} <= 30 THEN 2000 + {_YY} ELSE 1900 + {_YY} END AS DOUBLE) AS INSPECT_YEAR
 FROM cln),
f2 AS (
 SELECT *,
  pow(coalesce({clip('BRIDGE_AGE', '0.0E0', '120.0E0')}, 60.0E0)/120.0E0, 0.7E0) AS AGE_NORM,
  coalesce(CASE WHEN CULVERT_COND IS NOT NULL AND NOT (DECK_COND IS NOT NULL OR SUPERSTR_COND IS NOT NULL OR SUBSTR_COND IS NOT NULL)
       THEN CULVERT_STRUCT_RISK WHEN CULVERT_COND IS NOT NULL THEN 0.5E0*BRIDGE_STRUCT_RISK + 0.5E0*CULVERT_STRUCT_RISK
       ELSE BRIDGE_STRUCT_RISK END, 0.45E0) AS COND_RISK,
  CAST(coalesce(BRIDGE_CONDITION = 'P', false) AS INTEGER) AS IS_POOR,
  CAST(coalesce(least(DECK_COND, SUPERSTR_COND, SUBSTR_COND, CULVERT_COND) <= 4, false) AS INTEGER) AS IS_COND_POOR,
  {clip(_SCOUR + ' * (1.0E0 + 0.5E0*SUBSTR_RISK)', '0.0E0', '1.0E0')} AS SCOUR_RISK,
  CAST(coalesce(starts_with(FRACTURE, 'Y'), false) AS DOUBLE) AS FRACTURE_CRITICAL,
  ln(1.0E0 + coalesce({clip('ADT', '0.0E0', '200000.0E0')}, 0.0E0)) / ln(200001.0E0) AS ADT_LOG_NORM,
  {clip('coalesce(PCT_TRUCK, 0.0E0)', '0.0E0', '100.0E0')}/100.0E0 AS TRUCK_NORM,
  {clip('(5.0E0 - ' + clip('coalesce(BRIDGE_POSTING, 5.0E0)', '0.0E0', '5.0E0') + ')/5.0E0', '0.0E0', '1.0E0')} AS LOAD_POSTED,
  {risk('CHANNEL_COND', '6.0E0')} AS CHANNEL_RISK,
  {risk('STRUCT_EVAL')} AS STRUCT_EVAL_RISK,
  {risk('WATERWAY_EVAL')} AS WATERWAY_RISK,
  2024.0E0 - INSPECT_YEAR AS YEARS_SINCE_INSPECT,
  CAST(coalesce({s('OPEN_CLOSED_POSTED')} IN ('K', 'P'), false) AS INTEGER) AS IS_CLOSED
 FROM f1),
ft AS (
 SELECT *,
  ADT_LOG_NORM * AGE_NORM * (1.0E0 + DESIGN_LOAD_RISK) AS ADT_AGE_STRESS,
  TRUCK_NORM * DESIGN_LOAD_RISK AS TRUCK_LOAD_STRESS,
  coalesce({clip('YEARS_SINCE_INSPECT', '0.0E0', '5.0E0')}/5.0E0, 0.5E0) AS INSPECT_RISK
 FROM f2)"""

SC = """s1 AS (
 SELECT *,
  least(greatest(0.0E0 + 0.30E0*coalesce(COND_RISK, 0.0E0) + 0.18E0*coalesce(STRUCT_EVAL_RISK, 0.0E0)
   + 0.14E0*coalesce(SCOUR_RISK, 0.0E0) + 0.07E0*coalesce(FRACTURE_CRITICAL, 0.0E0)
   + 0.06E0*coalesce(DESIGN_LOAD_RISK, 0.0E0) + 0.06E0*coalesce(LOAD_POSTED, 0.0E0)
   + 0.07E0*coalesce(AGE_NORM, 0.0E0) + 0.04E0*coalesce(ADT_AGE_STRESS, 0.0E0)
   + 0.03E0*coalesce(TRUCK_LOAD_STRESS, 0.0E0) + 0.02E0*coalesce(CHANNEL_RISK, 0.0E0)
   + 0.02E0*coalesce(WATERWAY_RISK, 0.0E0) + 0.01E0*coalesce(INSPECT_RISK, 0.0E0)
   + 0.0E0*coalesce(CAST(IS_CLOSED AS DOUBLE), 0.0E0), 0.0E0), 1.0E0) AS SDI,
  round(1.0E0/(1.0E0 + exp(-(6.0E0*AGE_NORM + 2.0E0*SCOUR_RISK - 6.0E0))), 6) AS ML_PROBA
 FROM ft),
s2 AS (
 SELECT *, CASE WHEN 0.5E0*SDI + 0.5E0*ML_PROBA IS NOT NULL
   THEN least(greatest(0.5E0*SDI + 0.5E0*ML_PROBA, 0.0E0), 1.0E0) END AS RISK_SCORE FROM s1),
sc AS (
 SELECT *, CASE WHEN RISK_SCORE >= 0.75E0 THEN 'Critical' WHEN RISK_SCORE >= 0.5E0 THEN 'High'
   WHEN RISK_SCORE >= 0.25E0 THEN 'Medium' ELSE 'Low' END AS SEVERITY FROM s2)"""

RK = """rk AS (
 SELECT *, row_number() OVER (ORDER BY RISK_SCORE DESC NULLS LAST, STATE_CODE, STRUCTURE_NUMBER) AS SEVERITY_RANK
 FROM sc)"""

OUT = f"""outp AS (
 SELECT STATE_CODE AS state_code, STRUCTURE_NUMBER AS structure_number, FACILITY_CARRIED AS facility_carried,
  FEATURES_INTERSECTED AS features_intersected, COUNTY_CODE AS county_code, LAT AS lat, LON AS lon,
  YEAR_BUILT AS year_built, BRIDGE_AGE AS bridge_age, ADT AS adt, PCT_TRUCK AS pct_truck,
  DECK_COND AS deck_condition, SUPERSTR_COND AS superstr_condition, SUBSTR_COND AS substr_condition,
  CULVERT_COND AS culvert_condition, CHANNEL_COND AS channel_condition,
  BRIDGE_CONDITION AS bridge_condition_category, STRUCT_EVAL AS structural_eval,
  SCOUR_CRITICAL AS scour_critical, BRIDGE_POSTING AS bridge_posting,
  OPEN_CLOSED_POSTED AS open_closed_posted, INSPECT_DATE AS last_inspection,
  STRUCTURE_LEN AS structure_len_m, MAX_SPAN_LEN AS max_span_len_m, LANES_ON AS lanes_on,
  SDI AS sdi_score, ML_PROBA AS ml_risk_proba, RISK_SCORE AS risk_score, SEVERITY AS severity,
  SEVERITY_RANK AS severity_rank, {state_name('STATE_CODE')} AS state_name
 FROM rk)"""

# unranked output (same columns minus severity_rank) for queries that never need the rank
OUTU = OUT.replace("outp AS", "outu AS").replace("  SEVERITY_RANK AS severity_rank, ", "  ").replace("FROM rk)", "FROM sc)")

STAGES = {
    "raw": [RAW],
    "ren": [RAW, REN],
    "cln": [RAW, REN, GEO, CLN],
    "ft": [RAW, REN, GEO, CLN, FT],
    "sc": [RAW, REN, GEO, CLN, FT, SC],
    "rk": [RAW, REN, GEO, CLN, FT, SC, RK],
    "outp": [RAW, REN, GEO, CLN, FT, SC, RK, OUT],
    "outu": [RAW, REN, GEO, CLN, FT, SC, OUTU],
}


def with_stage(stage: str, *extra_ctes: str) -> str:
    """``WITH`` clause text up to ``stage`` plus extra CTEs (no trailing comma)."""
    parts = list(STAGES[stage]) + list(extra_ctes)
    return "WITH " + ",\n".join(parts)


WATER_RE = ("RIVER|CREEK|LAKE|BAY|OCEAN|HARBOR|CHANNEL|STREAM|BROOK|BRANCH|FORK|POND|RESERVOIR|INLET|SOUND|"
            "STRAIT|ESTUARY|BAYOU|SLOUGH|CANAL|WATERWAY|SEA|GULF|COVE|LAGOON")


def _re(c: str, n: int) -> str:
    return f"CAST(round_even(CAST({c} AS DECIMAL(38,15)), {n}) AS DOUBLE)"


def exposure_ctes(src: str) -> list[str]:
    """Exposure CTEs over an output-table CTE ``src``; the last one is ``ex``."""
    span = "coalesce(max_span_len_m, 20.0E0)"
    length = "least(greatest(coalesce(structure_len_m, 30.0E0), 5.0E0), 5000.0E0)"
    speed = ("CASE WHEN coalesce(bridge_posting, 5.0E0) <= 3.0E0 THEN 40.0E0 * 1000.0E0 / 3600.0E0 "
             "ELSE 80.0E0 * 1000.0E0 / 3600.0E0 END")
    t = "least(greatest(coalesce(pct_truck, 10.0E0), 0.0E0), 100.0E0) / 100.0E0"
    fat = ("CASE WHEN NOT is_water_crossing AND span_c = 'short' THEN 0.08E0 WHEN NOT is_water_crossing AND span_c = 'medium' THEN 0.20E0 "
           "WHEN NOT is_water_crossing AND span_c = 'long' THEN 0.40E0 WHEN is_water_crossing AND span_c = 'short' THEN 0.30E0 "
           "WHEN is_water_crossing AND span_c = 'medium' THEN 0.50E0 WHEN is_water_crossing AND span_c = 'long' THEN 0.70E0 ELSE 0.0E0 END")
    inj = ("CASE WHEN NOT is_water_crossing AND span_c = 'short' THEN 0.70E0 WHEN NOT is_water_crossing AND span_c = 'medium' THEN 0.60E0 "
           "WHEN NOT is_water_crossing AND span_c = 'long' THEN 0.45E0 WHEN is_water_crossing AND span_c = 'short' THEN 0.45E0 "
           "WHEN is_water_crossing AND span_c = 'medium' THEN 0.35E0 WHEN is_water_crossing AND span_c = 'long' THEN 0.22E0 ELSE 0.0E0 END")
    return [
        f"""e1 AS (SELECT *,
  1.3E-5 * exp(ln(2.5E-3 / 1.3E-5) * (CASE WHEN risk_score IS NOT NULL THEN least(greatest(risk_score, 0.0E0), 1.0E0) END)) AS p_collapse_1yr,
  greatest(greatest(coalesce(adt, 0.0E0), 0.0E0) * 0.10E0 * (({length} / ({speed})) / 3600.0E0)
    * ((1.0E0 - {t}) * 1.67E0 + {t} * 1.10E0), 0.0E0) AS rush_hour_persons,
  coalesce(regexp_matches(upper(features_intersected), '{WATER_RE}'), false) AS is_water_crossing,
  CASE WHEN {span} >= 0 AND {span} < 20 THEN 'short' WHEN {span} >= 20 AND {span} < 50 THEN 'medium'
       WHEN {span} >= 50 AND {span} < 9999 THEN 'long' END AS span_c,
  {t} AS t_frac
 FROM {src})""",
        f"""e2 AS (SELECT *, {fat} AS fat0, {inj} AS inj0 FROM e1)""",
        """e3 AS (SELECT *, fat0 * (1.0E0 - t_frac) + least(greatest(fat0 + 0.15E0, 0.0E0), 1.0E0) * t_frac AS fat_a FROM e2)""",
        """e4 AS (SELECT *, least(inj0, 1.0E0 - fat_a) AS inj_a FROM e3)""",
        f"""e5 AS (SELECT *, {_re('fat_a', 3)} AS fatality_rate, {_re('inj_a', 3)} AS injury_rate,
  {_re('greatest(1.0E0 - fat_a - inj_a, 0.0E0)', 3)} AS unharmed_rate FROM e4)""",
        f"""ex AS (SELECT * EXCLUDE (span_c, t_frac, fat0, inj0, fat_a, inj_a),
  {_re('p_collapse_1yr * rush_hour_persons * fatality_rate', 5)} AS expected_fatalities,
  {_re('p_collapse_1yr * rush_hour_persons * injury_rate', 5)} AS expected_injuries,
  {_re('p_collapse_1yr * rush_hour_persons', 5)} AS expected_affected FROM e5)""",
    ]


STAGES["exu"] = STAGES["outu"] + exposure_ctes("outu")
STAGES["exr"] = STAGES["outp"] + exposure_ctes("outp")
