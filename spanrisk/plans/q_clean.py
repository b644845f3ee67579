"""Queries for cleaning: record filter, coordinates, bounds, coercion."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanrisk.operators import clean as C
from spanrisk.operators.features import engineer_features
from spanrisk.operators.rank import format_output
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.common import KEY, project, rounded

_K = "STATE_CODE, STRUCTURE_NUMBER"


@query("filter_record_type", "clean", sql=f"""{O.with_stage('ren')}
SELECT {_K}, RECORD_TYPE FROM ren WHERE {O.s('RECORD_TYPE')} = '1'""")
def q_filter_record_type(spark, sf):
    return C.filter_record_type(P.renamed(spark, sf)).select(*KEY, "RECORD_TYPE")


@query("decode_latitude", "clean", sql=f"""{O.with_stage('ren')}
SELECT {_K}, LATITUDE, round({O._dms('LATITUDE', 8, 2)}, 6) AS LAT FROM ren""")
def q_decode_latitude(spark, sf):
    r = P.renamed(spark, sf)
    return project(r.withColumn("LAT", C.decode_latitude(F.col("LATITUDE"))), ["LATITUDE", "LAT"])


@query("decode_longitude", "clean", sql=f"""{O.with_stage('ren')}
SELECT {_K}, LONGITUDE, round(-abs({O._dms('LONGITUDE', 9, 3)}), 6) AS LON FROM ren""")
def q_decode_longitude(spark, sf):
    r = P.renamed(spark, sf)
    return project(r.withColumn("LON", C.decode_longitude(F.col("LONGITUDE"))), ["LONGITUDE", "LON"])


@query("filter_geo_bounds", "clean", sql=f"""{O.with_stage('cln')}
SELECT {_K}, round(LAT, 6) AS LAT, round(LON, 6) AS LON FROM cln""")
def q_filter_geo_bounds(spark, sf):
    df = C.filter_geo_bounds(C.with_coordinates(C.filter_record_type(P.renamed(spark, sf))))
    return project(df, ["LAT", "LON"])


@query("audit_row_counts", "clean", sql=f"""{O.with_stage('ren')},
g AS (SELECT {O.s('RECORD_TYPE')} = '1' AS rt, {O._dms('LATITUDE', 8, 2)} AS LAT, -abs({O._dms('LONGITUDE', 9, 3)}) AS LON FROM ren),
h AS (SELECT rt, (LAT BETWEEN 17.0E0 AND 72.0E0 AND LON BETWEEN -180.0E0 AND -60.0E0) AS ok FROM g)
SELECT count(*) AS rows_read, count_if(rt) AS rows_record_type, count_if(NOT coalesce(rt, false)) AS dropped_record_type,
 count_if(rt AND ok) AS rows_clean, count_if(rt AND NOT coalesce(ok, false)) AS dropped_geo FROM h""")
def q_audit_row_counts(spark, sf):
    return C.audit_row_counts(P.renamed(spark, sf))


@query("coerce_numeric", "clean", sql=f"""{O.with_stage('cln')}
SELECT {_K}, YEAR_BUILT, ADT, LANES_ON, STRUCTURE_LEN, MAX_SPAN_LEN, PCT_TRUCK FROM cln""")
def q_coerce_numeric(spark, sf):
    return project(P.cleaned(spark, sf), ["YEAR_BUILT", "ADT", "LANES_ON", "STRUCTURE_LEN", "MAX_SPAN_LEN", "PCT_TRUCK"])


@query("coerce_conditions", "clean", sql=f"""{O.with_stage('cln')}
SELECT {_K}, DECK_COND, SUPERSTR_COND, SUBSTR_COND, CHANNEL_COND, CULVERT_COND FROM cln""")
def q_coerce_conditions(spark, sf):
    return project(P.cleaned(spark, sf), ["DECK_COND", "SUPERSTR_COND", "SUBSTR_COND", "CHANNEL_COND", "CULVERT_COND"])


@query("coerce_ratings", "clean", sql=f"""{O.with_stage('cln')}
SELECT {_K}, STRUCT_EVAL, BRIDGE_POSTING, SCOUR_CRITICAL, WATERWAY_EVAL FROM cln""")
def q_coerce_ratings(spark, sf):
    return project(P.cleaned(spark, sf), ["STRUCT_EVAL", "BRIDGE_POSTING", "SCOUR_CRITICAL", "WATERWAY_EVAL"])


@query("normalise_category", "clean", sql=f"""{O.with_stage('cln')}
SELECT {_K}, BRIDGE_CONDITION FROM cln""")
def q_normalise_category(spark, sf):
    return project(P.cleaned(spark, sf), ["BRIDGE_CONDITION"])


@query("year_sanity", "clean", sql=f"""{O.with_stage('cln')}
SELECT {_K}, YEAR_BUILT FROM cln""")
def q_year_sanity(spark, sf):
    return project(P.cleaned(spark, sf), ["YEAR_BUILT"])


@query("drop_missing_geo", "clean", sql=f"""{O.with_stage('outu')}
SELECT state_code, structure_number, round(lat, 6) AS lat, round(lon, 6) AS lon FROM outu
WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def q_drop_missing_geo(spark, sf):
    out = format_output(P.scored(spark, sf))
    return rounded(C.drop_missing_geo(out).select("state_code", "structure_number", "lat", "lon"))


_OPTIONAL_DROP = ["FRACTURE", "SCOUR_CRITICAL", "DESIGN_LOAD", "PCT_TRUCK", "BRIDGE_POSTING",
                  "CHANNEL_COND", "STRUCT_EVAL", "WATERWAY_EVAL", "INSPECT_DATE", "OPEN_CLOSED_POSTED"]


@query("default_missing_columns", "clean", sql=f"""{O.with_stage('cln')}
SELECT {_K}, 0.0E0 AS FRACTURE_CRITICAL, 0.4E0 AS DESIGN_LOAD_RISK,
 round(least(greatest(0.35E0 * (1.0E0 + 0.5E0*{O.risk('SUBSTR_COND')}), 0.0E0), 1.0E0), 6) AS SCOUR_RISK,
 0.0E0 AS TRUCK_NORM, 0.0E0 AS LOAD_POSTED, 0.0E0 AS CHANNEL_RISK, 0.0E0 AS STRUCT_EVAL_RISK,
 0.0E0 AS WATERWAY_RISK, 0.3E0 AS INSPECT_RISK, 0 AS IS_CLOSED FROM cln""")
def q_default_missing_columns(spark, sf):
    """Optional inputs absent from the schema take the published constants."""
    df = engineer_features(P.cleaned(spark, sf).drop(*_OPTIONAL_DROP))
    return project(df, ["FRACTURE_CRITICAL", "DESIGN_LOAD_RISK", "SCOUR_RISK", "TRUCK_NORM", "LOAD_POSTED",
                        "CHANNEL_RISK", "STRUCT_EVAL_RISK", "WATERWAY_RISK", "INSPECT_RISK", "IS_CLOSED"])

