"""Queries for sources and sinks: each writes with a sink,
reads back with the matching source, and is checked on the read-back rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.operators import maplayer as M
from spanrisk.operators import rank as R
from spanrisk.operators import summary as S
from spanrisk.plans import oracle_base as O
from spanrisk.plans import pipeline as P
from spanrisk.plans.catalog import query
from spanrisk.plans.q_maplayer import MAPPED_SQL, PROPERTIES_SQL
from spanrisk.plans.common import rounded
from spanrisk.plans.q_rank import SUMMARY_SQL
from spanrisk.session import scratch_path
from spanrisk.sources import delimited as D
from spanrisk.sources import sinks as K
from spanrisk.sources.inventory import staged_raw_inventory

_RAW_COLS = [a for a, _ in O._RENAMES]


@query("scan_delimited", "sources", sql=f"""{O.with_stage('raw')}
SELECT {", ".join(_RAW_COLS)} FROM raw""")
def q_scan_delimited(spark, sf):
    """Raw inventory written as quote-' delimited text, then read with the delimited reader."""
    path = scratch_path(spark, "raw_csv")
    (staged_raw_inventory(spark, sf).write.option("header", True).option("quote", "'").option("escape", "'")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return D.scan_delimited(spark, path)


@query("rename_columns", "sources", sql=f"""{O.with_stage('raw')}
SELECT {", ".join(f"{a} AS {b}" for a, b in O._RENAMES)} FROM raw""")
def q_rename_columns(spark, sf):
    return D.rename_columns(staged_raw_inventory(spark, sf))


@query("normalise_nulls", "sources", sql=f"""{O.with_stage('ren')}
SELECT * FROM ren""")
def q_normalise_nulls(spark, sf):
    return P.renamed(spark, sf)


@query("stage_parquet", "sources", sql=f"""{O.with_stage('cln')}
SELECT STATE_CODE, STRUCTURE_NUMBER, round(LAT, 6) AS LAT, round(LON, 6) AS LON, YEAR_BUILT, ADT, DECK_COND,
 BRIDGE_CONDITION FROM cln""")
def q_stage_parquet(spark, sf):
    path = scratch_path(spark, "clean_stage")
    K.stage_parquet(P.cleaned_once(spark, sf), path)
    back = K.read_stage(spark, path)
    return rounded(back.select("STATE_CODE", "STRUCTURE_NUMBER", "LAT", "LON", "YEAR_BUILT", "ADT", "DECK_COND",
                               "BRIDGE_CONDITION"))


_SUMMARY_SCHEMA = T.StructType([
    T.StructField("STATE_CODE", T.StringType()), T.StructField("total_bridges", T.LongType()),
    T.StructField("critical", T.LongType()), T.StructField("high", T.LongType()),
    T.StructField("medium", T.LongType()), T.StructField("low", T.LongType()),
    T.StructField("avg_risk", T.DoubleType()), T.StructField("poor_condition", T.LongType()),
    T.StructField("state_name", T.StringType())])


@query("sink_csv", "sources", sql=f"""{O.with_stage('sc', SUMMARY_SQL)}
SELECT STATE_CODE, total_bridges, critical, high, medium, low, round(avg_risk, 6) AS avg_risk, poor_condition, state_name
FROM ss""")
def q_sink_csv(spark, sf):
    """State summary to CSV with header; read back with an explicit schema (codes stay text)."""
    path = scratch_path(spark, "state_summary_csv")
    K.sink_csv(R.state_ranking(R.state_summary(P.scored(spark, sf))), path)
    return rounded(spark.read.schema(_SUMMARY_SCHEMA).option("header", True).csv(path))


_TOP_COLS = ["severity_rank", "state_code", "structure_number", "facility_carried", "risk_score", "severity",
             "p_collapse_1yr", "expected_fatalities"]


@query("sink_csv_gzip", "sources", sql=f"""{O.with_stage('exu')},
t AS (SELECT *, row_number() OVER (ORDER BY risk_score DESC, state_code, structure_number) AS rn FROM ex)
SELECT rn AS severity_rank, state_code, structure_number, facility_carried, round(risk_score, 6) AS risk_score, severity,
 round(p_collapse_1yr, 12) AS p_collapse_1yr, expected_fatalities FROM t WHERE rn <= 1000""")
def q_sink_csv_gzip(spark, sf):
    """Top-1000 exposure list as gzip CSV, read back."""
    top = R.top_by_rank(P.exposure_table(spark, sf, with_rank=True), 1000).select(*_TOP_COLS)
    path = scratch_path(spark, "top1000_gz")
    K.sink_csv(top, path, gzip=True)
    schema = T.StructType([T.StructField("severity_rank", T.LongType()), T.StructField("state_code", T.StringType()),
                           T.StructField("structure_number", T.StringType()),
                           T.StructField("facility_carried", T.StringType()),
                           T.StructField("risk_score", T.DoubleType()), T.StructField("severity", T.StringType()),
                           T.StructField("p_collapse_1yr", T.DoubleType()),
                           T.StructField("expected_fatalities", T.DoubleType())])
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query("scan_csv_pruned", "sources", sql=f"""{O.with_stage('outu')}
SELECT state_code, state_name, severity, bridge_condition_category FROM outu""")
def q_scan_csv_pruned(spark, sf):
    """Ranked table to CSV, read back only four columns with an explicit text schema."""
    path = scratch_path(spark, "ranked_csv")
    out = P.output_unranked(spark, sf)
    K.sink_csv(out, path)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in
                                         ("state_code", "state_name", "severity", "bridge_condition_category",
                                          "structure_number", "facility_carried", "features_intersected",
                                          "county_code", "open_closed_posted", "last_inspection") else f.dataType)
                           for f in out.schema.fields])
    return D.scan_csv_pruned(spark, path, ["state_code", "state_name", "severity", "bridge_condition_category"], schema)


@query("sink_json_report", "sources", sql=f"""{O.with_stage('outu')}
SELECT count(*) AS total_bridges, count_if(severity = 'Critical') AS n_critical, count_if(severity = 'High') AS n_high,
 round(avg(bridge_age), 6) AS mean_age, CAST(sum(adt) AS BIGINT) AS total_daily_crossings FROM outu""")
def q_sink_json_report(spark, sf):
    """One-row statistics record to JSON, read back with its schema."""
    st = S.stats_core(P.output_unranked(spark, sf)).select(
        "total_bridges", "n_critical", "n_high", "mean_age", "total_daily_crossings")
    path = scratch_path(spark, "statistics_json")
    K.sink_json_report(st, path)
    return rounded(spark.read.schema(st.schema).json(path))


@query("sink_geojson", "sources", sql=f"""{O.with_stage('exr')}, {MAPPED_SQL}
SELECT severity AS layer, round(lon, 6) AS lon, round(lat, 6) AS lat, {PROPERTIES_SQL}
FROM m WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def q_sink_geojson(spark, sf):
    """GeoJSON point features per tier (newline JSON, one folder per tier), parsed back with all data properties."""
    props = M.map_properties(P.exposure_table(spark, sf, with_rank=True))
    path = scratch_path(spark, "geojson")
    K.sink_geojson(props, path, M.DATA_PROPERTIES)
    types = {f.name: f.dataType.simpleString() for f in props.schema.fields}
    schema = ("type string, geometry struct<type:string,coordinates:array<double>>, properties struct<"
              + ",".join(f"{c}:{types[c]}" for c in M.DATA_PROPERTIES) + ">")
    back = spark.read.text(path).select(F.col("severity").alias("layer"), F.from_json("value", schema).alias("f"))
    at = F.col("f.geometry.coordinates")
    return rounded(back.select("layer", at[0].alias("lon"), at[1].alias("lat"), "f.properties.*"))
