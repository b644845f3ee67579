"""Cleaning: record filter, coordinate decoding, bounds, numeric coercion.

All steps are narrow projections/filters; Catalyst fuses them into one
codegen stage directly above the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrisk.functions.columns import coded_to_double, strip_ws, to_double, to_int, zpad
from spanrisk.params import CONDITION_COLS, DEFAULT_MODEL, NUMERIC_COLS, RATING_COLS, ModelParams


def filter_record_type(df: DataFrame, value: str = "1") -> DataFrame:
    """Keep highway structures (record type '1', whitespace ignored)."""
    if "RECORD_TYPE" not in df.columns:
        return df
    return df.filter(strip_ws(F.col("RECORD_TYPE")) == value)


def _dms(c: Column, width: int, deg_len: int) -> Column:
    """Degrees/minutes/seconds-hundredths text to decimal degrees; bad text -> NULL."""
    v = zpad(strip_ws(c), width)
    deg = to_int(F.substring(v, 1, deg_len))
    mn = to_int(F.substring(v, deg_len + 1, 2))
    sec = to_double(F.substring(v, deg_len + 3, 4)) / 100.0
    return deg + mn / 60.0 + sec / 3600.0


def decode_latitude(c: Column) -> Column:
    """DDMMSSHH, left-padded to 8."""
    return _dms(c, 8, 2)


def decode_longitude(c: Column) -> Column:
    """DDDMMSSHH, left-padded to 9; always west (negative)."""
    return -F.abs(_dms(c, 9, 3))


def with_coordinates(df: DataFrame) -> DataFrame:
    if "LATITUDE" not in df.columns:
        return df
    return df.withColumns({"LAT": decode_latitude(F.col("LATITUDE")),
                           "LON": decode_longitude(F.col("LONGITUDE"))})


def geo_ok(p: ModelParams = DEFAULT_MODEL) -> Column:
    return (F.col("LAT").between(p.lat_min, p.lat_max)
            & F.col("LON").between(p.lon_min, p.lon_max))


def filter_geo_bounds(df: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Inclusive bounds; a NULL coordinate fails."""
    if "LAT" not in df.columns:
        return df
    return df.filter(geo_ok(p))


def coerce_numeric(df: DataFrame) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in NUMERIC_COLS if c in df.columns})


def coerce_conditions(df: DataFrame) -> DataFrame:
    return df.withColumns({c: coded_to_double(F.col(c)) for c in CONDITION_COLS if c in df.columns})


def coerce_ratings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: coded_to_double(F.col(c)) for c in RATING_COLS if c in df.columns})


def normalise_category(df: DataFrame) -> DataFrame:
    if "BRIDGE_CONDITION" not in df.columns:
        return df
    return df.withColumn("BRIDGE_CONDITION", F.upper(strip_ws(F.col("BRIDGE_CONDITION"))))


def year_sanity(df: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    if "YEAR_BUILT" not in df.columns:
        return df
    y = F.col("YEAR_BUILT")
    return df.withColumn("YEAR_BUILT", F.when(y.between(p.year_min, p.year_max), y))


def typed(df: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Renamed raw inventory with its types fixed, all rows. Staged, it is what the row filters and features read: a
    filter on a decoded coordinate over plain columns is pushed to the scan, and is not inlined into it many times."""
    df = with_coordinates(df)
    df = coerce_numeric(df)
    df = coerce_conditions(df)
    df = coerce_ratings(df)
    df = normalise_category(df)
    return year_sanity(df, p)


def valid_rows(df: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Rows of the kept record type inside the bounds."""
    return filter_geo_bounds(filter_record_type(df), p)


def clean(df: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Renamed raw inventory -> clean table (types fixed, bad rows removed)."""
    return valid_rows(typed(df, p), p)


def audit_row_counts(renamed: DataFrame, p: ModelParams = DEFAULT_MODEL) -> DataFrame:
    """Rows before/after each cleaning filter, as one aggregate pass."""
    rt = strip_ws(F.col("RECORD_TYPE")) == "1"
    with_geo = with_coordinates(renamed)
    return with_geo.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(rt).alias("rows_record_type"),
        F.count_if(~F.coalesce(rt, F.lit(False))).alias("dropped_record_type"),
        F.count_if(rt & geo_ok(p)).alias("rows_clean"),
        F.count_if(rt & ~F.coalesce(geo_ok(p), F.lit(False))).alias("dropped_geo"),
    )


def default_missing_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Give absent optional columns a constant (decided at plan-build time)."""
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def drop_missing_geo(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.dropna(subset=[lat, lon])
