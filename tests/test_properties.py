"""Property tests: random text inputs, Spark column helpers vs plain-Python rules."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanrisk.functions.columns import cond_to_risk
from spanrisk.operators.clean import decode_latitude, decode_longitude
from spanrisk.operators.exposure import water_crossing
from spanrisk.operators.features import design_load_risk, inspection_year
from spanrisk.params import DESIGN_LOAD_RISK_MAP, WATER_WORDS

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
digits = st.text(alphabet="0123456789", min_size=0, max_size=10)
messy = st.one_of(digits, st.text(alphabet="0123456789 .-xN", max_size=9), st.none())


def _apply(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def _py_dms(v, width, dlen):
    if v is None:
        return None
    s = v.strip().zfill(width)
    try:
        deg, mn = int(s[:dlen]), int(s[dlen:dlen + 2])
        sec = float(s[dlen + 2:dlen + 6]) / 100
    except ValueError:
        return None
    return deg + mn / 60 + sec / 3600


def _py_year(v):
    if v is None:
        return None
    try:
        yy = int(v.strip().zfill(4)[2:4])
    except ValueError:
        return None
    return float(2000 + yy if yy <= 30 else 1900 + yy)


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=0, abs_tol=1e-9)


@SETTINGS
@given(st.lists(st.one_of(digits, st.none()), min_size=1, max_size=40))
def test_coordinates_digit_text(spark, values):
    lat = _apply(spark, decode_latitude, values)
    lon = _apply(spark, decode_longitude, values)
    for v, a, b in zip(values, lat, lon):
        assert _close(a, _py_dms(v, 8, 2)), v
        want = _py_dms(v, 9, 3)
        assert _close(b, None if want is None else -abs(want)), v


@SETTINGS
@given(st.lists(st.one_of(digits, st.none()), min_size=1, max_size=40))
def test_inspection_year_digit_text(spark, values):
    for v, got in zip(values, _apply(spark, inspection_year, values)):
        assert got == _py_year(v), v


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.floats(min_value=-3, max_value=12, allow_nan=False)), min_size=1, max_size=40),
       st.sampled_from([5.0, 6.0]))
def test_condition_risk(spark, values, fill):
    got = _apply(spark, lambda c: cond_to_risk(c, fill), values, "double")
    for v, g in zip(values, got):
        c = fill if v is None else v
        r = 1 - c / 9 + (0.2 * (1 - c / 4) if c <= 4 else 0.0)
        assert _close(g, min(max(r, 0.0), 1.0)), v


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(list(DESIGN_LOAD_RISK_MAP)), st.text(max_size=3)),
                min_size=1, max_size=40))
def test_design_load_lookup(spark, values):
    for v, g in zip(values, _apply(spark, design_load_risk, values)):
        want = DESIGN_LOAD_RISK_MAP.get(v.strip(" \t\n\r\x0b\x0c"), 0.40) if v is not None else 0.40
        assert g == want, v


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcdefghijklmnopqrstuvwxyz RIVERSEACOVE", max_size=20)),
                min_size=1, max_size=40))
def test_water_crossing(spark, values):
    for v, g in zip(values, _apply(spark, water_crossing, values)):
        want = v is not None and any(w in v.upper() for w in WATER_WORDS)
        assert g == want, v


@SETTINGS
@given(st.lists(messy, min_size=1, max_size=40))
def test_coordinates_and_year_messy_text(spark, values):
    lat = _apply(spark, decode_latitude, values)
    years = _apply(spark, inspection_year, values)
    for v, a, y in zip(values, lat, years):
        assert _close(a, _py_dms(v, 8, 2)), v
        assert y == _py_year(v), v
