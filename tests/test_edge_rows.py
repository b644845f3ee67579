"""Edge rows (FIXTURES.md §C): reader quirks and scalar semantics."""

import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from spanrisk.functions.columns import clip, cond_to_risk, zpad
from spanrisk.operators.clean import decode_latitude, decode_longitude
from spanrisk.operators.exposure import span_category, water_crossing, water_crossing_strict
from spanrisk.operators.features import inspection_year
from spanrisk.sources.delimited import normalise_nulls, rejected_rows, scan_delimited


def _one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(col(F.col("x")).alias("y")).collect()]


def test_scan_delimited_row_shapes(spark):
    text = "\n".join([
        "A,B,C",
        "1,'it''s',x",          # quoted quote
        "2,b,c,EXTRA",          # one field too many -> dropped
        "3,b,c,",               # surplus blank field -> dropped
        "4,b",                  # one field too few -> kept, tail NULL
        "5,NA,None",            # missing tokens
        "6,' ',nan",            # single blank (quoted) and nan
        "7,b,c,d,e",            # several too many -> dropped
    ]) + "\n"
    d = tempfile.mkdtemp(prefix="edge-", dir="/tmp")
    path = os.path.join(d, "inv.txt")
    with open(path, "w") as fh:
        fh.write(text)
    df = normalise_nulls(scan_delimited(spark, path))
    rows = {r["A"]: (r["B"], r["C"]) for r in df.collect()}
    assert set(rows) == {"1", "4", "5", "6"}
    assert rows["1"] == ("it's", "x")
    assert rows["4"] == ("b", None)
    assert rows["5"] == (None, None)
    assert rows["6"] == (None, None)
    # the count and a one-column projection agree with the full read
    assert df.count() == 4
    assert scan_delimited(spark, path).select("A").count() == 4
    assert tuple(rejected_rows(spark, path).first()) == (3, 0)


def delimited_file(rows, names, rng):
    """Text of a file in which fields that need it (and some that do not) are quoted."""
    def field(v):
        plain = v is None or not (set(v) & set(",'\n"))
        return (v or "") if plain and rng.random() < 0.8 else "'" + (v or "").replace("'", "''") + "'"

    return "\n".join([",".join(names), *(",".join(field(v) for v in r) for r in rows)]) + "\n"


@pytest.mark.parametrize("block", ["64m", "1k"])
def test_fields_with_line_breaks(spark, tmp_path, block):
    rng = random.Random(3)
    said = ["x", "", "a b", "it's", "one, two", "line\nbreak", "'", "''", "\n,\n'", "né 漢", "several\n\nlines\n" * 3, None]
    names, want = ["A", "B", "C", "D"], []
    for k in range(3):
        rows = [(f"{k}-{i}", *(rng.choice(said) for _ in range(3))) for i in range(400)]
        (tmp_path / f"part{k}.txt").write_text(delimited_file(rows, names, rng))
        want += [tuple(v or None for v in r) for r in rows]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = scan_delimited(spark, str(tmp_path))
        key = lambda r: tuple(x or "" for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        assert tuple(rejected_rows(spark, str(tmp_path)).first()) == (0, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_field_that_never_ends(spark, tmp_path):
    path = tmp_path / "inv.txt"
    path.write_text("A,B,C\n1,'two\nlines',y\n2,b,c\n3,'one, quoted',z\n4,'open,q\n5,b,c\n")
    assert sorted(map(tuple, scan_delimited(spark, str(path)).collect())) == [
        ("1", "two\nlines", "y"), ("2", "b", "c"), ("3", "one, quoted", "z")]
    assert tuple(rejected_rows(spark, str(path)).first()) == (0, 2)
    assert scan_delimited(spark, str(path)).select("C").count() == 3


def test_two_columns_of_many_make_two(spark, tmp_path):
    names = [f"c{i}" for i in range(28)]
    (tmp_path / "wide.txt").write_text("\n".join([",".join(names), ",".join(map(str, range(28))), ",".join("x" * 29)]) + "\n")
    few = scan_delimited(spark, str(tmp_path)).select("c3", "c27")
    assert [tuple(r) for r in few.collect()] == [("3", "27")]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.split("\n") if " AS c27" in line)
    assert "AS c3" in top and "AS c4" not in top and "_corrupt" not in plan


def test_inspection_year(spark):
    out = _one(spark, inspection_year, ["823", "0823", "082023", " 8", None])
    assert out == [2023.0, 2023.0, 2020.0, 2008.0, None]


def test_condition_to_risk_table(spark):
    got = _one(spark, lambda c: cond_to_risk(c, 5.0), [9.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0], "double")
    want = [0, .1111, .2222, .3333, .4444, .5556, .7167, .8778, 1, 1]
    assert [round(g, 4) for g in got] == pytest.approx(want, abs=1e-4)


def test_span_category(spark):
    got = _one(spark, span_category, [0.0, 19.99, 20.0, 50.0, 9999.0, -1.0, None], "double")
    assert got == ["short", "short", "medium", "long", None, None, "medium"]


def test_water_crossing(spark):
    got = _one(spark, water_crossing, ["SEATTLE AVE", "WILLOW RUN", "Big Sandy River", None])
    assert got == [True, False, True, False]
    strict = _one(spark, water_crossing_strict, ["SEATTLE AVE", "WILLOW RUN", "Big Sandy River", None])
    assert strict == [False, True, True, False]


def test_null_safe_clip_and_pad(spark):
    assert _one(spark, lambda c: clip(c, 0.0, 120.0), [None, -5.0, 500.0], "double") == [None, 0.0, 120.0]
    assert _one(spark, lambda c: zpad(c, 2), ["1", "12", "123"]) == ["01", "12", "123"]


def test_coordinates(spark):
    lat = _one(spark, decode_latitude, ["38123456", "1234", None, "ab123456"])
    assert lat[0] == pytest.approx(38 + 12 / 60 + 34.56 / 3600)
    assert lat[1] == pytest.approx(0 + 0 / 60 + 12.34 / 3600)
    assert lat[2] is None and lat[3] is None
    lon = _one(spark, decode_longitude, ["077123456"])
    assert lon[0] == pytest.approx(-(77 + 12 / 60 + 34.56 / 3600))
    assert not math.isnan(lon[0])


def test_only_lines_with_a_column_name_are_compared_with_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("'K','NA'ME\n1,NAME\n'K','x'\n")
    (tmp_path / "b.csv").write_text("K,NAME\n'NAME',K\n")
    df = scan_delimited(spark, str(tmp_path), header=["K", "NAME"])
    assert sorted(map(tuple, df.collect())) == [("1", "NAME"), ("K", "x"), ("NAME", "K")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(replace(" in plan
