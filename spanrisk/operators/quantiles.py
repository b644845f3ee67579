"""Exact medians, and values at other places of the sorted order, by repeated histograms.

Each pass counts rows by cell, a non-decreasing function of the value, for all columns and groups at once; partial
aggregation leaves at most ``CELLS`` rows per column, group and task to the shuffle. A cell that holds a place sought is
cut up again in the next pass, between its smallest and largest value. First cells are eighths of an octave (signed),
later ones equal widths, so five passes exhaust the bits of a double; a cell of ``LISTED`` rows or fewer is listed by
value, so that most columns need three. Nothing is sorted or staged, no buffer holds a value per row, and a few rows per
column, group and place come to the driver in each pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 13
LISTED = 4096
_OCTAVE_PARTS = 8
#: Above every binary exponent of a double, in parts of an octave; infinities are farther out.
_OFFSET, _INFINITE = 10_000, 30_000


@dataclass
class _Open:
    """A range with places still sought in one column and group: rows with ``lo <= value <= hi``, ``rows`` of them."""

    column: int
    group: tuple
    lo: float
    hi: float
    rows: int
    places: dict[int, int]  # number of the place sought -> where it is among these rows


def _first_cell(v: Column) -> Column:
    """Signed part of an octave; the logarithm never decreases as the value grows."""
    part = F.floor(F.log2(F.abs(v)) * _OCTAVE_PARTS) + _OFFSET
    size = F.when(F.abs(v) == math.inf, F.lit(_INFINITE)).otherwise(part)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("double")


def _is_group(group: Sequence[str], values: tuple) -> Column:
    same = F.lit(True)
    for name, value in zip(group, values):
        same = same & F.col(f"`{name}`").eqNullSafe(F.lit(value))
    return same


def _long(df: DataFrame, values: Sequence[str], group: Sequence[str], ids: list[Column] | None) -> DataFrame:
    """A row for each value: the group's columns (or the number of the open range) and ``v``; no null or NaN."""
    cells = [F.struct((F.lit(i) if ids is None else ids[i]).cast("int").alias("id"),
                      F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(values)]
    keys = [F.col(f"`{g}`") for g in group] if ids is None else []
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("x"))
    v = F.col("x.v")
    return rows.filter(v.isNotNull() & ~F.isnan(v) & F.col("x.id").isNotNull()).select(
        *keys, F.col("x.id").alias("id"), v.alias("v"))


def _narrow(cells: list, places: dict[int, int], column: int, group: tuple, found: dict) -> list[_Open]:
    """Settle the places that the ends of their cell decide; the rest stay open with their cells.
    ``cells``: (rows before, rows, smallest, largest) of the cells with a place."""
    left = []
    for before, n, lo, hi in cells:
        still = {}
        for name, place in places.items():
            k = place - before
            if 0 <= k < n and (lo == hi or k in (0, n - 1)):
                found[group, column][name] = lo if k == 0 else hi
            elif 0 <= k < n:
                still[name] = k
        if still:
            left.append(_Open(column, group, lo, hi, n, still))
    return left


def order_values(df: DataFrame, values: Sequence[str], places: Sequence[Callable[[Column], Column]],
                 group: Sequence[str] = ()) -> dict[tuple, list]:
    """Per group (a tuple of ``group``'s values): for each of ``values`` the values at ``places`` of its ascending order,
    or None for a column without any. A place is counted from 0 and given as a function of the number of rows; one
    outside the order gives None. Nulls and NaN are left out. ``group`` names few groups. ``df`` is read in every pass."""
    spark, group = df.sparkSession, list(group)
    keys = [f"`{g}`" for g in group]
    rows = _long(df, values, group, None).withColumn("cell", _first_cell(F.col("v")))
    cells = rows.groupBy(*keys, "id", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    by = Window.partitionBy(*keys, "id")
    upto = F.sum("n").over(by.orderBy("cell"))
    at = F.array(*[p(F.sum("n").over(by)).cast("bigint") for p in places])
    cells = cells.withColumns({"before": upto - F.col("n"), "places": at})
    inside = F.exists("places", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    held: dict = {}
    for r in cells.filter(inside).collect():
        key = tuple(r[g] for g in group), r["id"]
        held.setdefault(key, (r["places"], []))[1].append((r["before"], r["n"], r["lo"], r["hi"]))
    found: dict = {key: {} for key in held}
    ranges = [x for (g, c), (at, cells) in held.items() for x in _narrow(cells, dict(enumerate(at)), c, g, found)]
    while ranges:
        ranges = _pass(spark, df, values, group, ranges, found)
    groups: dict[tuple, list] = {}
    for (g, c), by_place in found.items():
        groups.setdefault(g, [None] * len(values))[c] = tuple(by_place.get(i) for i in range(len(places)))
    return groups


def _pass(spark, df: DataFrame, values, group, ranges: list[_Open], found: dict) -> list[_Open]:
    """Cut every open range once more."""
    ids = []
    for c, name in enumerate(values):
        value = F.col(f"`{name}`").cast("double")
        which = F.lit(None).cast("int")
        for i, x in enumerate(ranges):
            if x.column == c:
                which = F.when(_is_group(group, x.group) & value.between(x.lo, x.hi), F.lit(i)).otherwise(which)
        ids.append(which)

    def of(pick) -> Column:
        return F.get(F.array(*[F.lit(pick(x)) for x in ranges]), F.col("id"))

    v, lo, hi = F.col("v"), of(lambda x: float(x.lo)), of(lambda x: float(x.hi))
    width = F.least(F.floor((v - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1)).cast("double")
    cell = F.when(of(lambda x: x.rows <= LISTED), v).otherwise(width)
    rows = _long(df, values, group, ids).withColumn("cell", cell)
    cells = rows.groupBy("id", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("cell"))
    cells = cells.withColumn("before", upto - F.col("n"))
    first, last = of(lambda x: min(x.places.values())), of(lambda x: max(x.places.values()))
    hit = cells.filter((F.col("before") <= last) & (F.col("before") + F.col("n") > first)).collect()
    left = []
    for i, x in enumerate(ranges):
        held = [(r["before"], r["n"], r["lo"], r["hi"]) for r in hit if r["id"] == i]
        left += _narrow(held, x.places, x.column, x.group, found)
    return left


def middle_values(df: DataFrame, values: Sequence[str], group: Sequence[str] = ()) -> dict[tuple, list]:
    """Per group: for each of ``values`` the lower and upper middle value, or None without any."""
    return order_values(df, values, [lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2)], group)


def medians(df: DataFrame, values: Sequence[str], group: Sequence[str] = ()) -> dict[tuple, list[float | None]]:
    """Per group the median of each of ``values``; even counts average the two middle values."""
    def mean(pair):
        if pair is None or pair[0] == pair[1]:
            return pair and pair[0]
        total = pair[0] + pair[1]
        return total / 2 if math.isfinite(total) else pair[0] / 2 + pair[1] / 2

    return {g: [mean(p) for p in pairs] for g, pairs in middle_values(df, values, group).items()}


def median_table(df: DataFrame, values: dict[str, str], group: Sequence[str] = ()) -> DataFrame:
    """``medians`` as a table: ``group`` and one column for each of ``values`` (column -> name). Groups without any value
    are absent; without ``group`` there is one row."""
    found = medians(df, list(values), group)
    schema = T.StructType([*(df.schema[g] for g in group), *(T.StructField(n, T.DoubleType()) for n in values.values())])
    rows = [(*g, *m) for g, m in found.items()] or ([] if group else [(None,) * len(values)])
    return df.sparkSession.createDataFrame(rows, schema)
