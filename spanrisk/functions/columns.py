"""Pure ``Column -> Column`` helpers.

All helpers are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


# FIXED VALUES — ASCII whitespace removed by a strip (Spark's plain ``trim`` drops blanks only).
WHITESPACE = " \t\n\r\x0b\x0c"


def strip_ws(c: Column) -> Column:
    """Remove leading/trailing ASCII whitespace (a char-set trim, no regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def to_double(c: Column) -> Column:
    """Text to number; anything unparsable becomes NULL (ANSI-safe). The cast strips white space itself."""
    return c.try_cast("double")


def coded_to_double(c: Column) -> Column:
    """``to_double`` of a column where letters are codes of their own ('N', 'U'). One byte above the digits is no number and
    does not reach the parser, which tells of each such text by an exception at many times a number's cost."""
    return F.when((c < ":") | (F.octet_length(c) > 1), c.try_cast("double"))


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Null-safe clip: NULL stays NULL (``greatest``/``least`` would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def bounded(c: Column, lo: float, hi: float) -> Column:
    """Clip of a column that is never NULL: less generated code than ``clip``."""
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def bounded_or(c: Column, lo: float, hi: float, default: float) -> Column:
    """Clip, and ``default`` where the column is NULL."""
    return F.when(c.isNotNull(), bounded(c, lo, hi)).otherwise(F.lit(default))


def zpad(c: Column, width: int) -> Column:
    """Left-pad with zeros up to ``width`` like a text zero-fill: never cuts a
    longer value, and a leading sign stays in front of the zeros."""
    sign = F.substring(c, 1, 1)
    signed = F.concat(sign, F.lpad(F.substring(c, 2, 1 << 30), width - 1, "0"))
    return (F.when(F.length(c) >= width, c)
            .when(sign.isin("+", "-"), signed)
            .otherwise(F.lpad(c, width, "0")))


def map_lookup(c: Column, mapping: Mapping, default=None) -> Column:
    """Literal map lookup (missing key -> ``default``)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = F.try_element_at(m, c)
    return out if default is None else F.coalesce(out, F.lit(default))


def cond_to_risk(c: Column, fill: float = 5.0) -> Column:
    """0-9 condition rating to a [0, 1] risk with an extra penalty at or below 4."""
    v = F.coalesce(c, F.lit(float(fill)))
    base = F.lit(1.0) - v / F.lit(9.0)
    risk = F.when(v <= F.lit(4.0), base + F.lit(0.2) * (F.lit(1.0) - v / F.lit(4.0))).otherwise(base)
    return F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0))


def bool_to_int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def round_half_even(c: Column, digits: int) -> Column:
    """Half-to-even rounding of the decimal value (numpy-like), via an exact decimal."""
    return F.bround(c.cast("decimal(38,15)"), digits).cast("double")


def dround(c, digits: int = 6):
    """Presentation rounding: scale, round half away from zero, unscale.

    Rounding the scaled double (instead of its shortest decimal text) gives
    the same answer in every engine that rounds this way, so half-way cases
    cannot split results between Spark and the SQL oracle."""
    if isinstance(c, str):
        c = F.col(c)
    scale = float(10 ** digits)
    return F.round(c * scale, 0) / scale
