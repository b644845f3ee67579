"""Delimited inventory reader.

Semantics follow the published pipeline's reader: comma separated, ``'`` as
text qualifier (``''`` inside a quoted field is a literal quote), a header
row, every field read as text, rows with *too many* fields dropped, rows with
too few fields kept with NULL tails, and a fixed list of missing-value tokens.

Rows are read as lines and cut here, not by the CSV source: that source either
prunes columns or shows over-long rows, and reads a field that runs over a line
break only if files are not split. A line without qualifiers is split at the
separator, any other by a pattern for a field; a column that nothing reads is
never made, and a row's number of fields is known whatever is read.

Lines inside a quoted field are found by the parity of qualifiers before them.
Odd lines are counted by block (a split of a file), running sums over blocks
say which blocks begin inside a field, and only blocks that hold an odd line or
begin inside a field are ordered by line; there the lines of one record are
joined. All other blocks are read without a shuffle, and files stay splittable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.params import NULL_TOKENS, RENAME_MAP
from spanrisk.session import scratch_path


def read_header(spark: SparkSession, path: str, quote: str = "'") -> list[str]:
    """Column names from the header line (one small read of the first line)."""
    return (spark.read.option("header", True).option("quote", quote).option("escape", quote)
            .csv(path).columns)


def _odd(c: Column, quote: str) -> Column:
    """Whether a line holds an odd number of qualifiers."""
    return (F.length(c) - F.length(F.replace(c, F.lit(quote), F.lit("")))) % 2 == 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, line): the lines of all files; ``line`` ascends within a block."""
    at = F.col("_metadata")
    return spark.read.text(path).select(
        "value", at["file_path"].alias("file"), at["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("line"))


def _open_blocks(lines: DataFrame, quote: str) -> DataFrame:
    """(file, block, open) of the blocks that hold an odd line or begin inside a field; one row per split at most."""
    odd = lines.groupBy("file", "block").agg(F.count_if(_odd(F.col("value"), quote)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = odd.withColumn("open", F.coalesce(F.sum("n").over(before) % 2, F.lit(0)))
    return blocks.filter("n > 0 OR open = 1").select("file", "block", "open")


def _stitched(lines: DataFrame, blocks: DataFrame, quote: str) -> tuple[DataFrame, DataFrame]:
    """Records of the ``blocks``' lines as (value, file, block), and the lines of fields that never end."""
    spark = lines.sparkSession
    within = Window.partitionBy("file", "block").orderBy("line")
    odd = _odd(F.col("value"), quote)
    part = lines.join(blocks, ["file", "block"]).withColumn("odd", odd)
    before = F.col("open") + F.coalesce(F.sum(F.col("odd").cast("bigint")).over(
        within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("starts", before % 2 == 0)
    part = part.withColumn("own", F.last(F.when(F.col("starts"), F.col("line")), ignorenulls=True).over(
        within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # line numbers hold for one reading: they are stored before they are compared
    path = scratch_path(spark, "quoted-lines")
    part.drop("open").write.parquet(path)
    part = spark.read.parquet(path)
    # where the record that a block begins inside of has begun, and where a file's last field opens, if it never ends
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = part.groupBy("file", "block").agg(F.max("own").alias("own"))
    begun = F.last(F.when(F.col("own").isNotNull(), F.struct(F.col("block").alias("b"), F.col("own").alias("l"))),
                   ignorenulls=True)
    last = last.select("file", "block", begun.over(earlier).alias("from"))
    place = F.struct(F.col("block").alias("b"), F.col("line").alias("l"))
    unended = part.filter("odd").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("stop"))
    unended = unended.filter("n % 2 = 1").select("file", "stop")
    part = part.join(last, ["file", "block"]).join(unended, "file", "left").withColumn(
        "lost", F.coalesce(place >= F.col("stop"), F.lit(False)))
    single = F.col("starts") & ~F.col("odd")
    kept = part.filter("NOT lost")
    first = F.when(F.col("own").isNotNull(), F.struct(F.col("block").alias("b"), F.col("own").alias("l"))).otherwise(
        F.col("from"))
    pieces = kept.filter(~single).groupBy("file", first.alias("first")).agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("p"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"), "file",
                           F.col("first.b").alias("block"))
    return kept.filter(single).select("value", "file", "block").unionByName(joined), part.filter("lost")


def _records(spark: SparkSession, path: str, quote: str) -> tuple[DataFrame, DataFrame | None]:
    """(value, file, block) of every record, and the lines of fields that never end, if any file has odd lines."""
    lines, filled = _lines(spark, path), F.length("value") > 0  # a blank line outside a field is no record
    stored = scratch_path(spark, "quoted-blocks")
    _open_blocks(lines, quote).write.parquet(stored)
    blocks = spark.read.parquet(stored)
    if blocks.isEmpty():
        return lines.drop("line").filter(filled), None
    records, lost = _stitched(lines, blocks, quote)
    whole = lines.join(blocks, ["file", "block"], "left_anti").select("value", "file", "block")
    return whole.unionByName(records).filter(filled), lost


def _fields(value: Column, quote: str) -> Column:
    """The fields of a record as written, with their qualifiers."""
    field = f"(?s)(?:^|,)({quote}[^{quote}]*(?:{quote}{quote}[^{quote}]*)*{quote}[^,]*|[^,]*)"
    return F.when(F.contains(value, F.lit(quote)), F.regexp_extract_all(value, F.lit(field), F.lit(1))).otherwise(
        F.split(value, ",", -1))


def _unquoted(field: Column, quote: str) -> Column:
    """A field's text: without qualifiers around it, doubled ones inside single; empty is NULL."""
    inner = F.replace(F.regexp_replace(field, f"(?s)^{quote}(.*){quote}", "$1"), F.lit(quote * 2), F.lit(quote))
    text = F.when(F.startswith(field, F.lit(quote)), inner).otherwise(field)
    return F.when(text != "", text)


def _rows(spark: SparkSession, path: str, quote: str, header: list[str] | None):
    names = header or read_header(spark, path, quote)
    records, lost = _records(spark, path, quote)
    cut = records.withColumn("f", _fields(F.col("value"), quote))
    # a file's first line, if it is the header; a record without one of the names is not cut to see that
    probe = max((n for n in names if quote not in n), key=len, default="")
    has_name = F.contains(F.replace(F.col("value"), F.lit(quote), F.lit("")), F.lit(probe))
    title = F.transform(F.slice("f", 1, len(names)), lambda x: F.coalesce(_unquoted(x, quote), F.lit("")))
    is_title = (F.col("block") == 0) & has_name & (F.array_join(title, "\n") == "\n".join(names))
    return names, cut.filter(~is_title), lost


def scan_delimited(spark: SparkSession, path: str, quote: str = "'", header: list[str] | None = None) -> DataFrame:
    """Read a delimited inventory: all STRING, over-long rows dropped, short rows kept, fields with line breaks whole
    (any line break in them becomes a line feed)."""
    names, cut, _ = _rows(spark, path, quote, header)
    kept = cut.filter(F.size("f") <= len(names))
    return kept.select(*[_unquoted(F.get("f", F.lit(i)), quote).alias(n) for i, n in enumerate(names)])


def rejected_rows(spark: SparkSession, path: str, quote: str = "'", header: list[str] | None = None) -> DataFrame:
    """One row: records that ``scan_delimited`` drops as over-long, and lines of quoted fields that never end."""
    names, cut, lost = _rows(spark, path, quote, header)
    n_lost = lost.count() if lost is not None else 0
    return cut.agg(F.count_if(F.size("f") > len(names)).alias("over_long"),
                   F.lit(n_lost).cast("bigint").alias("unended_lines"))


def normalise_nulls(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Missing-value tokens in text columns become NULL."""
    toks = list(tokens)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(toks), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def rename_columns(df: DataFrame, mapping: dict[str, str] = RENAME_MAP) -> DataFrame:
    """Strip header names and map item names to friendly names; keep the rest."""
    out = []
    for n in df.columns:
        s = n.strip()
        out.append(F.col(f"`{n}`").alias(mapping.get(s, s)))
    return df.select(*out)


def scan_csv_pruned(spark: SparkSession, path: str, columns: list[str],
                    schema: T.StructType) -> DataFrame:
    """Read back chosen columns of a CSV sink with an explicit schema (never inferred)."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*columns)
