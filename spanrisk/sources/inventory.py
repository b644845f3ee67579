"""Raw inventory derived from the benchmark tables.

The test data has no structure inventory of its own, so a raw delimited-style
inventory (every column STRING, raw item names) is derived from ``lineitem``
joined with ``supplier``: one structure per line item. The rules are fixed
(see FIXTURES.md §B) so that the same rows can be rebuilt in plain SQL by the
oracle. The derivation is a single projection over a join, so it scales with
``lineitem`` and Catalyst prunes every column a query does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrisk.stages import staged_table

def _s(c: Column) -> Column:
    return c.cast("string")


def _pad(c: Column, width: int) -> Column:
    return F.lpad(_s(c), width, "0")


def _floor_int(c: Column) -> Column:
    return F.floor(c).cast("int")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """Hash-spread a scan on ``key``, so that one large row group, which is read by one task, does not keep every
    step after it in that task. The next step joins on another key, so this costs one shuffle of narrow rows."""
    return df.repartition(*[F.col(k) for k in key])


def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw inventory with the item-numbered column names of the delimited file."""
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_shipdate"), ["l_orderkey", "l_linenumber"])
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # supplier grows with the data (it is not a fixed dimension), so no broadcast
    # hint: AQE/size statistics decide the join strategy.
    b = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_nationkey",
        _floor_int(F.col("l_quantity")).alias("q"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("px"),
        (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")).alias("k"),
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber") * 5) % 125)
        .cast("int").alias("age"),
        F.month("l_shipdate").cast("int").alias("mm"),
    )
    k, age = F.col("k"), F.col("age")

    def grade(div: int, mult: int) -> Column:
        return F.greatest(F.lit(0), F.least(
            F.lit(9),
            F.lit(9) - _floor_int(age / div) + ((k * mult) % 5).cast("int") - 2))

    c = b.select("*", grade(20, 13).alias("d0"), grade(20, 17).alias("d1"), grade(18, 19).alias("d2"))
    d0, d1, d2, mm, q = F.col("d0"), F.col("d1"), F.col("d2"), F.col("mm"), F.col("q")

    features = (F.when(k % 8 == 0, "MILL CREEK").when(k % 8 == 1, "STATE ROUTE 9")
                .when(k % 8 == 2, "Big Sandy River").when(k % 8 == 3, "SEATTLE AVE")
                .when(k % 8 == 4, "RAILROAD").when(k % 8 == 5, "WILLOW RUN")
                .when(k % 8 == 6, "SHIP CANAL"))
    lat_deg = F.when(k % 200 == 7, F.lit(5)).otherwise(25 + k % 24)
    design = (F.when(k % 14 == 13, F.lit(None).cast("string"))
              .when(k % 14 < 10, _s(k % 14))
              .when(k % 14 == 10, "A").when(k % 14 == 11, "B").otherwise("Z"))
    inspect = (F.when(k % 53 == 0, F.lit(None).cast("string"))
               .when((mm < 10) & (k % 3 == 0), F.concat(_s(mm), _s(16 + k % 9)))
               .otherwise(F.concat(_pad(mm, 2), _s(16 + k % 9))))
    low3 = F.least(d0, d1, d2)
    null_s = F.lit(None).cast("string")

    return c.select(
        _pad(F.col("s_nationkey") + 16, 2).alias("STATE_CODE_001"),
        F.concat_ws("-", _s(F.col("l_orderkey")), _s(F.col("l_linenumber")),
                    _s(F.col("l_partkey")), _s(F.col("l_suppkey"))).alias("STRUCTURE_NUMBER_008"),
        F.when(k % 50 == 0, "2").otherwise("1").alias("RECORD_TYPE_005A"),
        _pad(k % 200, 3).alias("COUNTY_CODE_003"),
        features.alias("FEATURES_DESC_006A"),
        F.concat(F.lit("ROUTE "), _s(F.col("l_suppkey"))).alias("FACILITY_CARRIED_007"),
        F.concat(_pad(lat_deg, 2), _pad(k % 60, 2), _pad((k * 31) % 6000, 4)).alias("LAT_016"),
        F.concat(_pad(70 + k % 50, 3), _pad((k * 3) % 60, 2), _pad((k * 29) % 6000, 4)).alias("LONG_017"),
        F.when(k % 97 == 0, null_s).when(k % 499 == 0, "1700").when(k % 503 == 0, "2025")
        .otherwise(_s(2024 - age)).alias("YEAR_BUILT_027"),
        _s(1 + k % 6).alias("TRAFFIC_LANES_ON_028A"),
        F.when(k % 89 == 0, null_s).when(k % 401 == 0, "250000").otherwise(_s(F.col("px")))
        .alias("ADT_029"),
        design.alias("DESIGN_LOAD_031"),
        F.when(k % 20 == 0, "K").when(k % 20 == 1, "P").when(k % 20 == 2, null_s).otherwise("A")
        .alias("OPEN_CLOSED_POSTED_041"),
        F.when(k % 31 == 0, null_s).otherwise(_s(q * 3)).alias("MAX_SPAN_LEN_MT_048"),
        F.when(k % 37 == 0, null_s).otherwise(_s(q * 11)).alias("STRUCTURE_LEN_MT_049"),
        F.when(k % 5 == 0, "N").otherwise(_s(d0)).alias("DECK_COND_058"),
        F.when(k % 5 == 0, "N").otherwise(_s(d1)).alias("SUPERSTRUCTURE_COND_059"),
        F.when((k % 5 == 0) | (k % 41 == 0), "N").otherwise(_s(d2)).alias("SUBSTRUCTURE_COND_060"),
        F.when(k % 6 == 0, "N").otherwise(_s((k * 23) % 10)).alias("CHANNEL_COND_061"),
        F.when((k % 5 == 0) | (k % 101 == 0), _s(d1)).otherwise("N").alias("CULVERT_COND_062"),
        F.when(k % 43 == 0, "N").otherwise(_s(F.least(d1, d2))).alias("STRUCTURAL_EVAL_067"),
        F.when(k % 47 == 0, null_s).when(d2 <= 3, _s(k % 5)).otherwise("5").alias("POSTING_EVAL_070"),
        F.when(k % 6 == 0, "N").otherwise(_s((k * 29) % 10)).alias("WATERWAY_EVAL_071"),
        inspect.alias("DATE_OF_INSPECT_090"),
        F.when(k % 17 == 0, "Y24").when(k % 19 == 0, null_s).otherwise("N").alias("FRACTURE_092A"),
        F.when(k % 13 == 0, null_s).otherwise(_s(k % 40)).alias("PERCENT_ADT_TRUCK_109"),
        F.when(k % 11 == 0, "U").otherwise(_s((k * 7) % 10)).alias("SCOUR_CRITICAL_113"),
        F.when(k % 211 == 0, null_s).when(low3 <= 4, "P").when(low3 <= 6, "f ").otherwise("G")
        .alias("BRIDGE_CONDITION"),
    )


def inventory_inputs(sf_dir: str) -> list[str]:
    """The files that the inventory is derived from."""
    return [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "supplier")]


def staged_raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived raw inventory written once per session as a parquet stage.

    It plays the part of the raw inventory *file*: later stages read plain
    columns instead of re-deriving them (which would inline the long derivation
    into every pushed-down filter). The stage lives under the cluster's
    checkpoint directory, so it survives executor loss.
    """
    return staged_table(spark, "raw_inventory", inventory_inputs(sf_dir), lambda: raw_inventory(spark, sf_dir))
