"""Region (state) tables for choropleths: FIPS normalisation, shares,
region-name join, exclusions, scaling, hidden-risk counts, outside ranking.

Inputs are the per-state summary (one row per state) or the ranked output;
state-level tables are bounded by the number of states, so joining them with
the fixed region-name list is a small broadcast join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanrisk.functions.columns import map_lookup, strip_ws, zpad
from spanrisk.params import CONUS_SKIP, FIPS_TO_ABBR, OUTSIDE_POOR_RANKING, REGION_NAMES


def fips(code: Column) -> Column:
    return zpad(strip_ws(code.cast("string")), 2)


def region_percentages(summary: DataFrame) -> DataFrame:
    t = F.col("total_bridges")
    return summary.select(
        fips(F.col("STATE_CODE")).alias("fips"), "state_name",
        (100.0 * (F.col("critical") + F.col("high") + F.col("medium")) / t).alias("pct_medium_plus"),
        (100.0 * (F.col("critical") + F.col("high")) / t).alias("pct_high_plus"))


def region_names(spark: SparkSession, names=REGION_NAMES) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def region_join(pcts: DataFrame, regions: DataFrame) -> DataFrame:
    """Region name = state name; keep matches only, then drop non-contiguous codes."""
    j = F.broadcast(regions).join(pcts, regions["name"] == pcts["state_name"], "inner")
    return region_exclude(j)


def region_exclude(df: DataFrame, col: str = "fips") -> DataFrame:
    return df.filter(~F.col(col).isin(*CONUS_SKIP))


def abbreviation(f: Column) -> Column:
    return map_lookup(f, FIPS_TO_ABBR, "")


def metric_scale(df: DataFrame, value: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(v - lo) / (hi - lo + 1e-9) with fixed or observed lo/hi (one aggregate)."""
    if lo is None or hi is None:
        r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()  # two scalars
        lo = r["lo"] if lo is None else lo
        hi = r["hi"] if hi is None else hi
    return df.withColumn(f"{value}_scaled", (F.col(value) - F.lit(lo)) / (F.lit(hi) - F.lit(lo) + F.lit(1e-9)))


def hidden_risk(out: DataFrame) -> DataFrame:
    """High or Critical by score but rated Fair or Good."""
    return out.filter(F.col("severity").isin("High", "Critical")
                      & F.col("bridge_condition_category").isin("F", "G"))


def hidden_risk_by_state(out: DataFrame) -> DataFrame:
    """Per state: total, hidden-risk count (0 when none) and share of the inventory."""
    is_hidden = (F.col("severity").isin("High", "Critical")
                 & F.col("bridge_condition_category").isin("F", "G"))
    g = out.groupBy(fips(F.col("state_code")).alias("fips")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_hidden).alias("hidden_count"))
    return g.withColumn("hidden_pct", 100.0 * F.col("hidden_count") / F.col("total"))


def state_domain(out: DataFrame) -> DataFrame:
    return out.select(fips(F.col("state_code")).alias("fips"), "state_name").dropDuplicates()


def external_rank_compare(summary: DataFrame, outside=OUTSIDE_POOR_RANKING) -> DataFrame:
    """Our rank by share of poor structures vs an outside top-10 ranking."""
    pct = 100.0 * F.col("poor_condition") / F.col("total_bridges")
    w = Window.orderBy(pct.desc(), F.col("STATE_CODE"))  # one row per state
    ours = summary.select("state_name", pct.alias("pct_poor"), F.row_number().over(w).cast("bigint").alias("our_rank"))
    ext = summary.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(outside)],
                                               "state_name string, outside_rank int")
    j = F.broadcast(ext).join(ours, "state_name")
    return j.select("state_name", "outside_rank", "our_rank", "pct_poor",
                    (F.col("our_rank") - F.col("outside_rank")).alias("rank_shift"),
                    (F.col("our_rank") == F.col("outside_rank")).alias("exact_match"))
