"""Collapse probability, rush-hour occupancy and casualty exposure.

Everything is a Column expression over the ranked output table (lower-case
names); the aggregates use ordinary grouped aggregation. Exact medians come
from repeated histograms, so a tier holding most rows never has to sit in one
aggregation buffer, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.functions.columns import bounded, bounded_or, clip, dround, round_half_even
from spanrisk.operators.quantiles import median_table
from spanrisk.params import (
    DEFAULT_EXPOSURE, FATALITY_RATES, INJURY_RATES, WATER_WORDS, WATER_WORDS_STRICT, ExposureParams,
)


def water_crossing(c: Column) -> Column:
    """Upper-cased text contains any water word (substring match); NULL -> false."""
    return F.coalesce(F.upper(c).rlike("|".join(WATER_WORDS)), F.lit(False))


def water_crossing_strict(c: Column) -> Column:
    """Whole-word, case-insensitive variant (adds RUN)."""
    return F.coalesce(c.rlike("(?i)\\b(" + "|".join(WATER_WORDS_STRICT) + ")\\b"), F.lit(False))


def collapse_probability(score: Column, e: ExposureParams = DEFAULT_EXPOSURE) -> Column:
    return F.lit(e.base_rate) * F.exp(F.lit(e.k_exponent) * clip(score, 0.0, 1.0))


def span_category(span: Column, e: ExposureParams = DEFAULT_EXPOSURE) -> Column:
    """[0,20) short, [20,50) medium, [50,9999) long; NULL span counts as 20; else NULL."""
    s = F.coalesce(span, F.lit(e.default_span_m))
    return (F.when((s >= 0) & (s < 20), "short").when((s >= 20) & (s < 50), "medium")
            .when((s >= 50) & (s < 9999), "long"))


def _rate(table: dict, water: Column, span_cat: Column) -> Column:
    out = None
    for (w, cat), v in table.items():
        cond = (water == F.lit(w)) & (span_cat == cat)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(0.0))


def base_fatality_rate(water: Column, span_cat: Column) -> Column:
    return _rate(FATALITY_RATES, water, span_cat)


def base_injury_rate(water: Column, span_cat: Column) -> Column:
    return _rate(INJURY_RATES, water, span_cat)


def truck_fraction(pct: Column, e: ExposureParams = DEFAULT_EXPOSURE) -> Column:
    """Truck share for exposure: NULL counts as 10% (features use 0)."""
    return bounded_or(pct, 0.0, 100.0, e.default_truck_pct) / 100.0


def truck_adjusted_fatality(base_fat: Column, t: Column, e: ExposureParams = DEFAULT_EXPOSURE) -> Column:
    return base_fat * (1.0 - t) + bounded(base_fat + e.truck_fatality_premium, 0.0, 1.0) * t


def crossing_hours(df: DataFrame, e: ExposureParams = DEFAULT_EXPOSURE) -> Column:
    """Hours that a vehicle is on the span: its length at the posted or the free speed."""
    restricted = F.coalesce("bridge_posting", F.lit(e.default_posting)) <= e.posted_max_code
    slow, fast = (F.lit(kmh * 1000.0 / 3600.0) for kmh in (e.speed_posted_kmh, e.speed_free_kmh))
    metres = bounded(F.coalesce("structure_len_m", F.lit(e.default_len_m)), e.min_len_m, e.max_len_m)
    return metres / F.when(restricted, slow).otherwise(fast) / 3600.0


def rush_hour_occupancy(df: DataFrame, e: ExposureParams = DEFAULT_EXPOSURE) -> Column:
    """Persons on the span at rush hour: vehicles an hour, times hours on the span, times persons a vehicle."""
    trucks = truck_fraction(F.col("pct_truck"), e)
    per_hour = F.greatest(F.coalesce("adt", F.lit(0.0)), F.lit(0.0)) * e.peak_fraction
    return F.greatest(per_hour * crossing_hours(df, e) * ((1.0 - trucks) * e.occ_car + trucks * e.occ_truck), F.lit(0.0))


def exposure(out: DataFrame, e: ExposureParams = DEFAULT_EXPOSURE) -> DataFrame:
    """Ranked output -> + probability, occupancy, water flag, rates and expected casualties."""
    has_feat = "features_intersected" in out.columns
    water = water_crossing(F.col("features_intersected")) if has_feat else F.lit(False)
    span = F.col("max_span_len_m") if "max_span_len_m" in out.columns else F.lit(None).cast("double")
    df = out.select("*",
                    collapse_probability(F.col("risk_score"), e).alias("p_collapse_1yr"),
                    rush_hour_occupancy(out, e).alias("rush_hour_persons"),
                    water.alias("is_water_crossing"),
                    span_category(span, e).alias("_span"),
                    truck_fraction(F.col("pct_truck"), e).alias("_t"))
    fat0 = base_fatality_rate(F.col("is_water_crossing"), F.col("_span"))
    inj0 = base_injury_rate(F.col("is_water_crossing"), F.col("_span"))
    df = df.withColumn("_fat", truck_adjusted_fatality(fat0, F.col("_t"), e)).withColumn("_inj0", inj0)
    df = df.withColumn("_inj", F.least(F.col("_inj0"), 1.0 - F.col("_fat")))
    df = df.select(
        "*",
        round_half_even(F.col("_fat"), 3).alias("fatality_rate"),
        round_half_even(F.col("_inj"), 3).alias("injury_rate"),
        round_half_even(F.greatest(1.0 - F.col("_fat") - F.col("_inj"), F.lit(0.0)), 3).alias("unharmed_rate"),
    )
    pp = F.col("p_collapse_1yr") * F.col("rush_hour_persons")
    return df.select(
        "*",
        round_half_even(pp * F.col("fatality_rate"), 5).alias("expected_fatalities"),
        round_half_even(pp * F.col("injury_rate"), 5).alias("expected_injuries"),
        round_half_even(pp, 5).alias("expected_affected"),
    ).drop("_span", "_t", "_fat", "_inj0", "_inj")


def exact_median(df: DataFrame, value: str, group: list[str] | None = None, out: str = "median") -> DataFrame:
    """Exact median (even counts average the two middle values) per group."""
    return median_table(df, {value: out}, group or [])


def tier_histogram(df: DataFrame, value: str, tier: str, bins: int) -> DataFrame:
    """Per tier: ``bins`` equal bins over the tier's own min..max, count and density. Each tier's bounds (one row
    per tier) become literals, so rows are counted by (tier, bin) without a join or a shuffle of rows."""
    bounds = df.groupBy(tier).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
                                  F.count(value).alias("n")).filter("n > 0").collect()
    bounds = [(r[tier], r["lo"] - 0.5 * (r["lo"] == r["hi"]), r["hi"] + 0.5 * (r["lo"] == r["hi"]), r["n"])
              for r in bounds]
    schema = T.StructType([df.schema[tier], *(T.StructField(n, T.DoubleType()) for n in ("_lo", "_hi")),
                           T.StructField("_n", T.LongType())])
    edges = df.sparkSession.createDataFrame(bounds, schema)
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, a, b, _ in bounds:
        lo, hi = (F.when(F.col(tier).eqNullSafe(name), x).otherwise(y) for x, y in ((a, lo), (b, hi)))
    place = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(tier, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    done = every.join(counts, [tier, "bin"], "left").fillna(0, ["count"])
    return done.select(
        tier, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"), F.col("count").cast("bigint").alias("count"),
        (F.col("count") / (F.col("_n") * width)).alias("density"))


def log_label(p: Column) -> Column:
    return F.log10(F.greatest(p, F.lit(1e-7)))


def water_class(sev: Column, water: Column) -> Column:
    return F.concat(sev, F.lit("/"), F.when(water, "water").otherwise("land"))


def exact_total(c: str, digits: int, factor: str | None = None) -> Column:
    """Exact sum of 5-decimal values (DECIMAL: independent of summation order),
    optionally scaled, rounded half-up, back to DOUBLE."""
    total = F.sum(F.col(c).cast("decimal(38,5)"))
    if factor is not None:
        total = total * F.lit(factor).cast("decimal(4,2)")
    return F.round(total, digits).cast("double")


def exposure_totals(ex: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return ex.agg(
        dround(F.sum("p_collapse_1yr"), 2).alias("total_expected_annual_collapses"),
        exact_total("expected_affected", 3).alias("total_expected_annual_affected"),
        exact_total("expected_fatalities", 3).alias("total_expected_annual_fatalities"),
        exact_total("expected_injuries", 3).alias("total_expected_annual_injuries"),
        F.count_if("is_water_crossing").alias("water_crossings_total"),
        dround(F.try_divide(100.0 * F.count_if("is_water_crossing"), n), 1).alias("water_crossings_pct"),
        exact_total("expected_fatalities", 3, "0.25").alias("fatalities_any_time_of_day"),
        exact_total("expected_injuries", 3, "0.25").alias("injuries_any_time_of_day"))


def calibration(totals: DataFrame, e: ExposureParams = DEFAULT_EXPOSURE) -> DataFrame:
    """The totals behind the two yearly rates of collapse that they were calibrated with: at score 0 and at score 1."""
    return totals.select(F.lit(e.base_rate).alias("base_collapse_rate_per_bridge"),
                         F.lit(e.rate_at_one).alias("p_collapse_risk1_bridge"), "*")


def exposure_by_tier(ex: DataFrame) -> DataFrame:
    middle = median_table(ex, {"p_collapse_1yr": "median_p_collapse", "rush_hour_persons": "median_rush_persons"},
                          ["severity"])
    sums = ex.groupBy("severity").agg(exact_total("expected_fatalities", 4).alias("total_exp_fatalities"),
                                      exact_total("expected_injuries", 4).alias("total_exp_injuries"))
    # every side has one row per tier
    return sums.join(middle, "severity", "left").select(
        "severity", dround("median_p_collapse", 12).alias("median_p_collapse"),
        dround("median_rush_persons", 1).alias("median_rush_persons"), "total_exp_fatalities", "total_exp_injuries")


TOP_RECORD_COLS = ("facility_carried", "state_name", "adt", "rush_hour_persons", "is_water_crossing",
                   "fatality_rate", "injury_rate", "p_collapse_1yr", "expected_fatalities",
                   "expected_injuries", "expected_affected", "severity")


def top_records_nested(ex: DataFrame, n: int = 5) -> DataFrame:
    """One row holding the top ``n`` records by expected fatalities as a list of structs."""
    top = ex.orderBy(F.col("expected_fatalities").desc(), "state_code", "structure_number").limit(n)
    return top.agg(F.collect_list(F.struct(*TOP_RECORD_COLS)).alias("top_by_fatalities"))


def tier_odds(ex: DataFrame) -> DataFrame:
    """Odds of collapse per tier: the most likely, the median and the least likely record."""
    from spanrisk.operators.maplayer import odds_label

    ends = ex.groupBy("severity").agg(F.max("p_collapse_1yr").alias("hi"), F.min("p_collapse_1yr").alias("lo"))
    mid = exact_median(ex, "p_collapse_1yr", ["severity"], "mid")
    return ends.join(mid, "severity", "left").select("severity", *[odds_label(F.col(c)).alias(n) for c, n in (
        ("hi", "odds_most_likely"), ("mid", "odds_median"), ("lo", "odds_least_likely"))])
