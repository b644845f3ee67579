"""Analysis tables over the ranked output: distributions, histograms, pivots,
samples and the statistics record. All are grouped aggregates (map-side
partial aggregation, one small shuffle) or top-k; none collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanrisk.functions.columns import dround
from spanrisk.operators.exposure import exact_median
from spanrisk.params import TIERS


def tier_domain(spark: SparkSession) -> DataFrame:
    """The four tiers with their display order (fixed, 4 rows)."""
    return spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "severity string, tier_order int")


def severity_distribution(out: DataFrame) -> DataFrame:
    """Counts in fixed tier order (missing tier -> 0) and percent of all rows."""
    counts = out.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    dom = tier_domain(out.sparkSession)
    j = dom.join(counts, "severity", "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # four rows
    return j.select("severity", "tier_order", F.col("n").cast("bigint").alias("n"),
                    (100.0 * F.col("n") / total).alias("pct"))


def tier_of(c: Column) -> Column:
    """Histogram colouring: lo <= mid < hi over 0, .25, .5, .75, 1.01."""
    return (F.when((c >= 0.0) & (c < 0.25), "Low").when((c >= 0.25) & (c < 0.5), "Medium")
            .when((c >= 0.5) & (c < 0.75), "High").when((c >= 0.75) & (c < 1.01), "Critical"))


def score_histogram(out: DataFrame, bins: int = 80, value: str = "risk_score") -> DataFrame:
    """Equal-width bins from min to max (last bin closed), bin midpoint -> tier."""
    rng = out.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rng = rng.select(F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                     F.when(F.col("_hi") == F.col("_lo"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    r = rng.first()  # one row: the range
    if r is None or r["_lo"] is None:
        return out.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, mid double, tier string, count bigint")
    lo, hi = float(r["_lo"]), float(r["_hi"])
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = out.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    dom = out.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = F.lit((hi - lo) / bins)
    j = dom.join(counts, "bin", "left").fillna(0, ["count"])
    blo = F.lit(lo) + F.col("bin") * width
    return j.select("bin", blo.alias("bin_lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_hi"),
                    (blo + width / 2).alias("mid"), tier_of(blo + width / 2).alias("tier"),
                    F.col("count").cast("bigint").alias("count"))


def condition_distribution(out: DataFrame) -> DataFrame:
    """Counts per rating for deck/superstructure/substructure plus a colour class."""
    parts = {"Deck": "deck_condition", "Superstructure": "superstr_condition", "Substructure": "substr_condition"}
    long = out.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), F.col(v).alias("rating")) for k, v in parts.items()])).alias("x")) \
        .select("x.part", "x.rating").filter(F.col("rating").isNotNull())
    g = long.groupBy("part", F.col("rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("count"))
    r = F.col("rating")
    cls = F.when(r <= 2, "critical").when(r <= 4, "poor").when(r <= 6, "fair").otherwise("good")
    return g.withColumn("colour_class", cls)


_PREFIX_DIGITS = 4


def exact_sample(df: DataFrame, n: int, seed: int, key=("state_code", "structure_number")) -> DataFrame:
    """Seeded sample of exactly ``n`` rows (all if fewer): the ``n`` smallest
    hashes of (key, seed), reproducible in any engine.

    A plain ``orderBy(hash).limit(n)`` sends every partition's local top-n to
    one merge task (n x partitions rows). Instead one aggregate counts rows by
    the hash's first ``_PREFIX_DIGITS`` hexadecimal digits (65,536 counts at
    most), whose running sum says up to which prefix the n smallest lie; only
    rows up to it, n and the rest of one prefix, are sorted. Two reads whatever
    n and the rows are.
    """
    h = F.md5(F.concat_ws("|", *[F.col(k) for k in key], F.lit(str(seed))))
    prefix = F.substring(h, 1, _PREFIX_DIGITS)
    counts = df.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p")))
    last = upto.filter(F.col("_upto") >= n).agg(F.min("_p")).first()[0]
    kept = df if last is None else df.filter(prefix <= last)
    return kept.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


def age_bin_means(df: DataFrame, width: int = 5) -> DataFrame:
    b = (F.floor(F.col("bridge_age") / width) * width).cast("int")
    return df.groupBy(b.alias("age_bin")).agg(F.avg("risk_score").alias("mean_risk")) \
        .withColumn("x", F.col("age_bin") + width / 2.0)


def decade_pivot(out: DataFrame, lo: int = 1880, hi: int = 2025) -> DataFrame:
    """Decade x tier counts with a fixed column order, missing -> 0."""
    d = out.filter(F.col("year_built").between(lo, hi)) \
        .withColumn("decade", (F.floor(F.col("year_built") / 10) * 10).cast("int"))
    p = d.groupBy("decade").pivot("severity", list(TIERS)).count().fillna(0)
    return p.select("decade", *[F.col(t).cast("bigint").alias(t) for t in TIERS])


def decade_stack(pivot: DataFrame) -> DataFrame:
    """Running base of each tier in the stacked bars (prefix sums across columns)."""
    cols, base = [], F.lit(0).cast("bigint")
    for t in TIERS:
        cols.append(base.alias(f"base_{t}"))
        base = base + F.col(t)
    return pivot.select("decade", *TIERS, *cols)


def state_at_risk_top(summary: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` states with the highest share of Critical and High records (a top-k over the state summary)."""
    risky = F.col("critical") + F.col("high")
    s = summary.select("STATE_CODE", "state_name", F.try_divide(100.0 * risky, "total_bridges").alias("pct_at_risk"),
                       F.try_divide(100.0 * F.col("poor_condition"), "total_bridges").alias("pct_poor"),
                       risky.alias("n_at_risk"))
    return s.orderBy(F.col("pct_at_risk").desc(), "STATE_CODE").limit(n)


def traffic_points(out: DataFrame, key=("state_code", "structure_number")) -> DataFrame:
    """Log traffic and score of every record with 1 to 500,000 crossings a day."""
    return out.filter(F.col("adt").between(1, 500000)).select(
        *key, F.log10("adt").alias("log10_adt"), "risk_score", "severity")


def stats_core(out: DataFrame) -> DataFrame:
    """One aggregate pass: totals, tiers, age, condition and traffic statistics."""
    n = F.count(F.lit(1))
    age = F.col("bridge_age")
    mc = F.least(*[F.col(c) for c in ("deck_condition", "superstr_condition", "substr_condition",
                                      "culvert_condition") if c in out.columns])
    aggs = [
        n.alias("total_bridges"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("with_geo"),
        F.try_divide(100.0 * F.count_if(F.col("bridge_condition_category") == "P"), n).alias("pct_poor_nbi"),
    ]
    for t in TIERS:
        aggs += [F.count_if(F.col("severity") == t).alias(f"n_{t.lower()}"),
                 F.try_divide(100.0 * F.count_if(F.col("severity") == t), n).alias(f"pct_{t.lower()}")]
    aggs += [
        F.avg(age).alias("mean_age"),
        F.try_divide(100.0 * F.count_if(age > 50), F.count(age)).alias("pct_over_50"),
        F.try_divide(100.0 * F.count_if(age > 75), F.count(age)).alias("pct_over_75"),
        F.min("year_built").cast("int").alias("oldest_bridge"),
        F.try_divide(100.0 * F.count_if(mc <= 4), F.count(mc)).alias("pct_min_cond_poor"),
        F.try_divide(100.0 * F.count_if(mc <= 3), F.count(mc)).alias("pct_min_cond_serious"),
        F.try_divide(100.0 * F.count_if(mc <= 2), F.count(mc)).alias("pct_min_cond_critical"),
        F.sum("adt").cast("bigint").alias("total_daily_crossings"),
        F.sum(F.when(F.col("severity").isin("Critical", "High"), F.col("adt"))).cast("bigint")
        .alias("daily_crossings_high_risk"),
    ]
    return out.agg(*aggs)


def median_age(out: DataFrame) -> DataFrame:
    return exact_median(out, "bridge_age", None, "median_age")


def riskiest_state(summary: DataFrame) -> DataFrame:
    """State with the highest mean score (ties: lowest code) — a top-1."""
    return summary.orderBy(F.col("avg_risk").desc(), F.col("STATE_CODE")).limit(1) \
        .select(F.col("state_name").alias("riskiest_state"), F.col("avg_risk").alias("riskiest_state_avg_risk"))


# FIXED VALUES — decimals of the published statistics record.
STAT_DIGITS: dict[str, int] = {
    "pct_poor_nbi": 2, "pct_critical": 2, "pct_high": 2, "pct_medium": 2, "pct_low": 2,
    "median_age": 1, "mean_age": 1, "pct_over_50": 1, "pct_over_75": 1,
    "pct_min_cond_poor": 2, "pct_min_cond_serious": 2, "pct_min_cond_critical": 2,
    "riskiest_state_avg_risk": 4,
}


def statistics_record(out: DataFrame, summary: DataFrame) -> DataFrame:
    """The one-row statistics record: one aggregate pass, with the exact median and the
    riskiest state (bounded scalars) beside it, rounded in Spark; null where nothing is counted."""
    med = median_age(out).first()["median_age"]
    top = riskiest_state(summary).first()
    name, score = tuple(top) if top is not None else (None, None)
    rec = stats_core(out).withColumns({
        "median_age": F.lit(med).cast("double"), "riskiest_state": F.lit(name).cast("string"),
        "riskiest_state_avg_risk": F.lit(score).cast("double")})
    return rec.select(*[dround(c, STAT_DIGITS[c]).alias(c) if c in STAT_DIGITS else c for c in rec.columns])
