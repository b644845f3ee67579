"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key: -ln(u) over its quality weight, with u drawn from a hash of its id. Within a
source, documents in ascending key order are a weighted random order without replacement. A source's token budget is
filled with complete epochs first; what remains is a prefix of that order whose running size fits the rest.

Running sizes need no task that sees a whole source: the key's quantile cuts each source into ``buckets`` ranges, whose
sums give each range its offset, and a window runs inside one range only. The one join is on (source, range), so a
source that holds a third of all rows is spread over as many keys as there are ranges.

Defined results: null text has size 0; a null source is a source of its own, last; null ids share one key and are
ordered by size; repeated rows each count; sources of size 0 get target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrisk.llm.common import staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = "mix-7"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on ``key`` alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with ``target``: all sizes shared by weight, no source above ``cap`` times its size.

    Sharing the excess anew until none is above has one fixed point: min(cap * size, level * weight), the level at
    which the targets add up to the total. Sources in order of cap over weight reach their cap one by one, so the
    level follows from running sums. One row per source: the windows run over the table of sources only."""
    at = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     F.pmod(F.row_number().over(at) - 1, F.lit(len(weights))) + 1)
    t = totals.withColumn("w", w).withColumn("cap", cap * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", rest.cast("double") / F.sum("w").over(after))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"),
                         F.struct((F.col("cap") / F.col("w")).alias("c"), "level"))).over(everywhere)["level"]
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def mix(docs: DataFrame, size: Column, quality: Column | None = None, key: str = "doc_id", source: str = "source",
        weights: Sequence[int] = WEIGHTS, cap: int = MAX_EPOCHS, buckets: int = BUCKETS, seed: str = SEED,
        carry: Sequence[str] = ()) -> DataFrame:
    """``docs``' key and source with size, source_size, target, epochs (how often the mix takes the document) and
    taken (epochs times size). ``quality``: a positive weight, 1 where null; default 1 everywhere. ``carry``: other
    columns to keep, which are moved once and not staged; ``docs`` is then read twice."""
    weight = F.coalesce(quality.cast("double"), F.lit(1.0)) if quality is not None else F.lit(1.0)
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.cast("bigint").alias("size"),
                       (-F.log(uniform(F.col(key), seed)) / weight).alias("order"),
                       F.struct(*[F.col(c) for c in carry]).alias("carried"))
    # a name for every source, the null one included, that joins need no null-safe comparison for
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = rows.withColumn("range", F.floor((1 - F.exp(-F.col("order"))) * buckets))
    if not carry:
        rows, _ = staged(rows.drop("carried"), "mix-sizes")
    ranges = rows.groupBy("s", "range").agg(F.sum("size").alias("held"), F.first("source").alias("source"))
    totals = ranges.groupBy("s").agg(F.sum("held").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(totals.select("source", "source_size"), weights, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), "source_size", "target")
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    earlier = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("s", "range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    ties = ["size", "carried"] if carry else ["size"]
    within = Window.partitionBy("s", "range").orderBy(
        "order", F.col("key").asc_nulls_last(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    done = (rows.join(offsets.join(targets, "s"), ["s", "range"])
            .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))))
    # the document on the border comes in if at least half of it fits
    drawn = (F.col("budget") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("budget"))
    epochs = (F.col("epochs") + F.when(drawn, 1).otherwise(0)).cast("bigint")
    return done.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
                       epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"),
                       *[F.col("carried")[c].alias(c) for c in carry])


def repeat(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``mixed``, each row as often as the mix takes it."""
    times = F.explode(F.sequence(F.lit(1), F.col("epochs")))
    return mixed.filter("epochs > 0").select(*columns, times.alias("__time")).drop("__time")


def quality_weights(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, weight): 2 for documents labelled good, a half for those labelled bad; good wins over bad."""
    good = F.max(F.when(F.col("quality") > 0, 1).when(F.col("quality").isNotNull(), 0))
    return (labels.filter(F.col(key).isNotNull()).groupBy(key).agg(good.alias("good"))
            .select(key, F.when(F.col("good") == 1, 2.0).when(F.col("good") == 0, 0.5).alias("weight")))
