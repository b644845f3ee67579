"""Global ranking, tier counts, state names and the ranked output table.

Global rank without a single-task window
----------------------------------------
A window ``ORDER BY score`` with no partition pulls every row into one task.
Instead the table is range-partitioned on the full sort key (score desc plus
the structure key), sorted inside each partition, tagged with (partition,
position) and written once to the shared checkpoint folder, which cuts the
lineage and survives executor loss. Each row's rank is then the number of
rows in earlier partitions (a per-partition count: one number per partition)
plus its position inside its own partition. Because the range bounds are sampled on the
*composite* key, one score value holding a third of all rows is still split
over many partitions by the key. Ties are broken by (STATE_CODE,
STRUCTURE_NUMBER) so the rank is deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrisk.functions.columns import map_lookup, strip_ws, zpad
from spanrisk.params import STATE_CODES, TIERS
from spanrisk.session import STORED, scratch_path

RANK_ORDER_DEFAULT = ("RISK_SCORE", "STATE_CODE", "STRUCTURE_NUMBER")

_POS_BITS = 33


def rank_order(score: str = "RISK_SCORE", keys: tuple[str, ...] = ("STATE_CODE", "STRUCTURE_NUMBER")) -> list[Column]:
    return [F.col(score).desc_nulls_last()] + [F.col(k).asc_nulls_last() for k in keys]


def _sorted_stage(df: DataFrame, order: list[Column], n: int, path: str | None,
                  follow: dict[str, Column] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Range-partition + sort, tag each row with (partition, position), write once, read back. Columns that ``follow``
    from others are made after the move; those to ``drop`` only give the order.

    The tags are computed in the task that holds the sorted range, so they do
    not depend on how the written files are split when read again; a retried
    task recomputes the same range (deterministic input and total order)."""
    spark = df.sparkSession
    rid = F.monotonically_increasing_id()
    srt = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
           .withColumns({"_pid": F.spark_partition_id(), "_pos": rid.bitwiseAND((1 << _POS_BITS) - 1),
                         **(follow or {})}).drop(*drop))
    path = path or scratch_path(spark, "sorted")
    srt.write.mode("overwrite").option("compression", STORED).parquet(path)
    return spark.read.parquet(path)


def _offsets(totals: dict[int, int]) -> Column:
    """Running offsets by partition id, one number per partition: a single literal whatever the number."""
    offs, run = [], 0
    for pid in range(max(totals, default=-1) + 1):
        offs.append(run)
        run += totals.get(pid, 0) or 0
    return F.split(F.lit(",".join(str(int(o)) for o in (offs or [0]))), ",").cast("array<bigint>")


@dataclass
class RankedStage:
    """A table stored in rank order. ``stored`` has every row's partition and position in it, ``counts`` the rows of each
    partition; a rank is the rows of earlier partitions plus the position."""

    stored: DataFrame
    counts: dict[int, int]
    rank_col: str

    def table(self) -> DataFrame:
        """All rows with their rank."""
        off = F.element_at(_offsets(self.counts), F.col("_pid") + 1)
        return self.stored.withColumn(self.rank_col, off + F.col("_pos") + 1).drop("_pid", "_pos")

    def upto(self, n: int) -> DataFrame:
        """The rows of rank 1 to ``n``. The rank becomes a bound on the stored partition and position, which the scan's
        statistics prune, so only the first files are read."""
        left = n
        for pid in sorted(self.counts):
            if left <= self.counts[pid]:
                bound = (F.col("_pid") <= pid) & ((F.col("_pid") < pid) | (F.col("_pos") < left))
                return RankedStage(self.stored.filter(bound), self.counts, self.rank_col).table()
            left -= self.counts[pid]
        return self.table()


def rank_stage(df: DataFrame, order: list[Column] | None = None, rank_col: str = "SEVERITY_RANK",
               num_partitions: int | None = None, path: str | None = None,
               follow: dict[str, Column] | None = None, drop: tuple[str, ...] = ()) -> RankedStage:
    """Store ``df`` in ``order``, with what its ranks (1 to n) are made of. ``follow``: columns made from those of ``df``
    where they are stored, so that they are not shuffled. ``drop``: columns of ``order`` that are not stored."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = _sorted_stage(df, order or rank_order(), n, path, follow, drop)
    # one row per partition: bounded by the partition count, safe to bring back
    counts = {r["_pid"]: r["n"] for r in staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    return RankedStage(staged, counts, rank_col)


def global_rank(df: DataFrame, order: list[Column] | None = None, rank_col: str = "SEVERITY_RANK",
                num_partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Attach a 1-based position in ``order`` (a permutation of 1..n)."""
    return rank_stage(df, order, rank_col, num_partitions, path).table()


def state_name(code: Column) -> Column:
    """Trim, zero-pad to 2, look up; unknown -> 'Unknown' (fixed 56-entry literal map)."""
    return map_lookup(zpad(strip_ws(code), 2), STATE_CODES, "Unknown")


def severity_counts(df: DataFrame, tier_col: str = "SEVERITY") -> DataFrame:
    return df.groupBy(F.col(tier_col).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


# FIXED VALUES — ranked output columns: internal name -> published name.
OUTPUT_COLUMNS: dict[str, str] = {
    "STATE_CODE": "state_code",
    "STRUCTURE_NUMBER": "structure_number",
    "FACILITY_CARRIED": "facility_carried",
    "FEATURES_INTERSECTED": "features_intersected",
    "LOCATION": "location",
    "COUNTY_CODE": "county_code",
    "LAT": "lat",
    "LON": "lon",
    "YEAR_BUILT": "year_built",
    "BRIDGE_AGE": "bridge_age",
    "ADT": "adt",
    "PCT_TRUCK": "pct_truck",
    "DECK_COND": "deck_condition",
    "SUPERSTR_COND": "superstr_condition",
    "SUBSTR_COND": "substr_condition",
    "CULVERT_COND": "culvert_condition",
    "CHANNEL_COND": "channel_condition",
    "MIN_STRUCT_COND": "min_struct_condition",
    "BRIDGE_CONDITION": "bridge_condition_category",
    "STRUCT_EVAL": "structural_eval",
    "SCOUR_CRITICAL": "scour_critical",
    "BRIDGE_POSTING": "bridge_posting",
    "OPEN_CLOSED_POSTED": "open_closed_posted",
    "INSPECT_DATE": "last_inspection",
    "STRUCTURE_LEN": "structure_len_m",
    "MAX_SPAN_LEN": "max_span_len_m",
    "LANES_ON": "lanes_on",
    "SDI": "sdi_score",
    "ML_PROBA": "ml_risk_proba",
    "RISK_SCORE": "risk_score",
    "SEVERITY": "severity",
    "SEVERITY_RANK": "severity_rank",
    "STATE_NAME": "state_name",
}

# FIXED VALUES — columns of the map-ready subset.
MAP_COLUMNS: tuple[str, ...] = (
    "state_code", "state_name", "structure_number", "facility_carried",
    "features_intersected", "location", "county_code",
    "lat", "lon", "year_built", "bridge_age", "adt", "pct_truck",
    "min_struct_condition", "bridge_condition_category",
    "deck_condition", "superstr_condition", "substr_condition",
    "scour_critical", "bridge_posting", "open_closed_posted",
    "sdi_score", "ml_risk_proba", "risk_score", "severity", "severity_rank",
)


def format_output(df: DataFrame) -> DataFrame:
    """Choose, rename and keep the present output columns (+ state name, unless it is there already)."""
    if "STATE_NAME" not in df.columns:
        df = df.withColumn("STATE_NAME", state_name(F.col("STATE_CODE")))
    return df.select(*[F.col(k).alias(v) for k, v in OUTPUT_COLUMNS.items() if k in df.columns])


def top_by_rank(out: DataFrame, n: int, severity: str | None = None) -> DataFrame:
    """First ``n`` rows of the global order (optionally of one tier) as a filter.

    Tiers are prefixes of the score order, so the first ``n`` Critical rows are
    exactly the Critical rows with rank <= n: no top-k merge into one task."""
    cond = F.col("severity_rank") <= n
    if severity is not None:
        cond = cond & (F.col("severity") == severity)
    return out.filter(cond)


def top_critical(out: DataFrame, n: int = 1000) -> DataFrame:
    """First ``n`` Critical structures by rank."""
    return top_by_rank(out, n, "Critical")


def state_summary(df: DataFrame) -> DataFrame:
    """Per state: count, tier counts, mean score, poor count (NULL state dropped)."""
    sev = F.col("SEVERITY")
    agg = (df.filter(F.col("STATE_CODE").isNotNull()).groupBy("STATE_CODE").agg(
        F.count("RISK_SCORE").alias("total_bridges"),
        *[F.count_if(sev == t).alias(t.lower()) for t in TIERS],
        F.avg("RISK_SCORE").alias("avg_risk"),
        F.sum("IS_POOR").cast("bigint").alias("poor_condition"),
    ))
    return agg.withColumn("state_name", state_name(F.col("STATE_CODE")))


def state_ranking(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("avg_risk").desc(), F.col("STATE_CODE"))


def map_subset(out: DataFrame) -> DataFrame:
    cols = [c for c in MAP_COLUMNS if c in out.columns]
    return out.select(*cols).dropna(subset=["lat", "lon"])


def prefix_sums(df: DataFrame, order: list[Column], values: list[str], prefix: str = "cum_",
                num_partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Running sums of ``values`` in ``order`` (inclusive), without a single-task window.

    Same scheme as ``global_rank``: range partition on the order, a written
    sorted stage tagged with (partition, position), per-partition totals (one
    row per partition) turned into offsets, and a running sum inside each
    partition.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = _sorted_stage(df, order, n, path)
    tot = {r["_pid"]: r for r in staged.groupBy("_pid").agg(*[F.sum(v).alias(v) for v in values]).collect()}
    w = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {}
    for v in values:
        arr = _offsets({pid: (row[v] or 0) for pid, row in tot.items()})
        cols[prefix + v] = F.sum(v).over(w) + F.element_at(arr, F.col("_pid") + 1)
    return staged.withColumns(cols).drop("_pid", "_pos")
