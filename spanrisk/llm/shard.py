"""Balanced label propagation into shards, in DataFrame functions only.

Linked documents (equal texts) should share a shard, and all shards hold the same number of rows, give or take one.
A document starts in a shard given by a hash: of its group if that fits a shard, else of its key. Groups that fit move
whole: in each round the groups above a shard's quota, the smallest ones in it, ask another shard with room for them, and
are let in up to its room, larger ones first, until none is above or no move is let in. Then a round counts each group's
documents by shard; those outside the group's most common shard (of those with room for the group, if any) ask to move
there, and as many are let in as the shard's quota has room for, larger parties first. The unit that moves is a cell, the documents of one group in one shard, so a group of any size is at most as
many rows as there are shards. Unlinked documents fill what room is left. Places are numbered by ranges of a hash,
whose counts give each range its offset, so no task numbers a whole group or shard.

Defined results: null text has no bytes and groups with empty texts; null keys are rows like others; repeated rows
are linked rows of one group; fewer rows than shards leave some shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrisk.llm.common import release, staged

SHARDS = 40
ROUNDS = 3
SETTLE_ROUNDS = 16  # of whole groups; they end earlier once no move is let in
RANGES = 1024
OVERHEAD = 16  # bytes that every row adds to its text


def text_columns(text: Column) -> dict[str, Column]:
    """size, text_crc32 and group of a text."""
    held = F.coalesce(text, F.lit("")).cast("binary")
    return {"size": (F.octet_length(held) + OVERHEAD).cast("bigint"), "text_crc32": F.crc32(held),
            "group": F.unhex(F.md5(held))}


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, ranges: int = RANGES,
             more: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``df`` (staged: it is read twice) with ``name``, the row's place from 0 among those with equal ``by``. Rows go by
    a hash of ``order``; ``more`` has columns for each ``by``, joined with the offsets, which spreads a hot key. With
    ``how`` left, rows whose ``by`` is not in ``more`` stay, with nulls."""
    slot = F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("int")
    df = df.withColumn("range", slot)
    counts = df.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_range"))
    if more is not None:
        offsets = offsets.join(more, by)
    at = F.row_number().over(Window.partitionBy(*by, "range").orderBy(*order))
    return (df.join(offsets, [*by, "range"], how).withColumn(name, F.col("before_range") + at - 1)
            .drop("range", "before_range"))


def _first_above(place: Column, ends: list[int]) -> Column:
    """Index of the first of ascending ``ends`` that is above ``place``."""
    return F.array_position(F.transform(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e > place), True) - 1


def settle(cells: DataFrame, quota: Column, shards: int, rounds: int) -> tuple[DataFrame, str]:
    """(group, shard, n) after whole cells have moved from shards above their quota to shards with room for them, and its
    folder. Rooms are one number per shard; cells are numbered within (shard, size class, range of a hash)."""
    spark = cells.sparkSession
    cells, path = staged(cells, "cells")
    for turn in range(rounds):
        placed = numbered_sums(cells).withColumn("above", F.col("ahead") + F.col("n") > quota)
        stays = placed.filter("NOT above").groupBy("shard").agg(F.sum("n").alias("load"))
        room = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(stays, "shard", "left").select(
            "shard", (quota - F.coalesce("load", F.lit(0))).cast("bigint").alias("room"))
        rooms = room.filter("room > 0").orderBy("shard").collect()  # a row per shard
        if not rooms:
            break
        free = F.filter(F.array(*[F.struct(F.lit(r["shard"]).alias("shard"), F.lit(r["room"]).alias("room")) for r in rooms]),
                        lambda r: r["room"] >= F.col("n"))
        pick = F.get(free, F.pmod(F.xxhash64("group", F.lit(turn)), F.greatest(F.size(free), F.lit(1))).cast("int"))
        asks = placed.filter("above").select("group", F.col("shard").alias("was"), "n", pick.alias("to")).filter("to IS NOT NULL")
        asks = asks.select("group", "was", "n", F.col("to.shard").alias("shard"), F.col("to.room").alias("room"))
        let = numbered_sums(asks).filter("ahead + n <= room").select(
            "group", F.col("was").alias("shard"), F.col("shard").alias("target"))
        moved = cells.join(let, ["group", "shard"], "left").select(
            "group", F.coalesce("target", "shard").alias("shard"), "n", F.col("target").isNotNull().alias("moved"))
        moved, after = staged(moved, "cells")
        release(spark, path)
        cells, path = moved.drop("moved"), after
        if moved.filter("moved").isEmpty():
            break
    return cells, path


def propagate(cells: DataFrame, quota: Column, rounds: int) -> tuple[DataFrame, str]:
    """(group, shard, n) after the rounds, and its folder. ``quota``: the rows that ``shard`` may hold."""
    spark = cells.sparkSession
    cells, path = staged(cells, "cells")
    for _ in range(rounds):
        load = cells.groupBy("shard").agg(F.sum("n").alias("load"))
        room = load.select("shard", (quota - F.col("load")).alias("room"))  # a row per shard
        # the shard with most of the group, of those that can take the rest of it if there are any
        seen = cells.join(F.broadcast(room), "shard").withColumn("members", F.sum("n").over(
            Window.partitionBy("group")))
        best = seen.groupBy("group").agg(F.max_by("shard", F.struct(
            F.col("room") >= F.col("members") - F.col("n"), "n", F.xxhash64("group", "shard"))).alias("target"))
        room = room.withColumnRenamed("shard", "target")
        asked = cells.join(best, "group").filter("shard <> target")
        # larger parties first; of one class, in ranges of a hash
        asked = asked.withColumn("range", (-F.floor(F.log2("n")) * RANGES
                                           + F.pmod(F.xxhash64("group"), F.lit(RANGES))).cast("bigint"))
        asked, asked_path = staged(asked, "moves")
        sums = asked.groupBy("target", "range").agg(F.sum("n").alias("held"))
        before = Window.partitionBy("target").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0))).join(room, "target")
        inside = Window.partitionBy("target", "range").orderBy("group", "shard").rowsBetween(
            Window.unboundedPreceding, -1)
        ahead = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
        let = asked.join(sums, ["target", "range"]).withColumn("ahead", ahead).withColumn(
            "moved", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("ahead"))))
        let = let.filter("moved > 0")
        change = (let.select("group", F.col("target").alias("shard"), F.col("moved").alias("n"))
                  .unionByName(let.select("group", "shard", (-F.col("moved")).alias("n"))))
        new = cells.unionByName(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
        new, after = staged(new, "cells")
        release(spark, path, asked_path)
        cells, path = new, after
    return cells, path


def assign(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id",
           group: str = "group") -> DataFrame:
    """``rows`` (staged) with shard and slot (gapless from 0 within the shard). Row counts differ by one at most."""
    spark = rows.sparkSession
    names = rows.columns
    rows = rows.withColumnRenamed(group, "group")
    total = rows.count()
    least, extra = divmod(total, shards)
    quota = F.lit(least) + F.when(F.col("shard") < extra, 1).otherwise(0)
    by_key = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    cells = rows.groupBy("group", by_key.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("members", F.sum("n").over(Window.partitionBy("group"))).filter("members > 1")
    whole = F.when(F.col("members") <= least, F.pmod(F.xxhash64("group"), F.lit(shards)).cast("int")).otherwise(F.col("shard"))
    cells = cells.withColumn("shard", whole).groupBy("group", "shard").agg(F.sum("n").alias("n"))
    cells, settled = settle(cells, quota, shards, SETTLE_ROUNDS)
    cells, path = propagate(cells, quota, rounds)
    release(spark, settled)
    # a start by hash can overfill a shard; what is above its quota gives way
    cells = numbered_sums(cells).withColumn(
        "n", F.greatest(F.lit(0), F.least(F.col("n"), quota - F.col("ahead")))).drop("ahead")
    plan = cells.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))
    place = F.aggregate("cells", F.struct(F.col("place").alias("left"), F.lit(None).cast("int").alias("shard")),
                        lambda acc, c: F.struct((acc["left"] - c["n"]).alias("left"),
                                                F.when(acc["shard"].isNull() & (acc["left"] < c["n"]), c["shard"])
                                                .otherwise(acc["shard"]).alias("shard")))["shard"]
    linked = numbered(rows, ["group"], names_of(names, group), "place", more=plan, how="left").withColumn("shard", place)
    cols = [*rows.columns, "shard"]
    dealt, dealt_path = staged(linked.select(*cols), "dealt")
    taken = {r["shard"]: r["n"] for r in  # a row per shard
             dealt.filter("shard IS NOT NULL").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, run = [], 0
    for s in range(shards):
        run += least + (s < extra) - taken.get(s, 0)
        ends.append(run)
    order = names_of(names, group)
    pool = numbered(dealt.filter("shard IS NULL").drop("shard").withColumn("all", F.lit(0)), ["all"], order,
                    "place", RANGES * shards)
    pool = pool.withColumn("shard", _first_above(F.col("place"), ends).cast("int"))
    done, _ = staged(dealt.filter("shard IS NOT NULL").unionByName(pool.select(*cols)), "sharded")
    release(spark, path, dealt_path)
    return numbered(done, ["shard"], order, "slot").withColumnRenamed("group", group)


def names_of(names: list[str], group: str) -> list[str]:
    """Columns that order rows: all of them, so that rows in equal places are the same."""
    return ["group" if n == group else n for n in names]


def numbered_sums(cells: DataFrame) -> DataFrame:
    """``cells`` with ``ahead``, the sum of n over the cells before it in its shard: larger ones, by power of two."""
    cells = cells.withColumn("range", (-F.floor(F.log2("n")) * RANGES + F.pmod(F.xxhash64("group"), F.lit(RANGES)))
                             .cast("bigint"))
    sums = cells.groupBy("shard", "range").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    return (cells.join(sums, ["shard", "range"])
            .withColumn("ahead", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .drop("range", "offset"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`) for every row of ``docs``."""
    rows, _ = staged(docs.select(F.col(key).alias("doc_id"), *[
        c.alias(n) for n, c in text_columns(F.col(text)).items()]), "shard-rows")
    return assign(rows, shards, rounds).select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
