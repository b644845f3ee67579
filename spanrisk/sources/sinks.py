"""Sinks: parquet stages, CSV (plain and gzip), JSON reports, GeoJSON layers.

Every sink is a distributed DataFrame write; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sink_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    w = df.write.mode("overwrite").option("header", True)
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


def sink_json_report(df: DataFrame, path: str) -> None:
    """Report table as JSON lines, in as many files as the table has partitions (an aggregate of all rows has one)."""
    df.write.mode("overwrite").json(path)


def geojson_features(df: DataFrame, props: list[str], lat: str = "lat", lon: str = "lon",
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """One GeoJSON Point feature per row, as a JSON string column ``feature``, beside the columns ``carry``."""
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        F.struct(*[F.col(p) for p in props]).alias("properties"),
    )
    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        *[c for c in ("severity",) if c in df.columns], *carry, F.to_json(feat).alias("feature"))


def sink_geojson(df: DataFrame, path: str, props: list[str]) -> None:
    """Newline-delimited GeoJSON features, one directory per severity tier."""
    geojson_features(df, props).write.mode("overwrite").partitionBy("severity").text(path)


#: Features of one collection, about: some 25 MB of text, which one task holds.
COLLECTION_FEATURES = 50_000


def geojson_collections(df: DataFrame, props: list[str], order: str,
                        per_collection: int = COLLECTION_FEATURES) -> DataFrame:
    """One row per FeatureCollection: severity, collection and the whole document as ``value``, its features by
    ``order``. A tier of up to ``per_collection`` features is one collection; a larger one is dealt by a hash of the
    feature to as many collections of about that size as it takes, so that no task holds a whole tier. Rows without
    a place on the map are left out; a tier without features has no row."""
    rows = geojson_features(df.filter(F.col("severity").isNotNull()), [*props], carry=(order,))
    sizes = rows.groupBy("severity").agg(F.ceil(F.count(F.lit(1)) / per_collection).alias("collections"))
    rows = rows.join(sizes, "severity").withColumn(  # one row per tier
        "collection", F.pmod(F.xxhash64("feature", order), F.col("collections")))
    held = rows.groupBy("severity", "collection").agg(
        F.array_sort(F.collect_list(F.struct(order, "feature"))).alias("held"))
    features = F.array_join(F.transform("held", lambda x: x["feature"]), ",")
    return held.select("severity", "collection", F.concat(
        F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}")).alias("value"))


def sink_geojson_collections(df: DataFrame, path: str, props: list[str], order: str,
                             per_collection: int = COLLECTION_FEATURES) -> None:
    """FeatureCollections as map readers open them, one file each under severity=.../collection=..."""
    geojson_collections(df, props, order, per_collection).write.mode("overwrite").partitionBy(
        "severity", "collection").text(path)
