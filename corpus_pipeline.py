"""The corpus pipeline: documents to a classified, deduplicated, decontaminated, mixed and sharded training corpus.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the columns of
``documents``; the last returns the shard and slot of every row. ``run`` writes each stage's rows as Parquet in the
shared checkpoint folder and reads them back for the next, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrisk.llm import cotrain, decontaminate, mix, shard, simhash
from spanrisk.llm.common import release, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    docs = docs.select(*COLUMNS)
    scored = cotrain.classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return scored.filter("kept").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go. n_chars follows the text."""
    clean = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))
    cut = F.length("text").cast("bigint")
    return clean.withColumn("n_chars", F.coalesce(cut, F.col("n_chars"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, drawn by the quality weights of their labels. The
    draw is made on narrow rows, one for all equal rows of an id; the texts move once, to meet their epochs."""
    rows = docs.select(*COLUMNS).withColumn("row", F.xxhash64(*COLUMNS))
    narrow = (rows.select("doc_id", "source", "row", mix.n_words(F.col("text")).alias("size"))
              .groupBy("doc_id", "source", "row").agg(F.sum("size").alias("size")))
    weights = mix.quality_weights(table(spark, sf_dir, "labels", "doc_id", "quality"))
    narrow, path = staged(narrow.join(weights, "doc_id", "left"), "mix-rows")
    mixed = mix.mix(narrow, F.col("size"), F.col("weight"), carry=("row",))
    times, _ = staged(mixed.filter("epochs > 0").select(F.col("doc_id").alias("id"), F.col("row").alias("r"),
                                                        "epochs"), "mix-epochs")
    release(spark, path)
    drawn = rows.join(times, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")))
    return mix.repeat(drawn, COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the corpus."""
    return shard.shard_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("source_mixing", source_mixing),
          ("sharding", sharding)]

#: Trained models, 64-bit hashes and propagation rounds have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs, after = staged(out, f"pipeline-{name}")
        if path:
            release(spark, path)
        path = after
    return docs
