"""Target-distribution importance resampling with length-bucketed CRC matrices.

Features of a text are its runs of 1 to ``max_n`` consecutive words, joined by one space. Each is hashed into a bucket by
its bytes' CRC-32. A slice of texts is hashed at once: its distinct features (word numbers of a dictionary, paired up and
numbered again for longer runs) are grouped by byte length into two-dimensional uint8 arrays, all CRCs of a group are
updated column by column, and the buckets are scattered back to every occurrence.

Two passes over the texts, neither with a shuffle of them: the first adds up bucket counts (one row per bucket and
task), the second weighs every text by the mean gain of its features, the log ratio of the bucket's share in the target
to its share in the documents. Gumbel noise from a hash of the id turns weights into scores whose largest are a
weighted sample without replacement. The places in that order come from range-sorted narrow rows, so no task sees all.

Defined results: a null or empty text has no features, weight 0; a null id hashes as an empty one and comes last among
ties; rows of one id share its noise, and ties are ordered by id, features and weight; repeated rows each count; an
empty target gives every bucket its smoothed share; no documents give no rows; input columns named like an output are
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.llm.common import release, slices, staged, texts_of, with_text_columns
from spanrisk.operators.rank import global_rank
from spanrisk.session import scratch_path

MAX_N = 2
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 25
SEED = "7"
#: A feature of more bytes is hashed alone: its matrix would be a row or two, with a step for every byte.
LONG = 1024

_FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte: eight steps of the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc32_by_length(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte strings ``data[start:start + size]``, a length at a time, a column at a time."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        n = int(size[group[0]])
        if n > LONG:
            out[group] = [zlib.crc32(data[s:s + n]) for s in start[group].tolist()]
            continue
        matrix = data[np.arange(n)[:, None] + start[group]]  # one row for each column of bytes
        crc = np.full(len(group), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[group] = ~crc
    return out


class Features:
    """Features of a slice of texts: ``n_words`` and ``n_features`` by text, and for each run length the texts of its
    occurrences (ascending) with the bucket of each."""

    def __init__(self, texts: list[bytes], max_n: int, buckets: int) -> None:
        raw = np.frombuffer(b" ".join([*texts, b""]).translate(_FOLD), np.uint8)  # a space behind every text
        inside = raw != 32
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        starts, ends = edges[0::2], edges[1::2]
        text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        self.n_words = np.bincount(text_of, minlength=len(texts))
        self.n_features = np.zeros(len(texts), np.int64)
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(starts):
            return
        inside[ends] = True
        data = raw[inside]  # words with one space behind each
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size + 1)])
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)])
        word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        n_distinct = int(word.max()) + 1
        first, code, last = np.arange(len(word)), word, np.arange(len(word))
        for n in range(1, max_n + 1):
            if n > 1:  # one more word, if it is of the same text
                longer = np.flatnonzero((last + 1 < len(word)) & (text_of[np.minimum(last + 1, len(word) - 1)]
                                                                  == text_of[first]))
                first, last = first[longer], last[longer] + 1
                code, _ = pd.factorize(code[longer] * n_distinct + word[last])
            if not len(first):
                break
            one = np.empty(int(code.max()) + 1, np.int64)  # an occurrence of each distinct feature
            one[code] = np.arange(len(code))
            begin = at[first[one]]
            bucket = crc32_by_length(data, begin, at[last[one] + 1] - 1 - begin) % buckets
            self.runs.append((text_of[first], bucket.astype(np.int64)[code]))
            self.n_features += np.bincount(text_of[first], minlength=len(texts))


def bucket_counts(texts: DataFrame, text: str, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n): occurrences of features by bucket, over all texts; at most one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                for _, bucket in Features(texts_of(part, text), max_n, buckets).runs:
                    held += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str, max_n: int, buckets: int) -> np.ndarray:
    """Of every bucket: 1000 times the log of its smoothed share in the target over that in the documents, floored.
    ``buckets`` rows come to the driver."""
    t = bucket_counts(target, text, max_n, buckets).withColumnRenamed("n", "t")
    s = bucket_counts(docs, text, max_n, buckets).withColumnRenamed("n", "s")
    rows = t.join(s, "bucket", "full").fillna(0, ["t", "s"]).collect()
    of_t, of_s = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        of_t[r["bucket"]], of_s[r["bucket"]] = r["t"], r["s"]
    ratio = (of_t + 1) * (of_s.sum() + buckets) / ((of_s + 1) * (of_t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigher(gains, max_n: int, buckets: int):
    def make():
        gain = gains.value

        def step(texts: list[bytes]) -> dict[str, object]:
            found = Features(texts, max_n, buckets)
            total = np.zeros(len(texts), np.int64)
            for text_of, bucket in found.runs:
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])  # integers throughout
                cut = np.searchsorted(text_of, np.arange(len(texts) + 1))
                total += sums[cut[1:]] - sums[cut[:-1]]
            return {"n_features": found.n_features, "n_words": found.n_words,
                    "weight": np.where(found.n_features > 0, total // np.maximum(found.n_features, 1), 0)}

        return step

    return make


def gumbel(key: Column, seed: str = SEED) -> Column:
    """1000 times a Gumbel variate that depends on ``key`` alone, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def importance_resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
                        max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, share: int = SHARE,
                        seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """``docs``' key with n_features, n_words, weight, score and rank: of the documents with ``min_words`` words, the
    ``share`` percent with the highest scores are drawn, rank 1 first; rank is null for the rest. ``target``: its texts
    are in the column ``text`` too. ``carry``: other columns of ``docs`` to keep."""
    spark = docs.sparkSession
    gains = spark.sparkContext.broadcast(bucket_gains(docs, target, text, max_n, buckets))
    fields = [T.StructField(n, T.LongType()) for n in ("n_features", "n_words", "weight")]
    rows = docs.select(F.col(key).alias("__key"), F.struct(*[F.col(c) for c in carry]).alias("__carried"),
                       F.col(text).alias("__text"))
    if not carry:
        rows = rows.drop("__carried")
    rows = with_text_columns(rows, "__text", fields, _weigher(gains, max_n, buckets)).drop("__text")
    rows, path = staged(rows.withColumn("score", F.col("weight") + gumbel(F.col("__key"), seed)), "resample-weights")
    enough = F.col("n_words") >= min_words
    drawn = rows.filter(enough).count() * share // 100
    # equal rows fall apart by their place in the stage, so that they need not meet in one range
    order = [enough.desc(), F.col("score").desc(), F.col("__key").asc_nulls_last(), F.col("n_features").asc(),
             F.col("weight").asc(), F.col("__place").asc()]
    ranked = global_rank(rows.withColumn("__place", F.monotonically_increasing_id()), order, "rank",
                         path=scratch_path(spark, "resample-ranks"))
    release(spark, path)
    return ranked.select(
        F.col("__key").alias(key), "n_features", "n_words", "weight", "score",
        F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank"),
        *[F.col("__carried")[c].alias(c) for c in carry])
