"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are computed where the texts are read (no shuffle). Only distinct fingerprints are searched, so a group of
exact copies counts once. Two fingerprints that differ in at most four bits agree in two of six blocks of bits, so
each fingerprint goes to fifteen tables, one for each pair of blocks, with those blocks moved to the front; rows of a
table with equal front bits are a bucket. A bucket is sorted by Gray rank, in which neighbours share long bit
patterns, and indexed bottom up: a node keeps the bits that all codes below it share. The self-join descends pairs of
nodes, adds up the shared bits in which they differ, and drops the whole pair beyond the limit; where even the bits
that are not shared can't exceed it, all codes below are linked at once. Links become stars of a local forest, and
the components of all stars are contracted in Spark. A bucket above ``bucket_rows`` is cut into chunks, and each
pair of chunks is searched by a task of its own, which is exact and bounds memory.

Defined results: a text with no word (null, empty, spaces) has fingerprint zero, which links like any other; a
component's id is its smallest non-null key, null if it has none; repeated rows are separate rows of one component;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.llm.common import staged, with_text_columns
from spanrisk.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BUCKET_ROWS = 50_000
HEAVY_SHARE = 1000  # a fingerprint of more than one row in so many is spread over several tasks
FAN_OUT = 16
STEP = 100_000  # shingles whose bits are unpacked at once
PAIRS = 4096  # node pairs that one step of the search expands

FINGERPRINT = T.StructField("fingerprint", T.LongType())


def _fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> list[int]:
    """Signed 64-bit fingerprints."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, []
    for t in texts:
        words = t.lower().split()  # of bytes: A-Z only
        text = b" ".join(words)
        if not words:
            out.append(0)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        starts = np.append(0, ends[:-1] + 1)
        n = max(1, len(words) - shingle + 1)
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(
            starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist())), ">u8", n)
        votes = sum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                    for part in np.split(hashes, range(STEP, n, STEP)))
        out.append(int(np.packbits(2 * votes > n).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long."""
    return with_text_columns(docs, text, [FINGERPRINT], lambda: lambda texts: {
        "fingerprint": _fingerprints(texts, shingle)})


def blocks_of(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks: two more than the bits that may differ."""
    n = max_bits + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray sequence."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _arranged(code: np.ndarray, blocks: list[tuple[int, int]], front: tuple[int, int]) -> np.ndarray:
    """``code`` with the ``front`` blocks moved to the highest bits."""
    order = [*front, *(k for k in range(len(blocks)) if k not in front)]
    out = np.zeros_like(code)
    for k in order:
        low, width = blocks[k]
        out = out << np.uint64(width) | code >> np.uint64(low) & np.uint64((1 << width) - 1)
    return out


ENTRY = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("front", T.LongType()),
                      T.StructField("rank", T.LongType()), T.StructField("fingerprint", T.LongType())])


def index_entries(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each fingerprint and table: the front bits and the Gray rank (its sign bit flipped, so that signed
    order is rank order)."""
    blocks = blocks_of(max_bits)
    fronts = list(combinations(range(len(blocks)), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            code = signed.view(np.uint64)
            for k, front in enumerate(fronts):
                arranged = _arranged(code, blocks, front)
                rank = (gray_rank(arranged) ^ np.uint64(1 << 63)).view(np.int64)
                width = sum(blocks[b][1] for b in front)
                top = (arranged >> np.uint64(64 - width)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), k, dtype=np.int32)), pa.array(top), pa.array(rank), pa.array(signed)],
                    names=[f.name for f in ENTRY.fields])

    return distinct.select("fingerprint").mapInArrow(run, ENTRY)


class HammingIndex:
    """Hierarchical index over buckets of codes, each bucket in Gray order. Level 0 is the codes."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray, limit: int) -> None:
        self.limit = limit
        new = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sizes = np.diff(np.append(new, len(codes)))
        at = np.arange(len(codes)) - np.repeat(new, sizes)  # place within the bucket
        ones, zeros = codes, ~codes  # bits that all codes below have set, and have not set
        first = np.arange(len(codes))
        self.levels = [(ones, zeros, None, first, np.append(first[1:], len(codes)))]
        while len(at) > len(new):
            head = np.flatnonzero(at % FAN_OUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, head), np.bitwise_and.reduceat(zeros, head)
            first = first[head]
            self.levels.append((ones, zeros, np.append(head, len(at)), first, np.append(first[1:], len(codes))))
            at = at[head] // FAN_OUT

    def components(self) -> np.ndarray:
        """For each code the lowest place of a code that links lead to."""
        parent = np.arange(len(self.levels[0][0]))
        top = len(self.levels) - 1
        tops = np.arange(len(self.levels[top][0]))
        todo = [(top, tops[k:k + PAIRS], tops[k:k + PAIRS]) for k in range(0, len(tops), PAIRS)] if top else []
        while todo:
            level, a, b = todo.pop()
            a, b, linked = self._children(level, a, b)
            if linked is not None:
                parent = merge(parent, *linked)
            if level == 1:
                parent = merge(parent, a, b)
            else:
                todo += [(level - 1, a[k:k + PAIRS], b[k:k + PAIRS]) for k in range(0, len(a), PAIRS)]
        return parent

    def _children(self, level: int, a: np.ndarray, b: np.ndarray):
        """Pairs of children of the node pairs (a, b) that can hold a link, and codes that are linked for sure."""
        heads = self.levels[level][2]
        na, nb = heads[a + 1] - heads[a], heads[b + 1] - heads[b]
        n = na * nb
        k = np.repeat(np.arange(len(a)), n)
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        x, y = heads[a][k] + i // nb[k], heads[b][k] + i % nb[k]
        once = (a != b)[k] | (x < y) | ((x == y) & (level > 1))
        x, y = x[once], y[once]
        ones, zeros, _, first, last = self.levels[level - 1]
        differ = ones[x] & zeros[y] | zeros[x] & ones[y]
        near = np.bitwise_count(differ) <= self.limit
        x, y, differ = x[near], y[near], differ[near]
        if level == 1:
            return x, y, None
        open_bits = ~((ones[x] | zeros[x]) & (ones[y] | zeros[y]))
        sure = np.bitwise_count(differ | open_bits) <= self.limit
        linked = None
        if sure.any():
            lo = np.concatenate([first[x[sure]], first[y[sure]]])
            n = np.concatenate([last[x[sure]], last[y[sure]]]) - lo
            to = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            linked = np.repeat(np.tile(first[x[sure]], 2), n), to
        return x[~sure], y[~sure], linked


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each place's root) after the links (a, b)."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _links(table: np.ndarray, front: np.ndarray, block: np.ndarray, rank: np.ndarray, key: np.ndarray,
           limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (key, root key) of whole buckets that stand in order."""
    if not len(rank):
        return key, key
    new = np.append(True, (table[1:] != table[:-1]) | (front[1:] != front[:-1]) | (block[1:] != block[:-1]))
    bucket = np.cumsum(new)
    several = (np.bincount(bucket) > 1)[bucket]
    rank, bucket, key = rank[several], bucket[several], key[several]
    if not len(rank):
        return key, key
    binary = rank.view(np.uint64) ^ np.uint64(1 << 63)
    root = HammingIndex(binary ^ binary >> np.uint64(1), bucket, limit).components()
    names, at = np.unique(key, return_inverse=True)
    top = merge(np.arange(len(names)), at, at[root])
    linked = np.flatnonzero(top != np.arange(len(names)))
    return names[linked], names[top[linked]]


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct`` fingerprints at ``max_bits`` or less."""
    entries, _ = staged(index_entries(distinct, max_bits), "simhash-index")
    large = (entries.groupBy("table", "front").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows)
             .select("table", "front", F.ceil(F.col("n") / bucket_rows).alias("chunks")))
    dealt = entries.join(large, ["table", "front"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks"))
    dealt = (dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .withColumn("block", F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
             .select("table", "front", "block", "rank", "fingerprint"))
    hold = 4 * bucket_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links(*cols, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            n += batch.num_rows
            if n < hold:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            last = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
                                  | (cols[2][1:] != cols[2][:-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield found([c[:cut] for c in cols])
            held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if n:
            yield found([np.concatenate(c) for c in zip(*held)])

    return (dealt.repartition("table", "front", "block").sortWithinPartitions("table", "front", "block", "rank")
            .mapInArrow(run, EDGE))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (signed long) and component_id."""
    return _marked(docs, key, text, shingle, max_bits, bucket_rows).select(key, "fingerprint", "component_id")


def _marked(docs: DataFrame, key: str, text: str, shingle: int, max_bits: int, bucket_rows: int) -> DataFrame:
    """``near_duplicates`` with a hash of the text, and component_root: two components may have one least key."""
    rows = docs.select(key, text, F.xxhash64(text).alias("text_hash"))
    prints, _ = staged(fingerprints(rows, text, shingle).drop(text), "fingerprints")
    distinct, _ = staged(prints.groupBy("fingerprint").agg(
        F.min(key).alias("least_key"), F.count(F.lit(1)).alias("rows")), "distinct-prints")
    roots = connected_components(near_links(distinct, max_bits, bucket_rows))
    # only linked fingerprints take part in these joins; all others are components of their own
    linked = distinct.join(roots, distinct["fingerprint"] == roots["node"]).select("fingerprint", "root", "least_key")
    ids = linked.groupBy("root").agg(F.min("least_key").alias("component_id"))
    found = linked.join(ids, "root").select("fingerprint", "root", "component_id")
    named = distinct.join(found, "fingerprint", "left").select(
        "fingerprint", "rows", F.coalesce("component_id", "least_key").alias("component_id"),
        F.coalesce("root", "fingerprint").alias("component_root"))
    return _spread_join(prints, named)


def _spread_join(prints: DataFrame, named: DataFrame) -> DataFrame:
    """``prints`` joined with ``named`` on the fingerprint. Fingerprints that hold more than a thousandth of all rows
    (so fewer than a thousand, which is what is broadcast) are cut into parts, and their one row in ``named`` is
    repeated for each part."""
    total = prints.count()
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") * HEAVY_SHARE / max(1, total))).cast("int")
    heavy = named.select("fingerprint", parts.alias("parts")).filter("parts > 1")
    dealt = prints.join(F.broadcast(heavy), "fingerprint", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64(*prints.columns), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    copies = named.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, ["fingerprint", "part"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: of those with its least key, one with the least (fingerprint, hash of
    the text). Of a component without any key, one row of each fingerprint stays. The texts move once, dealt by their
    key and text hash."""
    marked = _marked(docs, key, text, shingle, max_bits, BUCKET_ROWS)
    keep = (marked.filter(F.col(key) == F.col("component_id")).groupBy("component_root")
            .agg(F.min("component_id").alias("kept_key"), F.min(F.struct("fingerprint", "text_hash")).alias("least"))
            .select("kept_key", F.col("least.text_hash").alias("kept_hash")))
    hashed = docs.withColumn("__hash", F.xxhash64(text))
    named = hashed.join(keep, (hashed[key] == keep["kept_key"]) & (hashed["__hash"] == keep["kept_hash"]),
                        "left_semi").dropDuplicates([key, "__hash"]).drop("__hash")
    alone = marked.filter("component_id IS NULL").select("fingerprint").distinct()
    unnamed = docs.filter(F.col(key).isNull()).select(F.struct("*").alias("row"), F.col(text).alias("text"))
    unnamed = fingerprints(unnamed, "text", shingle).join(alone, "fingerprint", "left_semi")
    return named.unionByName(unnamed.dropDuplicates(["fingerprint"]).select("row.*"))
