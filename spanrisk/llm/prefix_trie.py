"""Prefix trie of conversations by whole-sequence collapse.

A turn is its digest (of role and text) and the length of its text, so texts are read once and never move. Turns are
sorted by conversation, and one pass over each sorted partition chains the digests: every turn gets the digest of the
whole prefix that it ends, which names a node of the trie. No step holds a conversation.

Conversations that end in the same prefix are one weighted sequence: number, smallest id, list of ends. Only one
conversation of each sequence goes on. Sequences that are proper prefixes of others are dropped by an anti-join; those
left are the leaves. Every node's figures are sums and minima over the weighted prefixes of sequences, which partial
aggregation makes few before the shuffle, for the root too.

Saved tokens of a subtree are (text over all members, each from the node on) less (text of its distinct nodes). Each
node is counted with the sequence of its smallest member: along that sequence its own nodes are the last ones, so one
depth per sequence says which they are, and no node is expanded to its ancestors.

List of ends: ids in blocks of 2 to the END_BITS consecutive ones are joined in one row each, and a digest over several blocks is
fed block by block in sorted order; no list of ends is held whole.

Defined results: null role or text is empty; equal turn numbers are ordered by their digest, null ones come first;
repeated rows are turns each; rows without an id are one conversation, the last of members, whose decimal is empty and
which takes nothing from others; no rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrisk.llm.common import release, staged

#: Rebuilding: conversations of a block share its first one's turns, fewer than MOST of them.
BLOCK = 100
MOST = 6
END_BITS = 12
#: Bytes of a digest.
WIDTH = 16

STEPS = "conv_id bigint, depth bigint, prefix binary, parent binary, size bigint, before bigint"


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, size): every turn's place in its conversation, from 1, with digest and text length."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)
    rows = conversations.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("digest"), F.length(t).cast("bigint").alias("size"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(place).cast("bigint").alias("pos"), "digest", "size")


def n_taken(conv: Column, most: int = MOST) -> Column:
    """How many turns of its host a conversation begins with."""
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")), F.lit(0)) % most


def rebuilt_rows(turns: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(conv_id, part, pos, digest, size): a row of part 0 for every conversation, then the first turns of its host (the
    first conversation of its block) as part 1, and its own turns behind as many as part 2."""
    c = F.col("conv_id")
    own_host = F.coalesce(c % block == 0, F.lit(True))
    starts = turns.filter("pos = 1").select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"),
                                            F.lit(None).cast("binary").alias("digest"),
                                            F.lit(0).cast("bigint").alias("size"))
    hosts = turns.filter((c % block == 0) & (F.col("pos") < most)).select(
        c.alias("host"), F.col("pos").alias("p"), F.col("digest").alias("d"), F.col("size").alias("s"))
    guests = starts.filter(~own_host & (n_taken(c, most) > 0)).select("conv_id", (c - c % block).alias("host"),
                                                                      n_taken(c, most).alias("n"))
    given = guests.join(hosts, "host").filter("p <= n").select(
        "conv_id", F.lit(1).alias("part"), F.col("p").alias("pos"), F.col("d").alias("digest"), F.col("s").alias("size"))
    rest = turns.filter(own_host | (F.col("pos") > n_taken(c, most))).select("conv_id", F.lit(2).alias("part"), "pos",
                                                                             "digest", "size")
    return starts.unionByName(given).unionByName(rest)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STEPS of rows sorted by conversation, part and place."""
    prefix, depth, before, last = b"", 0, 0, 0
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for conv, part, digest, size in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "digest", "size"))):
            parent = None
            if part == 0:
                prefix, depth, before, last = b"", 0, 0, 0
            else:
                parent, depth, before, last = prefix, depth + 1, before + last, size
                prefix = hashlib.sha256(parent + digest).digest()[:WIDTH]
            for column, value in zip(out, (conv, depth, prefix, parent, last, before)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                         names=["conv_id", "depth", "prefix", "parent", "size", "before"])


def prefix_steps(rows: DataFrame) -> DataFrame:
    """STEPS: every prefix of every conversation, with the parent prefix, the length of its last text and that of the
    texts before it. ``rows`` as ``rebuilt_rows`` gives them."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return dealt.mapInArrow(_chained, STEPS)


def end_blocks(steps: DataFrame) -> DataFrame:
    """Conversations by the sequence that they end: (seq, block) with number, smallest id, depth, text length and ids,
    the decimal ids of the block in order, comma-joined."""
    ends = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "prefix", (F.col("before") + F.col("size")).alias("total")))
                                        .alias("e"))
    ids = F.array_sort(F.collect_list(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")))
    text = F.array_join(F.transform(ids, lambda x: F.coalesce(x["conv_id"].cast("string"), F.lit(""))), ",")
    return ends.groupBy(F.col("e.prefix").alias("seq"), F.shiftright("conv_id", END_BITS).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.max("e.depth").alias("seq_depth"),
        F.max("e.total").alias("total"), text.alias("ids"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, digest) of rows sorted by sequence and block: each block's ids are fed as they come."""
    seq, held = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([held.hexdigest()])], ["seq", "digest"])

    for batch in batches:
        for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if held is not None and s == seq:
                held.update(b",")
            else:
                if held is not None:
                    yield row()
                seq, held = s, hashlib.sha256()
            held.update(ids.encode())
    if held is not None:
        yield row()


def end_digests(blocks: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq, digest): SHA-256 of every sequence's list of ends."""
    one = sequences.filter("n_blocks = 1").select("seq", F.col("only").alias("digest"))
    more = blocks.join(sequences.filter("n_blocks > 1").select("seq"), "seq", "left_semi").select("seq", "block", "ids")
    more = more.repartition("seq").sortWithinPartitions("seq", F.col("block").asc_nulls_last())
    return one.unionByName(more.select("seq", "ids").mapInArrow(_digests, "seq binary, digest string"))


def collapse(blocks: DataFrame) -> DataFrame:
    """Weighted sequences: (seq, rep, weight, seq_depth, total, n_blocks, only); rep is the smallest id."""
    return blocks.groupBy("seq").agg(
        F.min("low").alias("rep"), F.sum("n").alias("weight"), F.max("seq_depth").alias("seq_depth"),
        F.max("total").alias("total"), F.count(F.lit(1)).alias("n_blocks"), F.max(F.sha2("ids", 256)).alias("only"))


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. ``rows`` as ``rebuilt_rows`` gives them, of any conversations."""
    spark = rows.sparkSession
    steps, at_steps = staged(prefix_steps(rows), "trie-steps")
    blocks, at_blocks = staged(end_blocks(steps), "trie-ends")
    sequences, at_sequences = staged(collapse(blocks), "trie-sequences")
    walk = steps.join(sequences.select("rep", "weight", "seq_depth", "total"), F.col("conv_id").eqNullSafe(F.col("rep")))
    walk, at_walk = staged(walk.drop("conv_id"), "trie-prefixes")
    proper = walk.filter("depth < seq_depth").select("prefix").distinct()
    leaves = sequences.join(proper, F.col("seq") == F.col("prefix"), "left_anti").select(
        F.col("rep").alias("leaf_rep"), F.lit(1).alias("leaf"))
    nodes = walk.join(leaves, F.col("rep").eqNullSafe(F.col("leaf_rep")), "left").groupBy("prefix").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("before").alias("before"),
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("total") - F.col("before"))).alias("texts"))
    nodes, at_nodes = staged(nodes, "trie-nodes")
    # a sequence's own nodes, those whose smallest member is its own, are its last: where they begin
    own = nodes.groupBy("conv_id").agg(F.min("before").alias("own_before")).withColumnRenamed("conv_id", "owner")
    own = own.join(sequences.select("rep"), F.col("owner").eqNullSafe(F.col("rep"))).drop("rep")
    distinct = walk.join(own, F.col("rep").eqNullSafe(F.col("owner"))).groupBy("prefix").agg(
        F.sum(F.col("total") - F.greatest("before", "own_before")).alias("once"))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = end_digests(blocks, sequences).withColumnRenamed("seq", "prefix")
    done = nodes.join(distinct, "prefix", "left").join(children, "prefix", "left").join(ends, "prefix", "left")
    # the root's own row is one number; other parents are found by a join that adaptive skew handling can split
    top = nodes.filter("depth = 0").select("conv_id").first()
    parents = nodes.filter("depth > 0").select(F.col("prefix").alias("up"), F.col("conv_id").alias("up_conv"))
    below = F.when(F.col("depth") > 1, F.col("parent"))
    done = done.withColumn("below", below).join(parents, F.col("below") == F.col("up"), "left")
    out = done.select(
        "conv_id", "depth",
        F.when(F.col("depth") == 1, F.lit(top["conv_id"] if top else None).cast("bigint")).otherwise(F.col("up_conv"))
        .alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves", (F.col("texts") - F.coalesce("once", F.lit(0))).cast("bigint").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    out, _ = staged(out, "trie")
    release(spark, at_steps, at_blocks, at_sequences, at_walk, at_nodes)
    return out


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text", block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    turns, path = staged(turn_rows(conversations, conv, turn, role, text), "trie-turns")
    out = trie_nodes(rebuilt_rows(turns, block, most))
    release(conversations.sparkSession, path)
    return out
