"""SimHash components and suffix-array removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanrisk.llm import shard as S
from spanrisk.llm import simhash as H
from spanrisk.llm import suffix_dedup as U
from spanrisk.llm.components import connected_components
from tests.llm import cases

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    w = TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_roots(codes, limit=4):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_components_of_texts(spark):
    rows = cases.texts()
    codes = [plain_print(r[1]) for r in rows]
    roots = plain_roots(codes)
    least = {}
    for r, (key, *_) in zip(roots, rows):
        least[r] = min([x for x in (least.get(r), key) if x is not None], default=None)
    want = Counter((row[0], c, least[r]) for row, c, r in zip(rows, codes, roots))
    got = H.near_duplicates(cases.docs(spark, clash=True)).collect()
    assert Counter((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got) == want
    kept = H.keep_one(cases.docs(spark, clash=True))
    assert len(kept.columns) == 5 + len(cases.CLASH)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({x for x in least.values() if x is not None})


def codes_near(seed, centres=40, each=25):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [H.BUCKET_ROWS, 4])
def test_links_of_codes(spark, bucket_rows):
    codes = codes_near(5)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fingerprint bigint").repartition(3)
    got = {r["node"]: r["root"] for r in connected_components(H.near_links(df, bucket_rows=bucket_rows)).collect()}
    mine = {}
    for c in signed:
        mine.setdefault(got.get(c, c), []).append(c)
    plain = {}
    for c, r in zip(signed, plain_roots(codes)):
        plain.setdefault(r, []).append(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


@pytest.mark.parametrize("limit", [0, 2, 4, 9])
def test_index_alone(limit):
    codes = np.array(codes_near(9, 12, 60), dtype=np.uint64)
    order = np.argsort(H.gray_rank(codes))
    codes = codes[order]
    bucket = (np.arange(len(codes)) > 300).astype(np.int64)
    got = H.HammingIndex(codes, bucket, limit).components()
    for b in (0, 1):
        part = np.flatnonzero(bucket == b)
        want = plain_roots([int(c) for c in codes[part]], limit)
        assert [int(x) for x in got[part]] == [int(part[w]) for w in want]


def test_gray_rank_inverts():
    x = np.array([0, 1, 2, 3, 1 << 63, (1 << 64) - 1], dtype=np.uint64)
    r = H.gray_rank(x)
    assert (r ^ r >> np.uint64(1) == x).all()


def test_contraction(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100, **{k: 200 for k in range(200, 260)}}


def plain_removal(rows, length=50):
    first = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for key, text, *_ in order:
        b = (text or "").encode()
        rank = U.NO_ID if key is None else key
        for s in range(len(b) - length + 1):
            first.setdefault(b[s:s + length], rank)
    out = Counter()
    for key, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (U.NO_ID if key is None else key):
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[key, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


SUFFIX_PARAMS = [U.SuffixParams(), U.SuffixParams(range_suffixes=40, part_bytes=3000, slice_bytes=5000),
                 U.SuffixParams(range_suffixes=40, part_bytes=3000, slice_bytes=5000, max_splitters=4)]


@pytest.mark.parametrize("p", SUFFIX_PARAMS)
@pytest.mark.parametrize("ids", ["null", "one"])
def test_removal_with_one_id(spark, p, ids):
    """All rows of one id or of none, but for a few: ranges are cut by text, repeated rows come back as often."""
    key = None if ids == "null" else 77
    rows = [(key, t, *rest) for _, t, *rest in cases.texts(3)[:90]]
    hot = "the same words at the head of every text of this one id, "
    rows += [(key, hot + f"{k} " * 9, "x", "s", 1) for k in range(120)] + [(key, "copy " * 40, "x", "s", 1)] * 150
    rows += [(3, "copy " * 30 + hot, "x", "s", 1), (5, hot * 2, "x", "s", 1), (key, "", "x", "s", 1)]
    done = U.remove_repeats(cases.docs(spark, rows), p=p)
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    got = done.select("doc_id", "n_bytes", gone, F.size("removed"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == plain_removal(rows)


def test_bounds(spark):
    """Bounds are distinct, as many as the ranges ask for, and cut one id's rows of equal leading bytes."""
    rows = [(None, f"{k:03d} " + "equal head and equal tail of all the texts, " * 3, "x", "s", 1) for k in range(300)]
    docs = cases.docs(spark, rows).select("doc_id", "text")
    total = sum(len(r[1]) for r in rows)
    split = U._splitters(docs, len(rows), total, U.SuffixParams(range_suffixes=50))
    bounds = list(zip(split.lead.tolist(), split.doc.tolist(), split.tag.tolist()))
    assert bounds == sorted(set(bounds)) and len(bounds) > 0.8 * (total // 20 // 50)
    lead = np.full(300, split.lead[len(split.lead) // 2])
    tag = np.array([U.xxhash.xxh64_intdigest(r[1]) for r in rows], dtype=np.uint64)
    own, low, high = split.deal(lead, np.full(300, U.NO_ID), tag)
    below = [sum(b[0] < lead[0] or b <= (lead[0], U.NO_ID, t) for b in bounds) for t in tag.tolist()]
    assert own.tolist() == below and len(set(below)) > 2


@pytest.mark.parametrize("p", SUFFIX_PARAMS)
def test_removal(spark, p):
    rows = cases.texts() + cases.texts(2)[:60] + [(500 + k, "ab" * 700 + str(k // 3), "x", "s", 1) for k in range(9)]
    done = U.remove_repeats(cases.docs(spark, rows, clash=True), p=p)
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    got = done.select("doc_id", "n_bytes", gone, F.size("removed"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == plain_removal(rows)
    assert U.remove_repeats(cases.docs(spark, [])).count() == 0


def test_multikey_sort():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(400)]
    buf = b"".join(strings) + bytes(8)
    size = np.array([len(s) for s in strings])
    word = U._words(buf, np.cumsum(size) - size, size)
    order, group = U.multikey_sort(word, 3, *U._unsorted(len(strings)))
    padded = [strings[i].ljust(24, b"\0") for i in order]
    assert padded == sorted(padded)
    assert [a == b for a, b in zip(padded, padded[1:])] == [a == b for a, b in zip(group, group[1:])]


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Nearly all rows are linked: 60 groups of 6 to 14 rows, one larger than a shard, and a few single rows."""
    rows, sizes = [], [6 + i % 9 for i in range(60)] + [140] + [1] * 20
    for g, n in enumerate(sizes):
        rows += [(len(rows) + i, f"text of group {g}", "en", "s", 1) for i in range(n)]
    got = S.shard_documents(cases.docs(spark, rows), shards=8).toPandas()
    per_shard = got.groupby("shard").size().reindex(range(8), fill_value=0)
    assert per_shard.max() - per_shard.min() <= 1 and len(got) == len(rows)
    cut = got.groupby("text_crc32").shard.nunique()
    fit = got.groupby("text_crc32").size().between(2, len(rows) // 8)
    assert (cut[fit] > 1).sum() <= 6 and (cut[fit] == 1).sum() >= 54
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
