"""Importance resampling against a plain Python version, on texts with edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanrisk.llm import resample as I
from tests.llm import cases


def plain_features(text, max_n):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [b" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, max_n, buckets, min_words, share, seed):
    def count(texts):
        c = Counter(zlib.crc32(f) % buckets for t in texts for f in plain_features(t, max_n)[1])
        return c, sum(c.values())

    s, big_s = count([t for _, t in docs])
    t, big_t = count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
            for b in range(buckets)]
    rows = []
    for key, text in docs:
        n, f = plain_features(text, max_n)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))])
    order = sorted((r for r in rows if r[2] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    k = len(order) * share // 100
    return [(*r, i + 1 if i < k else None) for i, r in enumerate(order)] + [(*r, None) for r in rows if r[2] < min_words]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("max_n,buckets,min_words,share,clash", [(2, 10_000, 20, 25, False), (3, 17, 1, 60, True)])
def test_brute_force(spark, max_n, buckets, min_words, share, clash):
    rows = cases.texts(3)
    target = ["The run of bread " * 4, None, "", "x", "漢字 And " * 9]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.importance_resample(cases.docs(spark, rows, clash), df, max_n=max_n, buckets=buckets, min_words=min_words,
                                share=share)
    assert got.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    want = plain([(r[0], r[1]) for r in rows], target, max_n, buckets, min_words, share, I.SEED)
    assert ordered([tuple(r) for r in got.collect()]) == ordered(want)


def test_null_ids_carried_columns_and_empty_tables(spark):
    rows = [(None, f"word {i % 3} " * 15, "en", "s", i) for i in range(30)] + [(4, "a b " * 20, "de", None, None)] * 4
    docs = cases.docs(spark, rows)
    empty = spark.createDataFrame([], "text string")
    got = I.importance_resample(docs, empty, carry=("lang", "n_chars")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 34 * 25 // 100 + 1))
    assert ordered([(r["doc_id"], r["n_chars"]) for r in got]) == ordered([(r[0], r[4]) for r in rows])
    want = plain([(r[0], r[1]) for r in rows], [], 2, I.BUCKETS, 20, 25, I.SEED)
    assert ordered([tuple(r)[:6] for r in got]) == ordered(want)
    assert I.importance_resample(docs.limit(0), empty).collect() == []


def test_crc_of_every_length():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 9000, dtype=np.uint8)
    size = np.concatenate([np.arange(60), rng.integers(0, 60, 200), [I.LONG, I.LONG + 1, 5000]])
    start = rng.integers(0, 4000, len(size))
    got = I.crc32_by_length(data, start, size)
    assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(start, size)]
