"""Sharding, mixing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanrisk.llm import decontaminate as D
from spanrisk.llm import mix as M
from spanrisk.llm import shard as S
from spanrisk.llm import simhash as H
from spanrisk.llm.common import staged
from tests.conftest import SF_SMALL
from tests.llm import cases


@pytest.mark.parametrize("shards", [1, 7, 40, 200])
def test_shards(spark, shards):
    rows = cases.texts()
    got = S.shard_documents(cases.docs(spark, rows, clash=True), shards=shards).collect()
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    sizes = [len(held[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_groups_stay_together(spark):
    """A group a third of all rows fills whole shards; small groups are not cut."""
    rows = [(i, f"own {i}", "en", "s", 1) for i in range(300)] + [(1000 + i, "hot", "en", "s", 1) for i in range(200)]
    rows += [(2000 + i, f"pair {i // 3}", "en", "s", 1) for i in range(90)]
    got = S.shard_documents(cases.docs(spark, rows), shards=10).join(
        cases.docs(spark, rows).select("doc_id", "text"), "doc_id")
    cut = {r["text"]: r["n"] for r in got.groupBy("text").agg(F.countDistinct("shard").alias("n")).collect()}
    assert sum(cut[f"pair {k}"] > 1 for k in range(30)) <= 2
    assert cut["hot"] <= 10
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, cut at the cap, share the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    done, free, total = {}, set(names), sum(sizes.values())
    while free:
        rest = total - sum(done.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return done | share
        done |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return done


@pytest.mark.parametrize("buckets", [1, 64, M.BUCKETS])
def test_mix(spark, buckets):
    rows = cases.texts()
    got = M.mix(cases.docs(spark, rows, clash=True), M.n_words(F.col("text")), buckets=buckets).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
    longest = Counter()
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = M.mix(cases.docs(spark, rows).repartition(7), M.n_words(F.col("text")), buckets=buckets).collect()
    key = lambda r: (r["doc_id"], r["source"], r["size"], r["taken"])
    assert Counter(map(key, got)) == Counter(map(key, again))
    assert M.mix(cases.docs(spark, []), M.n_words(F.col("text"))).count() == 0


def test_weights_pull(spark):
    """Documents of ten times the weight are drawn far more often."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', id % 2) AS source", "1 AS size",
                                        "IF(id % 20 < 2, 10.0, 1.0) AS w")
    got = M.mix(docs, F.col("size"), F.col("w"), weights=(1, 9)).filter("source = 's0'")
    share = {r["heavy"]: r["m"] for r in got.groupBy((F.col("doc_id") % 20 < 2).alias("heavy")).agg(
        F.avg("epochs").alias("m")).collect()}
    assert share[True] > 2 * share[False]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert docs.columns == [f.name for f in cases.DOCS.fields]
    seen = {}
    for name, stage in P.STAGES:
        before = docs
        docs, _ = staged(stage(spark, docs, SF_SMALL), f"test-{name}")
        seen[name] = (before, docs)
        if name != "sharding":
            assert set(docs.columns) == set(P.COLUMNS)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    before, after = seen["quality_classifier"]
    lost = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.filter("quality = 1 and toxic = 0").count() <= 2
    before, after = seen["simhash_near_dedup"]
    marked = H.near_duplicates(before)
    assert after.count() == marked.select("component_id").distinct().count()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    before, after = seen["benchmark_decontamination"]
    hit = D.find_overlaps(before, items).filter("size(hit_spans) > 0").select("doc_id")
    assert hit.count() > 0
    assert D.find_overlaps(after, items).filter("size(hit_spans) > 0").count() == 0
    clean = before.join(hit, "doc_id", "left_anti").select(*P.COLUMNS)
    assert clean.exceptAll(after.select(*P.COLUMNS)).count() == 0
    before, after = seen["source_mixing"]
    assert after.groupBy("doc_id").count().filter("count > 3").count() == 0
    before, after = seen["sharding"]
    sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert sum(sizes) == before.count() and max(sizes) - min(sizes) <= 1


def test_stages_take_edge_rows(spark, tmp_path):
    import os

    for name in ("benchmark", "labels"):
        os.symlink(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    for rows in (cases.texts(), []):
        docs = cases.docs(spark, rows, clash=True)
        for name, stage in P.STAGES:
            docs, _ = staged(stage(spark, docs, str(tmp_path)), f"edge-{name}")
            docs.count()
