"""End-to-end batch job on the small fixture, with the real boosted trees."""

import json
import os

from pyspark.sql import functions as F

from spanrisk.plans.job import run_job
from spanrisk.session import scratch_path
from tests.conftest import SF_SMALL


def test_job_end_to_end(spark):
    out = scratch_path(spark, "job-test")
    times = run_job(spark, sf_dir=SF_SMALL, out_dir=out, model=True)
    for stage in ("ingest", "features", "model_and_score", "rank", "exposure", "geojson_layers"):
        assert stage in times
    rep = spark.read.json(f"{out}/outputs/model_report").first()
    # the published quality bound for the cross-validated model
    assert rep["gbt_cv_auc"] > 0.70
    assert rep["n_samples"] > 0 and 0 < rep["n_poor"] < rep["n_samples"]
    ranked = spark.read.parquet(f"{out}/stage/map_data")
    n = ranked.count()
    r = ranked.agg(F.min("severity_rank"), F.max("severity_rank"), F.countDistinct("severity_rank")).first()
    assert tuple(r) == (1, n, n)
    # every probability is out-of-fold and inside [0, 1]
    sc = spark.read.parquet(f"{out}/stage/scored")
    assert sc.filter((F.col("ML_PROBA") < 0) | (F.col("ML_PROBA") > 1) | F.col("ML_PROBA").isNull()).count() == 0
    local = out[len("file:"):] if out.startswith("file:") else out
    assert os.path.isdir(f"{local}/model/gbt_pipeline")
    layers = {p for p in os.listdir(f"{local}/outputs/geojson") if p.startswith("severity=")}
    assert layers <= {"severity=Critical", "severity=High"} and layers
    stats = spark.read.json(f"{out}/outputs/statistics").first()
    assert stats["total_bridges"] == n and stats["n_critical"] + stats["n_high"] + stats["n_medium"] + stats["n_low"] == n
    assert stats["median_age"] is not None and stats["riskiest_state"]
    top5 = spark.read.json(f"{out}/outputs/exposure_report/top5").first()["top_by_fatalities"]
    assert 0 < len(top5) <= 5
    line = spark.read.text(f"{out}/outputs/geojson").first()["value"]
    feat = json.loads(line)
    assert feat["type"] == "Feature" and feat["geometry"]["type"] == "Point"
    # each small tier is one FeatureCollection, in rank order
    whole = [json.loads(r["value"]) for r in spark.read.text(f"{out}/outputs/geojson_collections", wholetext=True).collect()]
    assert len(whole) == len(layers) and {w["type"] for w in whole} == {"FeatureCollection"}
    assert sum(len(w["features"]) for w in whole) == spark.read.text(f"{out}/outputs/geojson").count()
    for w in whole:
        ranks = [f["properties"]["severity_rank"] for f in w["features"]]
        assert ranks == sorted(ranks)
    totals = spark.read.json(f"{out}/outputs/exposure_report/totals").first()
    assert (totals["base_collapse_rate_per_bridge"], totals["p_collapse_risk1_bridge"]) == (1.3e-5, 2.5e-3)


def test_job_without_a_model(spark):
    """Too few poor structures, or no model asked for: the report says so."""
    from spanrisk.params import ModelParams

    for model, note in ((True, "ML not trained due to insufficient labels"), (False, "ML not trained: switched off")):
        out = scratch_path(spark, f"job-untrained-{model}")
        run_job(spark, sf_dir=SF_SMALL, out_dir=out, model=model, p=ModelParams(min_positives=10**9))
        rep = spark.read.json(f"{out}/outputs/model_report").first()
        assert rep["note"] == note and 0 < rep["n_poor"] < rep["n_samples"]


def test_collections_of_a_large_tier(spark):
    from spanrisk.sources import sinks as K

    rows = [(i, "High", 1.0 if i % 10 else None, 2.0, 'a "b"') for i in range(1000)] + [
        (7, "Critical", 1.0, 2.0, None)] * 3 + [(None, None, 1.0, 2.0, "x")]
    df = spark.createDataFrame(rows, "n long, severity string, lat double, lon double, name string").repartition(5)
    got = K.geojson_collections(df, ["name", "n"], "n", per_collection=100).collect()
    high = [json.loads(r["value"]) for r in got if r["severity"] == "High"]
    assert len(high) == 9 and all(len(h["features"]) < 200 for h in high)
    ids = [[f["properties"]["n"] for f in h["features"]] for h in high]
    assert sorted(sum(ids, [])) == [i for i in range(1000) if i % 10] and all(x == sorted(x) for x in ids)
    critical = [json.loads(r["value"]) for r in got if r["severity"] == "Critical"]
    assert [len(c["features"]) for c in critical] == [3] and len(got) == 10
    assert K.geojson_collections(df.limit(0), ["name"], "n").collect() == []


def test_job_sequential_fits(spark):
    """concurrent_fits=1 trains one model at a time (the large-input setting)."""
    from spanrisk.params import ModelParams

    out = scratch_path(spark, "job-seq")
    times = run_job(spark, sf_dir=SF_SMALL, out_dir=out, model=True, p=ModelParams(n_trees=5, concurrent_fits=1))
    assert times["model_and_score"] > 0
    sc = spark.read.parquet(f"{out}/stage/scored")
    assert sc.filter(F.col("ML_PROBA").isNull()).count() == 0
    local = out[len("file:"):] if out.startswith("file:") else out
    assert os.path.isdir(f"{local}/model/gbt_pipeline")
