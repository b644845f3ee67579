"""The batch job: raw inventory in, every published table out.

Stages (each written once, then read by everything downstream):
  ingest   raw inventory (delimited file, or the derived fixture view), typed:
           names, missing values, numbers and coordinates, all rows
  features row filters, pushed to that stage's scan, + 25 features
  model    label check, 3-fold out-of-fold boosted trees, final fit saved
  scored   index + probability + composite score + tier
  ranked   global rank (range partitioned, no single-task window)
  outputs  ranked CSV (gzip), top critical, state summary, map subset,
           exposure table + report, statistics record, the analysis, region
           and exposure tables, GeoJSON layers

``run_job`` returns the wall time of each stage; the benchmark prints them.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrisk.operators import exposure as X
from spanrisk.operators import maplayer as MP
from spanrisk.operators import model as M
from spanrisk.operators import rank as R
from spanrisk.operators import regions as G
from spanrisk.operators import summary as S
from spanrisk.operators.clean import typed, valid_rows
from spanrisk.operators.features import engineer_features
from spanrisk.operators.score import score
from spanrisk.params import DEFAULT_MODEL, ML_FEATURE_COLS, ModelParams
from spanrisk.session import scratch_path
from spanrisk.sources import sinks as K
from spanrisk.sources.delimited import normalise_nulls, rename_columns, scan_delimited
from spanrisk.sources.inventory import raw_inventory


class Timer:
    def __init__(self):
        self.times: dict[str, float] = {}

    def run(self, name: str, fn):
        t = time.perf_counter()
        out = fn()
        self.times[name] = round(time.perf_counter() - t, 3)
        return out


def _write_stage(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_job(spark: SparkSession, sf_dir: str | None = None, raw_path: str | None = None,
            out_dir: str | None = None, model: bool = True, p: ModelParams = DEFAULT_MODEL) -> dict[str, float]:
    """Run the whole pipeline; returns stage timings in seconds."""
    out = (out_dir or scratch_path(spark, "job")).rstrip("/")
    tm = Timer()
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    from pyspark.sql import Observation

    obs_read, obs_clean = Observation("rows_read"), Observation("rows_clean")

    def ingest():
        raw = scan_delimited(spark, raw_path) if raw_path else raw_inventory(spark, sf_dir)
        renamed = rename_columns(normalise_nulls(raw)).observe(obs_read, F.count(F.lit(1)).alias("n"))
        return _write_stage(typed(renamed, p), f"{out}/stage/inventory")

    inventory = tm.run("ingest", ingest)

    def features():
        f = engineer_features(valid_rows(inventory, p).observe(obs_clean, F.count(F.lit(1)).alias("n")), p)
        f = f.withColumn("label", F.coalesce(F.col("IS_POOR"), F.lit(0)).cast("int"))
        return _write_stage(f, f"{out}/stage/features")

    feat = tm.run("features", features)
    # audit counts gathered during the single write pass (no extra job)
    audit = {"rows_read": obs_read.get["n"], "rows_clean": obs_clean.get["n"]}
    audit["rows_dropped"] = audit["rows_read"] - audit["rows_clean"]

    trained = {"on": False}

    def scored_stage():
        from concurrent.futures import ThreadPoolExecutor

        n_pos = feat.agg(F.sum("label")).first()[0] or 0
        if not (model and n_pos > p.min_positives):
            return _write_stage(score(feat, "index", p), f"{out}/stage/scored")
        trained["on"] = True

        def final_fit():
            m = M.fit_gbt(feat.select(*ML_FEATURE_COLS, "label"), p)
            m.write().overwrite().save(f"{out}/model/gbt_pipeline")

        def oof_scored():
            oof = M.oof_probability(feat, p, keep=list(feat.columns))
            return _write_stage(score(oof.drop("fold"), "given", p), f"{out}/stage/scored")

        if M.fits_at_once(audit["rows_clean"], p.concurrent_fits) <= p.n_folds:
            sc = oof_scored()
            final_fit()
            return sc
        # the full-data fit (saved model) runs alongside the out-of-fold fits
        with ThreadPoolExecutor(max_workers=1) as pool:
            fut = pool.submit(final_fit)
            sc = oof_scored()
            fut.result()
        return sc

    scored = tm.run("model_and_score", scored_stage)

    report = M.model_report(scored, "ML_PROBA", "IS_POOR") if trained["on"] else M.untrained_report(
        feat, M.NOTE_FEW_LABELS if model else M.NOTE_SWITCHED_OFF)
    tm.run("model_report", lambda: K.sink_json_report(report, f"{out}/outputs/model_report"))

    in_order = tm.run("rank", lambda: R.rank_stage(
        R.format_output(scored), R.rank_order("risk_score", ("state_code", "structure_number")),
        "severity_rank", nparts, f"{out}/stage/ranked"))
    ranked = in_order.table()

    tm.run("sink_ranked_csv_gz", lambda: K.sink_csv(ranked, f"{out}/outputs/ranked_csv", gzip=True))
    tm.run("top_critical", lambda: K.sink_csv(R.top_critical(in_order.upto(1000)), f"{out}/outputs/critical_top1000"))
    summary = R.state_summary(scored)
    tm.run("state_summary", lambda: K.sink_csv(R.state_ranking(summary), f"{out}/outputs/state_summary"))
    tm.run("map_subset", lambda: K.stage_parquet(R.map_subset(ranked), f"{out}/stage/map_data"))

    expo = tm.run("exposure", lambda: _write_stage(X.exposure(ranked), f"{out}/stage/exposure"))
    tm.run("exposure_report", lambda: _exposure_report(expo, f"{out}/outputs/exposure_report"))
    tm.run("exposure_top1000", lambda: K.sink_csv(R.top_by_rank(expo, 1000), f"{out}/outputs/top1000_exposure"))
    tm.run("statistics", lambda: K.sink_json_report(S.statistics_record(ranked, summary),
                                                    f"{out}/outputs/statistics"))
    tm.run("score_histogram", lambda: K.sink_json_report(S.score_histogram(ranked), f"{out}/outputs/score_histogram"))
    tm.run("decade_pivot", lambda: K.sink_json_report(S.decade_stack(S.decade_pivot(ranked)),
                                                      f"{out}/outputs/decade_pivot"))
    tm.run("analysis_tables", lambda: _tables(analysis_tables(ranked, summary), f"{out}/outputs/analysis"))
    tm.run("region_tables", lambda: _tables(region_tables(spark, ranked, summary), f"{out}/outputs/regions"))
    tm.run("exposure_tables", lambda: _tables(exposure_tables(expo), f"{out}/outputs/exposure"))
    # the mapped rows lie at the start of the rank order: spread them over all tasks
    tm.run("geojson_layers", lambda: K.sink_geojson(MP.map_properties(expo).repartition(F.col("structure_number")),
                                                   f"{out}/outputs/geojson", MP.DATA_PROPERTIES))
    tm.run("geojson_collections", lambda: K.sink_geojson_collections(
        MP.map_properties(expo), f"{out}/outputs/geojson_collections", MP.DATA_PROPERTIES, "severity_rank"))
    tm.times.update({f"audit.{k}": v for k, v in audit.items()})
    return tm.times


def analysis_tables(out: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """Tables of the analysis step, over the ranked table."""
    aged = out.filter(F.col("bridge_age").between(0, 150))
    return {
        "severity_distribution": S.severity_distribution(out),
        "age_density_by_tier": X.tier_histogram(aged, "bridge_age", "severity", 50),
        "state_at_risk_top": S.state_at_risk_top(summary),
        "condition_distribution": S.condition_distribution(out),
        "age_sample": S.exact_sample(aged, 30000, 42).select(
            "state_code", "structure_number", "bridge_age", "risk_score", "severity"),
        "age_bin_means": S.age_bin_means(aged),
        "traffic_points": S.traffic_points(out),
    }


def region_tables(spark: SparkSession, out: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """Tables of the region step, and the two top-traffic lists."""
    joined = G.region_join(G.region_percentages(summary), G.region_names(spark))
    hidden = G.hidden_risk(out)
    busiest = [F.col("adt").desc_nulls_last(), F.col("state_code"), F.col("structure_number")]
    cols = ["state_code", "structure_number", "facility_carried", "features_intersected", "state_name", "adt",
            "risk_score", "severity", "bridge_condition_category"]
    return {
        "region_percentages": joined,
        "region_scaled_medium": G.metric_scale(joined, "pct_medium_plus"),
        "region_scaled_high": G.metric_scale(joined, "pct_high_plus"),
        "hidden_risk_by_state": G.hidden_risk_by_state(out),
        "hidden_risk_top_traffic": hidden.orderBy(*busiest).limit(10).select(*cols),
        "high_risk_top_traffic": out.filter(F.col("severity").isin("Critical", "High")).orderBy(*busiest).limit(10)
        .select(*cols),
        "external_rank_compare": G.external_rank_compare(summary),
    }


def exposure_tables(expo: DataFrame) -> dict[str, DataFrame]:
    """Tables of the exposure step beside its report."""
    log_p = X.log_label(F.col("p_collapse_1yr"))
    serious = expo.filter(F.col("severity").isin("Critical", "High") & (F.col("rush_hour_persons") > 0))
    return {
        "log_prob_density": X.tier_histogram(expo.select("severity", log_p.alias("v")), "v", "severity", 40),
        "risk_exposure_points": serious.select(
            "state_code", "structure_number", "severity", log_p.alias("log10_p"),
            F.log10(F.greatest("rush_hour_persons", F.lit(0.01))).alias("log10_persons"),
            X.water_class(F.col("severity"), F.col("is_water_crossing")).alias("point_class")),
        "top_expected_fatalities": expo.orderBy(
            F.col("expected_fatalities").desc(), "state_code", "structure_number").limit(20),
        "tier_odds_range": X.tier_odds(expo),
    }


def _tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def _exposure_report(expo: DataFrame, path: str) -> None:
    """Totals, per-tier figures and the nested top-5 records (three small JSON tables)."""
    K.sink_json_report(X.calibration(X.exposure_totals(expo)), f"{path}/totals")
    K.sink_json_report(X.exposure_by_tier(expo), f"{path}/by_tier")
    K.sink_json_report(X.top_records_nested(expo, 5), f"{path}/top5")


def main(argv: list[str] | None = None) -> None:
    """``python -m spanrisk.plans.job --raw inventory.txt --out /shared/out``"""
    import argparse
    import json

    from spanrisk.session import ensure_checkpoint_dir

    ap = argparse.ArgumentParser(description="Inventory risk job: raw delimited inventory in, all tables out.")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--raw", help="delimited inventory file or folder (quote ', header)")
    src.add_argument("--sf-dir", help="folder with the benchmark parquet tables (derived inventory)")
    ap.add_argument("--out", help="output folder (default: under spark.checkpoint.dir)")
    ap.add_argument("--no-model", action="store_true", help="skip the boosted trees (probability = index)")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("spanrisk-job").getOrCreate()
    ensure_checkpoint_dir(spark)
    times = run_job(spark, sf_dir=args.sf_dir, raw_path=args.raw, out_dir=args.out, model=not args.no_model)
    print(json.dumps(times))


if __name__ == "__main__":
    main()
