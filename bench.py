"""Benchmark: the full batch job plus the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_MODEL (1 = train the boosted trees as the published pipeline does).
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def stage_metrics(event_dir: str) -> dict:
    """Task-level summary from Spark's event log: the worst straggler ratio
    (max / median task time) over stages with at least 8 tasks of which one runs
    for at least 0.5 s, plus shuffle and spill volume."""
    import glob
    import statistics

    stages: dict[int, list[int]] = {}
    shuffle_w = spill = 0
    files = [f for f in glob.glob(os.path.join(event_dir, "**", "*"), recursive=True) if os.path.isfile(f)]
    for path in files:
        if path.endswith((".crc", ".inprogress.crc")):
            continue
        with open(path, errors="replace") as fh:
            for line in fh:
                if '"SparkListenerTaskEnd"' not in line:
                    continue
                ev = json.loads(line)
                info, m = ev.get("Task Info", {}), ev.get("Task Metrics") or {}
                stages.setdefault(ev["Stage ID"], []).append(info.get("Finish Time", 0) - info.get("Launch Time", 0))
                shuffle_w += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                spill += m.get("Disk Bytes Spilled", 0)
    # stragglers matter only where tasks are long enough to matter (>= 0.5 s)
    ratios = [max(t) / max(statistics.median(t), 1) for t in stages.values() if len(t) >= 8 and max(t) >= 500]
    return {"stages": len(stages), "tasks": sum(len(t) for t in stages.values()),
            "max_straggler_ratio": round(max(ratios), 2) if ratios else None,
            "shuffle_write_mb": round(shuffle_w / 2**20, 1), "disk_spill_mb": round(spill / 2**20, 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with_model = os.environ.get("BENCH_MODEL", "1") == "1"

    from spanrisk.plans import pipeline as P
    from spanrisk.plans.catalog import load_all
    from spanrisk.plans.job import run_job
    from spanrisk.session import get_spark

    import tempfile

    event_dir = tempfile.mkdtemp(prefix="spanrisk-bench-events-", dir="/tmp")
    spark = get_spark(app="spanrisk-bench", cores=cpus, event_log_dir=event_dir)
    t0 = time.perf_counter()
    stages = run_job(spark, sf_dir=sf_dir, model=with_model)
    job_sec = time.perf_counter() - t0

    # headline registered queries (proxy probability, staged inputs built on first use)
    P.reset_stages()
    reg = load_all()
    headline = ["state_summary", "format_output", "top_critical", "exposure_totals", "exposure_by_tier",
                "stats_age", "score_histogram", "decade_pivot", "hidden_risk_top_traffic", "roc_auc",
                "component_agreement", "external_rank_compare"]
    qtimes = {}
    for name in headline:
        t = time.perf_counter()
        reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        qtimes[name] = round(time.perf_counter() - t, 3)
    q_sec = sum(qtimes.values())

    spark.stop()  # flushes the event log
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "full_pipeline_sec",
        "value": round(job_sec, 3),
        "unit": "sec",
        "queries": {**{f"job.{k}": v for k, v in stages.items() if not k.startswith("audit.")},
                    **{f"q.{k}": v for k, v in qtimes.items()}},
        "rows": {k[len("audit."):]: v for k, v in stages.items() if k.startswith("audit.")},
        "headline_queries_sec": round(q_sec, 3),
        "model": with_model,
        "cpus": cpus,
        "sf": sf,
        "task_metrics": stage_metrics(event_dir),
    }))


if __name__ == "__main__":
    main()
