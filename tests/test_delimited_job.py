"""The job reads a real delimited inventory file the same way as the derived view."""

from pyspark.sql import functions as F

from spanrisk.plans.job import run_job
from spanrisk.session import scratch_path
from spanrisk.sources.inventory import raw_inventory
from tests.conftest import SF_SMALL


def test_job_from_delimited_file_matches_parquet_source(spark):
    csv = scratch_path(spark, "raw-delimited")
    (raw_inventory(spark, SF_SMALL).write.option("header", True).option("quote", "'").option("escape", "'")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(csv))
    a_out, b_out = scratch_path(spark, "job-a"), scratch_path(spark, "job-b")
    ta = run_job(spark, raw_path=csv, out_dir=a_out, model=False)
    tb = run_job(spark, sf_dir=SF_SMALL, out_dir=b_out, model=False)
    assert ta["audit.rows_read"] == tb["audit.rows_read"] == 6000
    assert ta["audit.rows_clean"] == tb["audit.rows_clean"] == spark.read.parquet(f"{b_out}/stage/features").count()
    cols = ["state_code", "structure_number", "risk_score", "severity", "severity_rank"]
    a = spark.read.parquet(f"{a_out}/stage/map_data").select(*cols)
    b = spark.read.parquet(f"{b_out}/stage/map_data").select(*cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # fallback branch without a model: probability equals the index
    sc = spark.read.parquet(f"{a_out}/stage/scored")
    assert sc.filter(F.col("ML_PROBA") != F.col("SDI")).count() == 0
