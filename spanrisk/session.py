"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(app: str = "spanrisk", cores: int | str | None = None,
              shuffle_partitions: int | None = None, driver_memory: str = "16g",
              event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and the benchmark; a cluster supplies its own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    sp = shuffle_partitions or (8 if cores == "*" else int(cores))
    builder = SparkSession.builder
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
                   .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false"))
    spark = (builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(sp))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", driver_memory)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when unset in a local session
    (tests) fall back to a fresh scratch folder. Off ``local[...]`` an unset folder is an
    error: executors do not share a machine-local one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a shared folder: the master is {sc.master}")
    local = tempfile.mkdtemp(prefix="spanrisk-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return local


#: Compression of tables that are stored between steps: they are wide, and what limits them is their volume.
STORED = "zstd"

#: Bytes of a method above which HotSpot leaves it to the interpreter.
JIT_LIMIT = 8000


def compile_small_methods(spark: SparkSession) -> None:
    """Let Spark cut generated methods that HotSpot would not compile (a wide projection is one method, at 10 times the
    time or more) into small ones. Spark's own bound is that of the class file; a lower one is kept."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > JIT_LIMIT:
        spark.conf.set(name, str(JIT_LIMIT))


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh output folder under the shared checkpoint directory."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete at the end every scratch folder that was made inside. Results read from such folders are lazy, so they are
    to be written or collected inside; what outlives the block is not to be made in it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_path(spark, path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)
