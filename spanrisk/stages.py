"""Register of staged tables, known by what they were made from.

A stage is written once per session for one state of its inputs: the register keeps a mark of the input files (their
names, lengths and times) and of the parameters beside the folder, and compares it on every use, so a changed input gives
new rows. A table read from a stage is lazy and Spark does not say when the last one is gone, so a stage that was
replaced stays until its successor is replaced too; ``drop_stages`` deletes all of a session's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrisk.session import STORED, compile_small_methods, drop_path, path_exists, scratch_path


@dataclass
class Stage:
    """``held``: what the builder returned beside the written folder."""

    mark: tuple
    path: str
    held: object


_CURRENT: dict[tuple, Stage] = {}
_REPLACED: dict[tuple, str] = {}


def input_mark(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Names, lengths and times of the files under ``paths``: of a file itself, of a folder added up by a Spark job that
    reads the listing alone, so that any number of files makes one row."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(conf).getFileStatus(at)
        if status.isFile():
            marks.append((path, status.getLen(), status.getModificationTime()))
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        marks.append((path, *files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(each)).first()))
    return tuple(marks)


def _key(spark: SparkSession, name: str, inputs: Sequence[str], parameters: object) -> tuple:
    return id(spark.sparkContext._jsc), name, tuple(inputs), repr(parameters)


def _is_current(spark: SparkSession, found: Stage | None, mark: tuple) -> bool:
    return bool(found and found.mark == mark and path_exists(spark, f"{found.path}/_SUCCESS"))


def has_stage(spark: SparkSession, name: str, inputs: Sequence[str], parameters: object = None) -> bool:
    """Whether there is such a stage for the inputs as they are now."""
    found = _CURRENT.get(_key(spark, name, inputs, parameters))
    return found is not None and _is_current(spark, found, input_mark(spark, inputs))


def stage(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[str], object],
          parameters: object = None) -> Stage:
    """The stage ``name`` of these inputs and parameters, written by ``build(path)`` if there is none yet."""
    compile_small_methods(spark)
    key = _key(spark, name, inputs, parameters)
    mark = input_mark(spark, inputs)
    found = _CURRENT.get(key)
    if _is_current(spark, found, mark):
        return found
    path = scratch_path(spark, name)
    made = Stage(mark, path, build(path))
    if found:
        if key in _REPLACED:
            drop_path(spark, _REPLACED[key])
        _REPLACED[key] = found.path
    _CURRENT[key] = made
    return made


def staged_table(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame],
                 parameters: object = None) -> DataFrame:
    """The table ``build()`` as a stage."""
    made = stage(spark, name, inputs, lambda path: build().write.option("compression", STORED).parquet(path), parameters)
    return spark.read.parquet(made.path)


def forget_stages() -> None:
    """Build every stage anew on its next use; the folders stay."""
    _CURRENT.clear()
    _REPLACED.clear()


def drop_stages(spark: SparkSession) -> None:
    """Delete the stages of this session."""
    mine = id(spark.sparkContext._jsc)
    for known in (_CURRENT, _REPLACED):
        for key in [k for k in known if k[0] == mine]:
            gone = known.pop(key)
            drop_path(spark, gone if isinstance(gone, str) else gone.path)
