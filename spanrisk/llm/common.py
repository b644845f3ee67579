"""Helpers shared by the training-data operators: table access, staged intermediates, Arrow batch maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spanrisk.session import scratch_path

#: Text bytes that one step of a Python task holds at once (a longer text is held alone).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table, narrowed to ``cols`` so that only those reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage ends there, an executor that is
    lost later loses nothing, and readers prune columns. Returns the frame and its folder, for ``release``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete staged folders that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges whose ``column`` holds at most ``limit`` bytes (one row may exceed it)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of every row; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def with_text_columns(df: DataFrame, column: str, fields: list[T.StructField],
                      make: Callable[[], Callable[[list[bytes]], dict[str, object]]]) -> DataFrame:
    """Append ``fields`` computed from the text ``column``, in Arrow batches, without a shuffle.

    ``make()`` runs once in each task and returns the function applied to every slice of texts; it returns one
    sequence per field. An input column of the same name as a new field is replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {f.name for f in fields}
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column):
                new = step(texts_of(part, column))
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(part.num_columns)]
                cols += [pa.array(new[f.name], type=arrow.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return kept.mapInArrow(run, schema)
