"""Shared helpers: table access, scratch tables on shared storage, and Arrow slices for NumPy kernels."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of UTF-8 text that a NumPy kernel works on at once; longer single texts are taken whole.
SLICE_BYTES = (1 << 19) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="sheaf-scratch-")


def _tables(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/sheaf-llm/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once the results that read them are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more, and the shuffle files of finished jobs.

    Spark deletes the shuffle files of a plan when the driver has collected it as garbage, which is asked for here.
    """
    spark = SparkSession.active()
    for table_ in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def doc_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text`` and ``_h`` (a text hash that tells rows with one id apart), whatever else ``docs`` holds."""
    return docs.select(
        docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"), F.hash(docs[text_col]).alias("_h")
    )


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on (``_id``, ``_h``), null ids included."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; a null has no bytes."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.empty(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) for runs of rows with about ``limit`` bytes."""
    offsets, data = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def list_column(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row ends (one more than rows)."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, type=kind))
