"""Session-level helpers: shared folder, written intermediate tables, whole groups from sorted Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs on one machine (tests) a temporary folder is made and set; on a
    cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may already be gone
            pass
    _written.clear()


atexit.register(_drop_written)


def written_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and lets later passes prune columns. The folder is
    deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = written_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Boolean array: row i starts a new group (row 0 always does). Nulls equal nulls."""
    n = table.num_rows
    starts = np.zeros(n, dtype=bool)
    if n:
        starts[0] = True
    for k in keys:
        col = table.column(k)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
        codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    return starts


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by ``keys`` into tables that hold only whole groups.

    A table has about ``rows`` rows, more only where one group is longer than that; callers bound the
    length of a group by their choice of keys.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        at = np.flatnonzero(key_codes(table, keys))
        last = int(at[-1])
        if last:
            yield table.slice(0, last)
        held, n = table.slice(last).to_batches(), table.num_rows - last
        if n >= rows:  # one long group: look again only once it has doubled
            rows = 2 * n
    if held:
        yield pa.Table.from_batches(held)


def column_numpy(table: pa.Table, name: str, null=np.nan) -> np.ndarray:
    """A column as numpy; nulls become ``null`` (numeric) or None (strings)."""
    col = table.column(name)
    if col.null_count and (pa.types.is_integer(col.type) or pa.types.is_floating(col.type) or pa.types.is_boolean(col.type)):
        col = col.fill_null(pa.scalar(null, type=col.type) if not (pa.types.is_integer(col.type) and isinstance(null, float) and np.isnan(null)) else pa.scalar(0, type=col.type))
    return col.to_numpy()
