"""Parquet, CSV and array-like sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_series(spark: SparkSession, path: str, schema: str | T.StructType, null_value: str = "") -> DataFrame:
    """CSV with a header and an explicit schema; no inference pass over the data."""
    return spark.read.csv(path, header=True, schema=schema, nullValue=null_value, mode="PERMISSIVE")


def series_from(spark: SparkSession, values: Sequence[Any], value: str = "x", order: str = "i") -> DataFrame:
    """Array-like to a series (order column, double column); integers and floats are cast to double.

    Meant for small in-memory inputs such as fixtures; large data come from files.
    """
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(order, T.LongType(), False), T.StructField(value, T.DoubleType())]))


def matrix_from(spark: SparkSession, rows: Sequence[Sequence[Any]], value: str = "a", order: str = "row") -> DataFrame:
    """2-D array-like to (row id, array<double>)."""
    data = [(i, [None if v is None else float(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType([T.StructField(order, T.LongType(), False), T.StructField(value, T.ArrayType(T.DoubleType()))]))


def constant_series(spark: SparkSession, n: int, fill: float, value: str = "x", order: str = "i") -> DataFrame:
    """``n`` rows that hold ``fill``."""
    return spark.range(n).select(F.col("id").alias(order), F.lit(float(fill)).alias(value))


def copy(df: DataFrame) -> DataFrame:
    """Identity projection."""
    return df.select("*")


def write_into(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> int:
    """Write ``df`` and return the number of rows, read from the written files' metadata rather than by a second run."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path).count()


