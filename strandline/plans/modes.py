"""Execution modes, session facts and tuning shims."""

from __future__ import annotations

import contextvars
import json
from pathlib import Path

import pyspark
from pyspark.sql import SparkSession

MODES = ("safe", "fast", "deterministic")
_mode: contextvars.ContextVar[str] = contextvars.ContextVar("mode", default="safe")

#: Settings that tuning saves and restores.
TUNED = (
    "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
    "spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch",
)


def set_mode(mode: str) -> None:
    """All modes give the same results here: plans never skip the NaN rules, and Spark picks the physical strategy."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    _mode.set(mode)


def get_mode() -> str:
    return _mode.get()


class Workspace:
    """Scratch memory is Spark's own; this only keeps the size asked for."""

    def __init__(self, size: int = 0) -> None:
        if size < 0:
            raise ValueError("size must not be negative")
        self.size = size

    def reserve(self, size: int) -> None:
        self.size = max(self.size, size)


def build_features(spark: SparkSession) -> dict[str, str]:
    """Versions and what the session can use."""
    conf = spark.sparkContext.getConf()
    return {
        "spark": pyspark.__version__, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism),
        "codegen": spark.conf.get("spark.sql.codegen.wholeStage", "true"), "adaptive": spark.conf.get("spark.sql.adaptive.enabled", "true"), "executor_memory": conf.get("spark.executor.memory", "default"),
    }


def calibrate(spark: SparkSession, input_bytes: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings for an input of a given size: partitions that fit in memory, adaptive execution on."""
    parts = max(spark.sparkContext.defaultParallelism, -(-input_bytes // partition_bytes))
    chosen = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": "true", "spark.sql.files.maxPartitionBytes": str(partition_bytes)}
    for k, v in chosen.items():
        spark.conf.set(k, v)
    return chosen


def save_settings(spark: SparkSession, path: str) -> dict[str, str]:
    found = {k: v for k in TUNED if (v := spark.conf.get(k, None)) is not None}
    Path(path).write_text(json.dumps(found, indent=1))
    return found


def load_settings(spark: SparkSession, path: str) -> dict[str, str]:
    found = json.loads(Path(path).read_text())
    if unknown := set(found) - set(TUNED):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    for k, v in found.items():
        spark.conf.set(k, v)
    return found
