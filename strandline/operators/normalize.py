"""Normalisation, winsorising, and global anomaly flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.ieee import beyond, ieee_div, to_nan, to_null
from strandline.operators.reduce import mad_of, mean_of, quantiles_of, std_of, with_statistics
from strandline.runtime import materialize


def zscore(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "zscore") -> DataFrame:
    """(x - mean) / population std; 0 where the std is 0; NaN in a group gives NaN throughout.

    The statistics of a group are aggregated and joined back, so the rows are neither sorted nor gathered.
    """
    x = F.col(value)
    stats = df.groupBy(*by).agg(mean_of(x).alias("_mean"), std_of(x).alias("_std"))
    z = F.when(F.col("_std") == 0, 0.0).otherwise(ieee_div(to_nan(x) - F.col("_mean"), F.col("_std")))
    return with_statistics(df, stats, by).withColumn(out, z).drop("_mean", "_std")


def robust_zscore(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "robust_zscore") -> DataFrame:
    """(x - median) / (1.4826 MAD), by IEEE division: a MAD of 0 gives infinities, NaN for the median itself."""
    stats = mad_of(df, value, by).withColumnsRenamed({"median": "_median", "mad": "_mad"})
    z = ieee_div(to_nan(F.col(value)) - F.col("_median"), F.col("_mad") * 1.4826)
    return with_statistics(df, stats, by).withColumn(out, z).drop("_median", "_mad")


def normalize_minmax(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), out: str = "minmax") -> DataFrame:
    """(x - min) / (max - min), NaN skipped for both; 0.5 for a constant series and for one that begins with NaN."""
    x, xn = to_nan(F.col(value)), to_null(F.col(value))
    stats = df.groupBy(*by).agg(F.min(xn).alias("_lo"), F.max(xn).alias("_hi"), F.min_by(F.isnan(x), F.struct(*order)).alias("_head"))
    scaled = F.when(F.col("_head") | (F.col("_lo") == F.col("_hi")), 0.5).otherwise(ieee_div(x - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return with_statistics(df, stats, by).withColumn(out, scaled).drop("_lo", "_hi", "_head")


def winsorize(df: DataFrame, value: str, q_lo: float, q_hi: float, by: Sequence[str] = (), out: str = "winsorized") -> DataFrame:
    """Clamp to two quantiles of the group; NaN stays."""
    if not 0 <= q_lo <= q_hi <= 1:
        raise ValueError("quantiles must rise within 0..1")
    stats = quantiles_of(df, value, {"_lo": q_lo, "_hi": q_hi}, by)
    x = to_nan(F.col(value))
    return with_statistics(df, stats, by).withColumn(out, F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.col("_lo")), F.col("_hi")))).drop("_lo", "_hi")


def detect_anomalies(df: DataFrame, value: str, threshold: float = 3.0, by: Sequence[str] = (), out: str = "anomaly") -> DataFrame:
    """|x - mean| > threshold std (population); none where the std is 0 or NaN or the group has one row."""
    x = F.col(value)
    stats = df.groupBy(*by).agg(mean_of(x).alias("_mean"), std_of(x).alias("_std"), F.count(F.lit(1)).alias("_n"))
    flag = (F.col("_n") >= 2) & (F.col("_std") > 0) & ~F.isnan("_std") & beyond(ieee_div(to_nan(x) - F.col("_mean"), F.col("_std")), threshold)
    return with_statistics(df, stats, by).withColumn(out, F.coalesce(flag, F.lit(False))).drop("_mean", "_std", "_n")


def detect_anomalies_robust(df: DataFrame, value: str, threshold: float = 3.0, by: Sequence[str] = (), out: str = "anomaly") -> DataFrame:
    """|x - median| > threshold 1.4826 MAD; a MAD of 0 flags every other value than the median."""
    z = robust_zscore(df, value, by, "_z")
    return z.withColumn(out, beyond(F.col("_z"), threshold)).drop("_z")


def remove_outliers(df: DataFrame, value: str, threshold: float = 3.0, max_rounds: int = 10, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Drop robust outliers and NaN round by round until none is left: the cleaned rows and the rounds run.

    Rounds narrow an interval per group that the rows are filtered by, so lineage does not grow: each round aggregates
    median and MAD of the rows inside, and only that small table is written out.
    """
    if max_rounds < 1:
        raise ValueError("max_rounds must be at least 1")
    by = list(by)
    rows = df.where(to_null(F.col(value)).isNotNull())
    bounds, rounds = None, 0

    def inside(bounds: DataFrame | None) -> DataFrame:
        if bounds is None:
            return rows
        joined = with_statistics(rows, bounds, by)
        return joined.where(F.col(value).cast("double").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")

    for _ in range(max_rounds):
        rounds += 1
        kept = inside(bounds)
        stats = mad_of(kept, value, by)
        reach = F.lit(threshold * 1.4826) * F.col("mad")
        new = stats.select(*by, (F.col("median") - reach).alias("_lo"), (F.col("median") + reach).alias("_hi"))
        if bounds is not None:  # an interval never widens
            old = bounds.withColumnsRenamed({"_lo": "_lo0", "_hi": "_hi0"})
            new = with_statistics(new, old, by).select(*by, F.greatest("_lo", "_lo0").alias("_lo"), F.least("_hi", "_hi0").alias("_hi"))
        new = materialize(new, "bounds")
        lost = with_statistics(kept, new, by).where(~F.col(value).cast("double").between(F.col("_lo"), F.col("_hi"))).limit(1).count()
        bounds = new
        if not lost:
            break
    return inside(bounds), rounds


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """SQL view of results: null in place of NaN."""
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in columns})


