"""Row-wise operators on array columns (a matrix row is an array) and column-wise ones over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.ieee import NAN, beyond, ieee_div, let, median_of_sorted, to_nan, type7_of_sorted


def doubles(a: Column) -> Column:
    """Array of doubles, NaN for null elements."""
    return F.transform(a, lambda v: to_nan(v))


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda v: F.isnan(v))


def _guard(a: Column, result: Column) -> Column:
    return F.when(has_nan(a) | (F.size(a) <= 0), F.lit(NAN)).otherwise(result)


def row_sum(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, v: s + v)


def row_mean(a: Column) -> Column:
    return ieee_div(row_sum(a), F.size(a).cast("double"))


def row_min(a: Column) -> Column:
    x = doubles(a)
    return _guard(x, F.array_min(x))


def row_max(a: Column) -> Column:
    x = doubles(a)
    return _guard(x, F.array_max(x))


def _median(x: Column) -> Column:
    return let(F.sort_array(x), median_of_sorted)


def _mad(x: Column) -> Column:
    return let(_median(x), lambda m: _median(F.transform(x, lambda v: F.abs(v - m))))


def row_median(a: Column) -> Column:
    return let(doubles(a), lambda x: _guard(x, _median(x)))


def row_mad(a: Column) -> Column:
    return let(doubles(a), lambda x: _guard(x, _mad(x)))


def row_quantile(a: Column, q: float) -> Column:
    return let(doubles(a), lambda x: _guard(x, let(F.sort_array(x), lambda s: type7_of_sorted(s, q))))


def row_robust_zscore(a: Column, scale: float = 1.4826) -> Column:
    """(v - median) / (scale MAD) of each element; NaN in the row gives NaN throughout."""
    return let(F.struct(row_median(a).alias("m"), (row_mad(a) * scale).alias("d")), lambda s: F.transform(doubles(a), lambda v: ieee_div(v - s["m"], s["d"])))


def row_moments(a: Column, sample: bool = False, skip_nan: bool = False) -> Column:
    """Struct of mean, standard deviation and number of the elements that count."""

    def body(x: Column) -> Column:
        n = F.size(x).cast("double")
        mean = ieee_div(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), n)
        std = let(mean, lambda m: F.sqrt(ieee_div(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)), n - 1 if sample else n)))
        return F.struct(mean.alias("mean"), std.alias("std"), n.alias("n"))

    x = doubles(a)
    return let(F.filter(x, lambda v: ~F.isnan(v)) if skip_nan else x, body)


def _flags(a: Column, moments: Column, threshold: float) -> Column:
    return let(moments, lambda s: F.transform(doubles(a), lambda v: (s["n"] >= 2) & (s["std"] > 0) & ~F.isnan(s["std"]) & beyond(ieee_div(v - s["mean"], s["std"]), threshold)))


def row_anomalies(a: Column, threshold: float = 3.0) -> Column:
    """Flags |v - mean| > threshold std (population) of the row; NaN in the row flags nothing."""
    return _flags(a, row_moments(a), threshold)


def row_anomalies_sample(a: Column, threshold: float = 3.0) -> Column:
    """The same with the sample standard deviation of the elements that are not NaN."""
    return _flags(a, row_moments(a, sample=True, skip_nan=True), threshold)


def row_anomalies_robust(a: Column, threshold: float = 3.5, scale: float = 1.4826) -> Column:
    """Flags |v - median| > threshold scale MAD; a MAD of zero flags every other value."""
    return F.transform(row_robust_zscore(a, scale), lambda z: beyond(z, threshold))


def row_rolling_mean(a: Column, window: int) -> Column:
    """Means along each row over the last ``window`` positions, shorter at the start; NaN is skipped, NaN where nothing is left."""
    if window < 1:
        raise ValueError("window must be at least 1")

    def mean(x: Column, i: Column) -> Column:
        near = F.filter(F.slice(x, F.greatest(i - (window - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(window))), lambda v: ~F.isnan(v))
        return F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(near), F.lit(0))

    return let(doubles(a), lambda x: F.transform(x, lambda v, i: F.coalesce(mean(x, i), F.lit(NAN))))


def column_reduce(df: DataFrame, array: str) -> DataFrame:
    """Per array position over all rows: ``pos``, ``sum``, ``mean``, ``min``, ``max``; NaN in a column gives NaN.

    Positions are aggregated where the rows are; one partial row per position and task is shuffled.
    """
    x = F.col("x")
    long = df.select(F.posexplode(doubles(F.col(array))).alias("pos", "x"))
    bad = F.max(F.isnan(x))
    return long.groupBy("pos").agg(F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.when(bad, F.lit(NAN)).otherwise(F.min(x)).alias("min"), F.max(x).alias("max"))
