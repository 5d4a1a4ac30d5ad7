import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import reduce
from strandline.sources.tables import series_from

NAN = float("nan")


def one(df):
    return df.collect()[0]


def test_reductions(series):
    row = one(reduce.reduce_series(series([1, 2, 3, 4, 5]), "x", ["sum", "mean", "var", "std", "min", "max"]))
    assert tuple(row) == (15, 3, 2, pytest.approx(2**0.5), 1, 5)


def test_nan_and_null_propagate(series):
    for bad in (NAN, None):
        row = one(reduce.reduce_series(series([1, 2, bad, 4]), "x", ["sum", "mean", "var", "min", "max"]))
        assert all(math.isnan(v) for v in row)


def test_variance_of_one_row_is_zero_even_for_nan(series):
    assert one(reduce.reduce_series(series([NAN]), "x", ["var"]))["var"] == 0


def test_unknown_reduction(series):
    with pytest.raises(ValueError):
        reduce.reduce_series(series([1]), "x", ["mode"])


@pytest.mark.parametrize("q, expected", [(0.5, 3), (0.25, 2), (0.75, 4), (0, 1), (1, 5)])
def test_quantiles(series, q, expected):
    assert one(reduce.quantiles_of(series([5, 3, 1, 2, 4]), "x", {"q": q}))["q"] == expected


def test_quantile_interpolates(series):
    assert one(reduce.quantiles_of(series([1, 2, 3, 4, 10]), "x", {"q": 0.3}))["q"] == pytest.approx(2.2)


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 99, 101, 2500, 60_000])
def test_order_statistics_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(2, 1, n), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    got = one(reduce.quantiles_of(df, "x", {"a": 0.01, "b": 0.5, "c": 0.999}))
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(np.quantile(x, [0.01, 0.5, 0.999])))


def test_grouped_quantiles_with_null_key_and_nan(spark):
    rows = [("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0), ("b", NAN), ("b", 1.0)]
    got = {r["g"]: r["median"] for r in reduce.median_of(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert got["a"] == 1.5 and got[None] == 6 and math.isnan(got["b"])


def test_median_of_nothing(spark):
    assert one(reduce.median_of(spark.createDataFrame([], "x double"), "x"))["median"] is None
    assert reduce.median_of(spark.createDataFrame([], "g string, x double"), "x", ["g"]).count() == 0


def test_mad(series):
    assert one(reduce.mad_of(series([1, 2, 3, 4, 5]), "x"))["mad"] == 1


def test_trimmed_and_winsorized(series):
    assert one(reduce.trimmed_mean_of(series([1, 2, 3, 4, 100]), "x", 0.2))[0] == 3
    assert one(reduce.trimmed_mean_of(series([1, 1, 1, 2, 3, 4, 5, 6, 7, 100]), "x", 0.2))[0] == pytest.approx(2.875)  # ties are kept
    assert one(reduce.winsorized_mean_of(series([*range(1, 10), 100]), "x", 0.1))[0] == 5.5


def test_selection(series):
    x = series([9, 7, 8, 1, 3, 3])
    assert [one(reduce.select_kth(x, "x", k))["kth"] for k in range(6)] == [1, 3, 3, 7, 8, 9]
    assert tuple(one(reduce.select_two(x, "x", 1, 4))) == (3, 8)


def test_dense_groups(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 5), (3.0, -1)], "x double, g int")
    rows = reduce.dense_groups(df, "x", "g", 3).orderBy("g").collect()
    assert [r["group_sum"] for r in rows] == [1, 0, 0]
    assert rows[0]["group_mean"] == 1 and math.isnan(rows[1]["group_mean"]) and math.isnan(rows[2]["group_var"])
    df = spark.createDataFrame([(float(v), g) for v, g in zip(range(1, 7), [0, 0, 1, 1, 0, 1])], "x double, g int")
    rows = reduce.dense_groups(df, "x", "g", 2).orderBy("g").collect()
    assert [r["group_mean"] for r in rows] == pytest.approx([8 / 3, 13 / 3])
    assert [r["group_var"] for r in rows] == pytest.approx([26 / 9, 14 / 9])
    bad = spark.createDataFrame([(1.0, 0), (NAN, 1)], "x double, g int")
    assert all(math.isnan(r["group_sum"]) for r in reduce.dense_groups(bad, "x", "g", 2, whole_nan=True).collect())


def test_masked(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (100.0, 0), (4.0, 1), (5.0, 1)], "x double, m int")
    row = one(reduce.masked_reduce(df, "x", "m"))
    assert (row["sum"], row["mean"], row["n_valid"]) == (12, 3, 4) and row["var"] == pytest.approx(10 / 3)
    none = one(reduce.masked_reduce(df.withColumn("m", F.lit(0)), "x", "m"))
    assert math.isnan(none["mean"]) and none["n_valid"] == 0
    df = spark.createDataFrame([(float(i + 1), m) for i, m in enumerate([1, 1, 0, 1, 1, 0, 1, 1, 0, 1])], "x double, m int")
    row = one(reduce.masked_median_mad(df, "x", "m"))
    assert (row["median"], row["mad"]) == (5, 3)


def test_partitioning_does_not_matter(spark):
    random.seed(1)
    rows = [(random.choice("abc"), random.choice([1.0, 2.0, 3.5, 9.0])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    a, b = (sorted(map(tuple, reduce.mad_of(df.repartition(n), "x", ["g"]).collect())) for n in (1, 7))
    assert a == b


def test_extra_columns_do_not_clash(spark):
    df = series_from(spark, [1, 2, 3, 4]).withColumn("n", F.lit("z")).withColumn("_x", F.lit(0)).withColumn("median", F.lit(1))
    assert one(reduce.median_of(df, "x"))["median"] == 2.5
