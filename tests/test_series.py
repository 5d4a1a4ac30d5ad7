import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays, ieee
from strandline.operators import normalize, rolling, scans
from strandline.plans.pipeline import StageError, pipeline
from strandline.sources.tables import matrix_from, series_from, write_into

NAN = float("nan")


def roll(series, values, w, stat, **more):
    return rolling.rolling(series(values), "x", w, ["i"], (), [stat], prefix="", **more)


@pytest.mark.parametrize(
    "stat, w, values, expected",
    [
        ("sum", 3, [1, 2, 3, 4, 5], [1, 3, 6, 9, 12]),
        ("mean", 3, [1, 2, 3, 4, 5], [1, 1.5, 2, 3, 4]),
        ("mean", 3, [1, 2, NAN, 4], [1, 1.5, 1.5, 3]),
        ("mean", 3, [1, 2, None, 4], [1, 1.5, 1.5, 3]),
        ("mean", 10, [1, 2, 3], [1, 1.5, 2]),
        ("median", 3, [1, 2, 100, 4, 5], [None, None, 2, 4, 5]),
        ("median", 4, [1, 2, 3, 4, 5, 6], [None, None, None, 2.5, 3.5, 4.5]),
        ("median_upper", 4, [1, 2, 3, 4, 5, 6], [None, None, None, 3, 4, 5]),
        ("mad", 3, [1, 2, 3, 4, 5, 6, 7], [None, None, 1, 1, 1, 1, 1]),
        ("median", 3, [1, NAN, 3, 4, 5, 6], [None, None, None, None, 4, 5]),
        ("zscore", 5, [1, 2], [None, None]),
    ],
)
def test_rolling(series, column, stat, w, values, expected):
    assert column(roll(series, values, w, stat), stat) == expected


def test_rolling_zscores(series, column):
    z = column(roll(series, [1, 2, 3, 4, 5, 100], 3, "zscore"), "zscore")
    assert z[2:5] == pytest.approx([1.224744871391589] * 3) and abs(z[5]) > 1
    z = column(roll(series, [1, 2, 3, 4, 5, 100], 3, "robust_zscore"), "robust_zscore")
    assert z[2:] == pytest.approx([0.6745, 0.6745, 0.6745, 64.0775])


def test_rolling_masked(spark, column):
    df = spark.createDataFrame([(i, float(v), m) for i, (v, m) in enumerate(zip([1, 2, 999, 4, 5], [1, 1, 0, 1, 1]))], "i int, x double, m int")
    out = rolling.rolling(df, "x", 3, ["i"], (), ["mean_masked"], mask="m", prefix="")
    assert column(out, "mean_masked") == [1, 1.5, 1.5, 3, 4.5]
    with pytest.raises(ValueError):
        rolling.rolling(df, "x", 3, ["i"], (), ["mean_masked"])


def test_rolling_anomalies(series, column):
    flags = column(roll(series, [10, 11, 12, 11, 10.5, 100, 11.5, 12, 10, 11], 5, "anomaly"), "anomaly")
    assert flags[5] and not any(flags[6:]) and not any(flags[:4])


def test_rolling_columns(spark):
    m = matrix_from(spark, [[1, 2], [3, 4], [5, 6], [7, 8]])
    out = rolling.rolling_arrays(m, "a", 2, ["row"], ["mean"], full_only=False)
    got = {(r["row"], r["pos"]): r["rolling_mean"] for r in out.collect()}
    assert [[got[i, j] for j in (0, 1)] for i in range(4)] == [[1, 2], [2, 3], [4, 5], [6, 7]]


def test_rolling_rows(spark):
    df = matrix_from(spark, [[1.0, 2.0, NAN, 4.0], [NAN, NAN, 3.0], []]).withColumn("x", F.lit(1))
    got = [r[0] for r in df.orderBy("row").select(arrays.row_rolling_mean(F.col("a"), 2)).collect()]
    assert got[0] == [1.0, 1.5, 2.0, 4.0] and got[1][2] == 3.0 and all(v != v for v in got[1][:2]) and got[2] == []


def test_strict_mask(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, NAN, 0), (3, 3.0, 1)], "i long, x double, m int")
    out = rolling.rolling(df, "x", 2, ["i"], stats=["mean_masked"], mask="m", strict_mask=True).orderBy("i").collect()
    assert [r["rolling_mean_masked"] for r in out] == [1.0, 1.0, 3.0]
    with pytest.raises(Exception, match="a valid row holds no number"):
        rolling.rolling(df.withColumn("m", F.lit(1)), "x", 2, ["i"], stats=["mean_masked"], mask="m", strict_mask=True).collect()


def test_window_must_be_positive(series):
    with pytest.raises(ValueError):
        roll(series, [1], 0, "sum")


@pytest.mark.parametrize(
    "kind, values, expected",
    [
        ("min", [5, 3, 4, 1, 2], [5, 3, 3, 1, 1]),
        ("min", [5, 3, NAN, 1, 4], [5, 3, 3, 1, 1]),
        ("max", [NAN, 3, 4], [None, None, None]),
        ("sum", [1, 2, 3, 4, 5], [1, 3, 6, 10, 15]),
        ("sum_exclusive", [1, 2, 3], [0, 1, 3]),
        ("fill_forward", [NAN, NAN, 3, NAN, 5], [None, None, 3, 3, 5]),
        ("fill_forward", [1, NAN, NAN, 4, NAN], [1, 1, 1, 4, 4]),
        ("fill_backward", [1, NAN, NAN, 4, NAN], [1, 4, 4, 4, None]),
    ],
)
@pytest.mark.parametrize("whole_rows", [None, 2])
def test_cumulative(series, column, kind, values, expected, whole_rows):
    assert column(scans.cumulative(series(values), "x", ["i"], (), kind, "y", whole_rows), "y") == expected


@pytest.mark.parametrize(
    "kind, k, values, expected",
    [
        ("diff", 1, [1, 3, 6, 10, 15], [None, 2, 3, 4, 5]),
        ("diff", 2, [1, 2, 4, 7, 11], [None, None, 3, 5, 7]),
        ("lag", 2, [1, 2, 3, 4, 5], [None, None, 1, 2, 3]),
        ("pct_change", 1, [100, 110, 99], [None, 0.1, -0.1]),
        ("log_return", 1, [100, 105, 103], [None, math.log(1.05), math.log(103 / 105)]),
    ],
)
def test_lagged(series, column, kind, k, values, expected):
    got = column(scans.lagged(series(values), "x", ["i"], (), kind, k, "y"), "y")
    assert [v is None for v in got] == [v is None for v in expected]
    assert [v for v in got if v is not None] == pytest.approx([v for v in expected if v is not None])


def test_convolution_does_not_flip(series, column):
    assert column(scans.convolve_valid(series([1, 2, 3, 4, 5]), "x", [0.25, 0.5, 0.25], ["i"], (), "y"), "y") == [2, 3, 4]
    assert column(scans.convolve_valid(series([1, 2, 3, 4]), "x", [1, 0, -1], ["i"], (), "y"), "y") == [-2, -2]


def test_exponentially_weighted(series, column):
    ew = scans.exponentially_weighted(series([2, 4, 6, 8]), "x", 0.5, ["i"])
    assert column(ew, "ew_mean") == [2, 3, 4.5, 6.25]
    ew = scans.exponentially_weighted(series([1, 5, 2, 8]), "x", 0.5, ["i"])
    assert column(ew, "ew_var") == pytest.approx([0, 4, 2.25, 8.6875])
    ew = scans.exponentially_weighted(series([1, 2, NAN, 4, 5]), "x", 0.5, ["i"])
    assert column(ew, "ew_mean") == [1, 1.5, None, None, None]
    with pytest.raises(ValueError):
        scans.exponentially_weighted(series([1]), "x", 0, ["i"])


@pytest.mark.parametrize("bad_at", [None, 57])
def test_blocks_give_what_whole_series_give(spark, bad_at):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(v)) for g, n in (("hot", 400), ("b", 30), (None, 5)) for i, v in enumerate(rng.normal(10, 3, n))]
    if bad_at is not None:
        rows[bad_at] = (*rows[bad_at][:2], NAN)
    df = spark.createDataFrame(rows, "g string, i int, x double")

    def results(whole):
        parts = [
            rolling.rolling(df, "x", 9, ["i"], ["g"], ["mean", "median"], whole_rows=whole),
            scans.cumulative(df, "x", ["i"], ["g"], "sum", "s", whole),
            scans.cumulative(df, "x", ["i"], ["g"], "min", "lo", whole),
            scans.cumulative(df, "x", ["i"], ["g"], "fill_backward", "f", whole),
            scans.lagged(df, "x", ["i"], ["g"], "diff", 4, "d", whole),
            scans.exponentially_weighted(df, "x", 0.1, ["i"], ["g"], whole_rows=whole),
        ]
        frames = [p.toPandas().sort_values(["g", "i"], ignore_index=True) for p in parts]
        return pd.concat([frames[0], *[f.drop(columns=["g", "i", "x"]) for f in frames[1:]]], axis=1)

    a, b = results(None), results(150)
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    ewm = a[a.g == "b"].x.ewm(alpha=0.1, adjust=False)
    assert np.allclose(a[a.g == "b"].ew_mean, ewm.mean()) and np.allclose(a[a.g == "b"].ew_var, ewm.var(bias=True))


def test_blocks_shorter_than_the_reach(spark):
    at = [*range(20), *(20 + k / 1000 for k in range(17)), *range(21, 41)]  # a burst, then a block of few rows
    df = spark.createDataFrame([(float(t), float(i * i % 23)) for i, t in enumerate(at)], "t double, x double")

    def results(whole):
        parts = [
            rolling.rolling(df, "x", 9, ["t"], stats=["mean", "median"], whole_rows=whole), scans.lagged(df, "x", ["t"], kind="lag", k=12, out="d", whole_rows=whole),
            scans.convolve_valid(df, "x", [1.0] * 14, ["t"], out="c", whole_rows=whole),
        ]
        return [p.toPandas().sort_values("t", ignore_index=True) for p in parts]

    for a, b in zip(results(None), results(8)):
        pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)


def test_normalisation(series, column):
    assert column(normalize.zscore(series([1, 2, 3, 4, 5]), "x", (), "z"), "z") == pytest.approx([-(2**0.5), -(0.5**0.5), 0, 0.5**0.5, 2**0.5])
    assert column(normalize.zscore(series([4, 4]), "x", (), "z"), "z") == [0, 0]
    assert column(normalize.normalize_minmax(series([1, 2, 3, 4, 5]), "x", ["i"], (), "y"), "y") == [0, 0.25, 0.5, 0.75, 1]
    assert column(normalize.normalize_minmax(series([7, 7]), "x", ["i"], (), "y"), "y") == [0.5, 0.5]
    assert column(normalize.normalize_minmax(series([NAN, 1, 2]), "x", ["i"], (), "y"), "y") == [0.5, 0.5, 0.5]
    assert column(normalize.winsorize(series(range(11)), "x", 0.1, 0.9, (), "y"), "y") == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]


def test_anomalies(series, column):
    assert column(normalize.detect_anomalies(series([10] * 100 + [10000]), "x", 3), "anomaly") == [False] * 100 + [True]
    assert column(normalize.detect_anomalies(series([1, NAN, 1000]), "x", 0.1), "anomaly") == [False] * 3
    assert column(normalize.detect_anomalies_robust(series([1] * 9 + [1000]), "x", 3), "anomaly") == [False] * 9 + [True]
    assert column(normalize.detect_anomalies_robust(series([42] * 5), "x", 3), "anomaly") == [False] * 5
    flags = column(normalize.detect_anomalies_robust(series([10, 12, 11, 13, 100, 12, 11.5, -50, 12.5]), "x", 3), "anomaly")
    assert flags[4] and flags[7] and not flags[0] and not flags[1]


def test_remove_outliers(series):
    kept, _ = normalize.remove_outliers(series([10, 12, 11, 100, 13, -50, 12.5, NAN]), "x", 3, 10)
    assert sorted(r["x"] for r in kept.collect()) == [10, 11, 12, 12.5, 13]
    kept, rounds = normalize.remove_outliers(series([10, 11, 12, 13, 14]), "x", 3, 10)
    assert kept.count() == 5 and rounds == 1


def test_rows_of_a_matrix(spark):
    m = matrix_from(spark, [[1, 2, 3], [4, 5, 6], [1, NAN, 3], [1, 2, 100]])
    a = F.col("a")
    rows = m.select("row", arrays.row_sum(a).alias("s"), arrays.row_mean(a).alias("m"), arrays.row_median(a).alias("md"), arrays.row_mad(a).alias("ad"), arrays.row_min(a).alias("lo"), arrays.row_quantile(a, 0.25).alias("q")).orderBy("row").collect()
    assert [tuple(r)[1:] for r in rows[:2]] == [(6, 2, 2, 1, 1, 1.5), (15, 5, 5, 1, 4, 4.5)]
    assert all(math.isnan(v) for v in tuple(rows[2])[1:])
    flags = matrix_from(spark, [[1, 2, 3, 100], [4, 5, 6, 7], [5, 5, 5, 5]]).select("row", arrays.row_anomalies_robust(a, 3.5).alias("r"), arrays.row_anomalies(a, 1.5).alias("p"), arrays.row_anomalies_sample(a, 1.4).alias("s")).orderBy("row").collect()
    assert [list(r["r"]) for r in flags] == [[False, False, False, True], [False] * 4, [False] * 4]
    assert list(flags[0]["p"]) == [False, False, False, True] and list(flags[0]["s"]) == [False, False, False, True]


def test_columns_of_a_matrix(spark):
    rows = {r["pos"]: r for r in arrays.column_reduce(matrix_from(spark, [[1, NAN], [3, 4]]), "a").collect()}
    assert (rows[0]["sum"], rows[0]["mean"], rows[0]["min"], rows[0]["max"]) == (4, 2, 1, 3)
    assert math.isnan(rows[1]["min"]) and math.isnan(rows[1]["sum"])


def test_elementwise(spark, column):
    df = spark.createDataFrame([(0, -1.0, 1), (1, NAN, 0), (2, None, None), (3, 9.0, 2)], "i int, x double, m int")
    x = F.col("x")
    assert column(df.withColumn("y", ieee.clip(x, 0, 5)), "y") == [0, None, None, 5]
    assert column(df.withColumn("y", ieee.fill_missing(x, -1, 7)), "y") == [7, None, None, 9]
    assert column(df.withColumn("y", ieee.fill_missing(x, -1, 7, nan_too=True)), "y") == [7, 7, 7, 9]
    assert column(df.withColumn("y", ieee.where(F.col("m"), F.lit(1.0), F.lit(0.0))), "y") == [1, 0, 0, 1]
    row = spark.range(1).select(*[ieee.ieee_div(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0))], ieee.ieee_ln(F.lit(-1.0)), ieee.ieee_ln(F.lit(0.0))).collect()[0]
    assert row[0] == math.inf and row[1] == -math.inf and math.isnan(row[2]) and row[3] == -math.inf and math.isnan(row[4]) and row[5] == -math.inf
    with pytest.raises(ValueError):
        ieee.clip(x, 2, 1)


@pytest.mark.parametrize(
    "p, values, expected",
    [
        (pipeline(), [1, 2], [1, 2]),
        (pipeline().scale(2).shift(5), [1, 2, 3], [7, 9, 11]),
        (pipeline().fill_forward().abs(), [1, NAN, -3, NAN, NAN, -6], [1, 1, 3, 3, 3, 6]),
        (pipeline().log_return().ewvar(0.1).sqrt(), [100, 102, 101], [0, None, None]),
        (pipeline().convolve([0.25, 0.5, 0.25]).lag(1), [1, 2, 3, 4, 5], [None, 2, 3]),
        (pipeline().diff(1).clip(-1, 1).prefix_sum(), [0, 5, 4, 4], [None, None, None, None]),
        (pipeline().cumulative_max().rolling_mean(2), [1, 3, 2], [1, 2, 3]),
    ],
)
def test_pipelines(series, column, p, values, expected):
    got = column(p.execute(series(values), "x", ["i"]), "x")
    assert got == [v if v is None else pytest.approx(v) for v in expected]


def test_log_return_keeps_its_first_nan_in_the_variance(series):
    out = pipeline().log_return().ewvar(0.1).execute(series([100, 102, 101]), "x", ["i"]).orderBy("i").collect()
    assert [math.isnan(r["x"]) for r in out] == [False, True, True]


def test_pipeline_errors_and_summary(spark, series, tmp_path):
    with pytest.raises(ValueError):
        pipeline().rolling_mean(0)
    with pytest.raises(ValueError):
        pipeline("turbo")
    bad = pipeline().map(lambda x: ieee.clip(x, 2, 1))
    with pytest.raises(StageError, match=r"stage 0 \(map\)"):
        bad.execute(series([1]), "x", ["i"])
    assert "1: ewma(alpha=0.2)" in pipeline().diff(1).ewma(0.2).summary()
    assert pipeline().scale(2).execute_into(series([1, 2, 3]), str(tmp_path / "out"), "x", ["i"]) == 3
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4, 6]
    assert write_into(series_from(spark, [1]), str(tmp_path / "csv"), "csv") == 1


@pytest.mark.parametrize("w", [1, 4, 5, 30])
def test_rolling_medians_across_batches(spark, w):
    rng = np.random.default_rng(w)
    rows = [(s, i, None if s == "b" and i == 9 else float(v)) for s, n in (("a", 40), ("b", 23), ("c", 3), (None, 31)) for i, v in enumerate(np.append(rng.normal(size=n - 2).round(1), [NAN, 1.0]))]
    df = spark.createDataFrame(rows, "s string, i int, x double")
    stats = ["median", "mad", "median_upper", "mad_upper", "robust_zscore", "anomaly", "mean"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["s"], r["i"]): r for r in rolling.rolling(df, "x", w, ["i"], ["s"], stats, prefix="").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    x = {(s, i): NAN if v is None else v for s, i, v in rows}
    for (s, i), r in got.items():
        v = np.array([x[s, j] for j in range(max(i - w + 1, 0), i + 1)])
        want = dict.fromkeys(stats[:5], NAN) | {"anomaly": False, "mean": NAN if np.isnan(v).all() else np.nanmean(v)}
        if len(v) == w and not np.isnan(v).any():
            med, up = np.median(v), np.sort(v)[w // 2]
            mad = np.median(np.abs(v - med))
            want |= {"median": med, "mad": mad if mad >= 1e-12 else 0.0, "median_upper": up, "mad_upper": np.sort(np.abs(v - up))[w // 2]}
            want |= {"robust_zscore": 0.6745 * (v[-1] - med) / mad if mad > 1e-10 else 0.0, "anomaly": bool(mad >= 1e-12 and abs(v[-1] - med) > 3 * 1.4826 * mad)}
        for k in stats:
            assert r[k] == pytest.approx(want[k], nan_ok=True), (s, i, k)


def test_robust_zscore_works_windows_out_once(spark):
    """The stage reads its rows many times; medians and MADs of windows must not be worked out by each pass, nor by nested sorts."""
    x = np.random.default_rng(3).normal(size=80)
    df = series_from(spark, x)
    out = pipeline().rolling_mad(10).map(lambda c: F.nanvl(c, F.lit(0.0))).robust_zscore().execute(df, "x", ["i"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in rolling.rolling(df, "x", 10, ["i"], (), ["median", "mad"])._jdf.queryExecution().optimizedPlan().toString()
    mads = np.array([np.median(np.abs(v - np.median(v))) for v in np.lib.stride_tricks.sliding_window_view(x, 10)])
    y = np.append(np.zeros(9), mads)
    want = (y - np.median(y)) / (1.4826 * np.median(np.abs(y - np.median(y))))
    assert [r["x"] for r in sorted(out.collect(), key=lambda r: r["i"])] == pytest.approx(list(want))
