"""Queries of the series and matrix operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import arrays, ieee
from strandline.operators import normalize, reduce, rolling, scans
from strandline.plans.pipeline import pipeline
from strandline.runtime import written_path
from strandline.sources.tables import constant_series, copy, csv_series, table, write_into

ORDER, SERIES, W = ("ts", "event_id"), ("event_type",), 50
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a query and its SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def rnd(c: Column | str, k: int = 6) -> Column:
    """Rounded, with null for NaN; a shade above the decimal ties, as in the SQL."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(F.when(~F.isnan(x), x) + 1e-10, k)


def r(expr: str, name: str, k: int = 6) -> str:
    return f"round({expr} + 1e-10, {k}) as {name}"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a value column ``x`` that is NaN in every 17th row, and a mask."""
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return e.withColumn("x", F.when(F.col("event_id") % 17 == 0, F.lit(ieee.NAN)).otherwise(F.col("value"))).withColumn("mask", (F.col("event_id") % 3 != 0).cast("int"))


EV = "with ev as (select event_id, ts, event_type, value, case when event_id % 17 = 0 then null else value end as x, event_id % 3 <> 0 as mask from events)"
OVER = "(partition by event_type order by ts, event_id rows between 49 preceding and current row)"
RUN = "(partition by event_type order by ts, event_id rows between unbounded preceding and current row)"
SER = "(partition by event_type order by ts, event_id)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


MX = "with m as (select vec_id, cast(embedding as double[]) as a from embeddings)"


# sources, projections --------------------------------------------------------------------------------------------


@query("select * from nation")
def scan_copy(spark, d):
    return copy(table(spark, d, "nation"))


@query("select range as i, 7.5::double as x from range((select count(*) from customer))")
def constant_source(spark, d):
    return constant_series(spark, table(spark, d, "customer").count(), 7.5)


@query(EV + " select event_id, case when mask then value else -1.0 end as y from ev")
def where_select(spark, d):
    return events(spark, d).select("event_id", ieee.where(F.col("mask"), F.col("value"), F.lit(-1.0)).alias("y"))


@query(EV + " select event_id, coalesce(case when mask then x else -999.0 end, 0.0) as before, case when not mask or x is null then 0.0 else x end as y from ev")
def fill_sentinel(spark, d):
    e = events(spark, d).withColumn("s", F.when(F.col("mask") == 1, F.col("x")).otherwise(-999.0))
    return e.select("event_id", F.nanvl("s", F.lit(0.0)).alias("before"), ieee.fill_missing(F.col("s"), -999.0, 0.0, nan_too=True).alias("y"))


@query(EV + " select event_id, case when x is not null then least(greatest(x, 50.0), 200.0) end as y from ev")
def clip_values(spark, d):
    return events(spark, d).select("event_id", rnd(ieee.clip(F.col("x"), 50, 200), 9).alias("y"))


@query(EV + f" select event_id, {r('x * 2.5 + 3', 'y')} from ev")
def scale_shift(spark, d):
    return pipeline().scale(2.5).shift(3).execute(events(spark, d), "x", ORDER, SERIES, "y").select("event_id", rnd("y").alias("y"))


@query(EV + f" select event_id, {r('abs(x - 200)', 'a')}, {r('case when x >= 200 then sqrt(x - 200) end', 's')} from ev")
def abs_sqrt(spark, d):
    e = events(spark, d)
    out = pipeline().shift(-200).abs().execute(pipeline().shift(-200).sqrt().execute(e, "x", ORDER, SERIES, "s"), "x", ORDER, SERIES, "a")
    return out.select("event_id", rnd("a").alias("a"), rnd("s").alias("s"))


@query(EV + " select event_id, value from ev where mask")
def filter_by_mask(spark, d):
    return events(spark, d).where("mask != 0").select("event_id", "value")


# reductions ------------------------------------------------------------------------------------------------------


@query(
    f"""select l_returnflag, {r('sum(l_extendedprice)', 'sum', 2)}, {r('avg(l_extendedprice)', 'mean', 4)}, {r('var_pop(l_extendedprice)', 'var', 0)},
    {r('stddev_pop(l_extendedprice)', 'std', 3)}, min(l_extendedprice) as min, max(l_extendedprice) as max from lineitem group by 1"""
)
def reduce_by_flag(spark, d):
    out = reduce.reduce_series(lines(spark, d), "l_extendedprice", ["sum", "mean", "var", "std", "min", "max"], ["l_returnflag"])
    return out.select("l_returnflag", rnd("sum", 2).alias("sum"), rnd("mean", 4).alias("mean"), rnd("var", 0).alias("var"), rnd("std", 3).alias("std"), "min", "max")


@query(f"select {r('sum(l_quantity)', 'sum', 2)}, {r('avg(l_quantity)', 'mean')}, {r('var_pop(l_quantity)', 'var')}, {r('stddev_pop(l_quantity)', 'std')}, min(l_quantity) as min, max(l_quantity) as max from lineitem")
def reduce_all_rows(spark, d):
    out = reduce.reduce_series(lines(spark, d), "l_quantity", ["sum", "mean", "var", "std", "min", "max"])
    return out.select(*[rnd(c, 2 if c == "sum" else 6).alias(c) for c in ("sum", "mean", "var", "std")], "min", "max")


@query(
    EV
    + f""", g as (select event_id % 40 as g, x, x is null as bad from ev) select g, {r('case when not bool_or(bad) then sum(x) end', 'sum', 4)}, case when not bool_or(bad) then min(x) end as min,
    case when not bool_or(bad) then max(x) end as max, {r('case when count(*) = 1 then 0.0 when not bool_or(bad) then var_pop(x) end', 'var', 4)} from g group by 1"""
)
def reduce_with_nan(spark, d):
    e = events(spark, d).withColumn("g", F.col("event_id") % 40)
    out = reduce.reduce_series(e, "x", ["sum", "min", "max", "var"], ["g"])
    return out.select("g", rnd("sum", 4).alias("sum"), F.nanvl("min", F.lit(None)).alias("min"), F.nanvl("max", F.lit(None)).alias("max"), rnd("var", 4).alias("var"))


@query(f"select l_returnflag, {r('median(l_extendedprice)', 'median', 4)} from lineitem group by 1")
def median_by_flag(spark, d):
    return reduce.median_of(lines(spark, d), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", rnd("median", 4).alias("median"))


@query(f"select l_returnflag, {r('quantile_cont(l_extendedprice, 0.3)', 'q30', 4)}, {r('quantile_cont(l_extendedprice, 0.9)', 'q90', 4)}, {r('quantile_cont(l_extendedprice, 0.999)', 'q999', 4)} from lineitem group by 1")
def quantiles_by_flag(spark, d):
    out = reduce.quantiles_of(lines(spark, d), "l_extendedprice", {"q30": 0.3, "q90": 0.9, "q999": 0.999}, ["l_returnflag"])
    return out.select("l_returnflag", *[rnd(c, 4).alias(c) for c in ("q30", "q90", "q999")])


@query(f"select l_returnflag, {r('median(l_extendedprice)', 'median', 4)}, {r('mad(l_extendedprice)', 'mad', 4)} from lineitem group by 1")
def mad_by_flag(spark, d):
    return reduce.mad_of(lines(spark, d), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", rnd("median", 4).alias("median"), rnd("mad", 4).alias("mad"))


@query("select l_extendedprice as kth from lineitem order by 1 limit 1 offset 1234")
def select_kth(spark, d):
    return reduce.select_kth(lines(spark, d), "l_extendedprice", 1234)


@query("with o as (select l_extendedprice v, row_number() over (order by l_extendedprice) - 1 as k from lineitem) select max(case when k = 100 then v end) as lower, max(case when k = 5000 then v end) as upper from o")
def select_two_bounds(spark, d):
    return reduce.select_two(lines(spark, d), "l_extendedprice", 100, 5000)


_TRIM = """with o as (select l_returnflag, l_extendedprice v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as k, count(*) over (partition by l_returnflag) as n from lineitem),
b as (select l_returnflag, max(case when k = floor(0.1 * n) then v end) lo, max(case when k = n - 1 - floor(0.1 * n) then v end) hi from o group by 1)"""


@query(_TRIM + f" select o.l_returnflag, {r('avg(v)', 'trimmed_mean', 4)} from o join b using (l_returnflag) where v between lo and hi group by 1")
def trimmed_mean(spark, d):
    return reduce.trimmed_mean_of(lines(spark, d), "l_extendedprice", 0.1, ["l_returnflag"]).select("l_returnflag", rnd("trimmed_mean", 4).alias("trimmed_mean"))


@query(_TRIM + f" select o.l_returnflag, {r('avg(least(greatest(v, lo), hi))', 'winsorized_mean', 4)} from o join b using (l_returnflag) group by 1")
def winsorized_mean(spark, d):
    return reduce.winsorized_mean_of(lines(spark, d), "l_extendedprice", 0.1, ["l_returnflag"]).select("l_returnflag", rnd("winsorized_mean", 4).alias("winsorized_mean"))


_DENSE = "with g as (select range as g from range(12)), v as (select l_suppkey % 9 as g, l_quantity as x from lineitem)"


@query(_DENSE + f" select g.g, coalesce(sum(x), 0.0) as group_sum, {r('avg(x)', 'group_mean')}, {r('var_pop(x)', 'group_var')} from g left join v on v.g = g.g group by 1")
def dense_groups(spark, d):
    v = lines(spark, d).withColumn("g", F.col("l_suppkey") % 9)  # groups 9 to 11 are empty
    return reduce.dense_groups(v, "l_quantity", "g", 12).select("g", "group_sum", rnd("group_mean").alias("group_mean"), rnd("group_var").alias("group_var"))


@query("select range as g, cast(null as double) as group_sum from range(12)")
def dense_groups_whole_nan(spark, d):
    e = events(spark, d).withColumn("g", F.col("event_id") % 12)
    return reduce.dense_groups(e, "x", "g", 12, whole_nan=True).select("g", F.nanvl("group_sum", F.lit(None)).alias("group_sum"))


# the NaN of a row that the mask leaves out does not matter
@query(
    EV
    + f""" select event_type, {r('sum(value) filter (where mask)', 'sum', 4)}, {r('avg(value) filter (where mask)', 'mean')}, {r('var_samp(value) filter (where mask)', 'var', 4)},
    count(*) filter (where mask) as n_valid from ev group by 1"""
)
def masked_reduce(spark, d):
    e = events(spark, d).withColumn("y", F.when(F.col("mask") == 0, F.lit(ieee.NAN)).otherwise(F.col("value")))
    return reduce.masked_reduce(e, "y", "mask", ["event_type"]).select("event_type", rnd("sum", 4).alias("sum"), rnd("mean").alias("mean"), rnd("var", 4).alias("var"), "n_valid")


@query(EV + f" select event_type, {r('median(x) filter (where mask)', 'median', 4)}, {r('mad(x) filter (where mask)', 'mad', 4)} from ev group by 1")
def masked_median_mad(spark, d):
    return reduce.masked_median_mad(events(spark, d), "x", "mask", ["event_type"]).select("event_type", rnd("median", 4).alias("median"), rnd("mad", 4).alias("mad"))


# matrices --------------------------------------------------------------------------------------------------------


@query(MX + f", l as (select unnest(a) as x, unnest(range(len(a))) as pos from m) select cast(pos as int) as pos, {r('sum(x)', 'sum')}, {r('avg(x)', 'mean')}, {r('min(x)', 'min')}, {r('max(x)', 'max')} from l group by 1")
def column_reduce(spark, d):
    return arrays.column_reduce(matrix(spark, d), "a").select("pos", *[rnd(c).alias(c) for c in ("sum", "mean", "min", "max")])


@query(MX + f" select vec_id, {r('list_sum(a)', 'sum')}, {r('list_avg(a)', 'mean')}, {r('list_min(a)', 'min')}, {r('list_max(a)', 'max')} from m")
def row_reduce(spark, d):
    a = F.col("a")
    return matrix(spark, d).select("vec_id", rnd(arrays.row_sum(a)).alias("sum"), rnd(arrays.row_mean(a)).alias("mean"), rnd(arrays.row_min(a)).alias("min"), rnd(arrays.row_max(a)).alias("max"))


@query(MX + f" select vec_id, {r('list_median(a)', 'median')}, {r('list_mad(a)', 'mad')} from m")
def row_median_mad(spark, d):
    return matrix(spark, d).select("vec_id", rnd(arrays.row_median(F.col("a"))).alias("median"), rnd(arrays.row_mad(F.col("a"))).alias("mad"))


@query(MX + ", l as (select vec_id, unnest(a) as x from m) select vec_id, round(quantile_cont(x, 0.3) + 1e-10, 6) as q30 from l group by 1")
def row_quantile(spark, d):
    return matrix(spark, d).select("vec_id", rnd(arrays.row_quantile(F.col("a"), 0.3)).alias("q30"))


_LONG = MX + ", l as (select vec_id, unnest(a) as x, cast(unnest(range(len(a))) as int) as pos from m)"


@query(_LONG + f", s as (select vec_id, median(x) md, mad(x) ad from l group by 1) select vec_id, pos, {r('(x - md) / (ad * 1.4826)', 'z')} from l join s using (vec_id)")
def row_robust_zscore(spark, d):
    return matrix(spark, d).select("vec_id", F.posexplode(arrays.row_robust_zscore(F.col("a"))).alias("pos", "z")).select("vec_id", "pos", rnd("z").alias("z"))


def _flag_query(flags: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: matrix(spark, d).select("vec_id", F.posexplode(flags(F.col("a"))).alias("pos", "flag")).where("flag").select("vec_id", "pos")


@query(_LONG + ", s as (select vec_id, avg(x) m, stddev_pop(x) sd from l group by 1) select vec_id, pos from l join s using (vec_id) where abs((x - m) / sd) > 2.5")
def row_anomalies(spark, d):
    return _flag_query(lambda a: arrays.row_anomalies(a, 2.5))(spark, d)


@query(_LONG + ", s as (select vec_id, avg(x) m, stddev_samp(x) sd from l group by 1) select vec_id, pos from l join s using (vec_id) where abs((x - m) / sd) > 2.5")
def row_anomalies_sample(spark, d):
    return _flag_query(lambda a: arrays.row_anomalies_sample(a, 2.5))(spark, d)


@query(_LONG + ", s as (select vec_id, median(x) md, mad(x) ad from l group by 1) select vec_id, pos from l join s using (vec_id) where abs((x - md) / (1.4826 * ad)) > 3")
def row_anomalies_robust(spark, d):
    return _flag_query(lambda a: arrays.row_anomalies_robust(a, 3.0))(spark, d)


# rolling ---------------------------------------------------------------------------------------------------------


def _rolled(spark: SparkSession, d: str, stats: list[str], mask: str | None = None, threshold: float = 3.0) -> DataFrame:
    return rolling.rolling(events(spark, d), "x", W, ORDER, SERIES, stats, mask, prefix="", threshold=threshold)


def _window_query(*stats: str, mask: str | None = None, digits: int = 5) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _rolled(spark, d, list(stats), mask).select("event_id", *[rnd(s, digits).alias(s) for s in stats])


@query(EV + f" select event_id, {r(f'sum(x) over {OVER}', 'sum', 5)}, {r(f'avg(x) over {OVER}', 'mean', 5)} from ev")
def rolling_sum_mean(spark, d):
    return _window_query("sum", "mean")(spark, d)


@query(EV + f" select event_id, {r(f'var_pop(x) over {OVER}', 'var', 4)}, {r(f'stddev_pop(x) over {OVER}', 'std', 4)} from ev")
def rolling_var_std(spark, d):
    return _window_query("var", "std", digits=4)(spark, d)


_FULL = f"count(*) over {OVER} = 50 and count(x) over {OVER} = 50"
# windows that hold a NaN give none, so these run over every 97th row set to NaN only
EW97 = "with ev as (select event_id, ts, event_type, value, case when event_id % 997 = 0 then null else value end as x, event_id % 3 <> 0 as mask from events)"


def _rare_nan(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("x", F.when(F.col("event_id") % 997 == 0, F.lit(ieee.NAN)).otherwise(F.col("value")))


@query(EW97 + f" select event_id, {r(f'case when {_FULL} then median(x) over {OVER} end', 'median', 4)} from ev")
def rolling_median(spark, d):
    return rolling.rolling(_rare_nan(spark, d), "x", W, ORDER, SERIES, ["median"], prefix="").select("event_id", rnd("median", 4).alias("median"))


@query(EW97 + f" select event_id, {r(f'case when {_FULL} then mad(x) over {OVER} end', 'mad', 4)} from ev")
def rolling_mad(spark, d):
    return rolling.rolling(_rare_nan(spark, d), "x", W, ORDER, SERIES, ["mad"], prefix="").select("event_id", rnd("mad", 4).alias("mad"))


@query(EV + f" select event_id, {r(f'case when count(*) over {OVER} = 50 and x is not null then (x - avg(x) over {OVER}) / stddev_pop(x) over {OVER} end', 'zscore', 5)} from ev")
def rolling_zscore(spark, d):
    return _window_query("zscore")(spark, d)


@query(EW97 + f" select event_id, {r(f'case when {_FULL} then 0.6745 * (x - median(x) over {OVER}) / mad(x) over {OVER} end', 'robust_zscore', 5)} from ev")
def rolling_robust_zscore(spark, d):
    return rolling.rolling(_rare_nan(spark, d), "x", W, ORDER, SERIES, ["robust_zscore"], prefix="").select("event_id", rnd("robust_zscore", 5).alias("robust_zscore"))


@query(
    EW97
    + f""", w as (select event_id, case when {_FULL} then list_sort(list(x) over {OVER}) end as l from ev), u as (select event_id, l, l[26] as m from w)
    select event_id, {r('m', 'median_upper', 4)}, {r('list_sort(list_transform(l, lambda v: abs(v - m)))[26]', 'mad_upper', 4)} from u"""
)
def rolling_upper_median_mad(spark, d):
    out = rolling.rolling(_rare_nan(spark, d), "x", W, ORDER, SERIES, ["median_upper", "mad_upper"], prefix="")
    return out.select("event_id", rnd("median_upper", 4).alias("median_upper"), rnd("mad_upper", 4).alias("mad_upper"))


_COLS = "(partition by pos order by vec_id rows between 19 preceding and current row)"


@query(_LONG + f" select vec_id, pos, {r(f'case when count(*) over {_COLS} = 20 then sum(x) over {_COLS} end', 'sum', 5)}, {r(f'case when count(*) over {_COLS} = 20 then avg(x) over {_COLS} end', 'mean', 5)} from l")
def rolling_columns_sum_mean(spark, d):
    return rolling.rolling_arrays(matrix(spark, d), "a", 20, ["vec_id"], ["sum", "mean"]).select("vec_id", "pos", rnd("rolling_sum", 5).alias("sum"), rnd("rolling_mean", 5).alias("mean"))


@query(_LONG + f" select vec_id, pos, {r(f'avg(x) over {_COLS}', 'mean', 5)} from l")
def rolling_columns_mean_partial(spark, d):
    return rolling.rolling_arrays(matrix(spark, d), "a", 20, ["vec_id"], ["mean"], full_only=False).select("vec_id", "pos", rnd("rolling_mean", 5).alias("mean"))


@query(
    _LONG
    + f""", w as (select vec_id, pos, case when count(*) over {_COLS} = 20 then list_sort(list(x) over {_COLS}) end as l from l), u as (select vec_id, pos, l, l[11] as m from w)
    select vec_id, pos, {r('m', 'median', 5)}, {r('list_sort(list_transform(l, lambda v: abs(v - m)))[11]', 'mad', 5)} from u"""
)
def rolling_columns_median_mad(spark, d):
    out = rolling.rolling_arrays(matrix(spark, d), "a", 20, ["vec_id"], ["median_upper", "mad_upper"])
    return out.select("vec_id", "pos", rnd("rolling_median_upper", 5).alias("median"), rnd("rolling_mad_upper", 5).alias("mad"))


@query(EV + f" select event_id, {r(f'avg(x) filter (where mask) over {OVER}', 'mean_masked', 5)}, {r(f'median(x) filter (where mask) over {OVER}', 'median_masked', 5)} from ev")
def rolling_masked(spark, d):
    return _window_query("mean_masked", "median_masked", mask="mask")(spark, d)


@query(EW97 + f", z as (select event_id, case when {_FULL} then abs(x - median(x) over {OVER}) / (1.4826 * mad(x) over {OVER}) end as z from ev) select event_id, coalesce(z > 2.5, false) as anomaly from z")
def rolling_anomalies(spark, d):
    return rolling.rolling(_rare_nan(spark, d), "x", W, ORDER, SERIES, ["anomaly"], prefix="", threshold=2.5).select("event_id", "anomaly")


@query(EV + f", z as (select event_id, case when count(*) over {OVER} = 50 then abs(x - avg(x) over {OVER}) / stddev_pop(x) over {OVER} end as z from ev) select event_id, coalesce(z > 2.5, false) as anomaly_std from z")
def rolling_anomalies_std(spark, d):
    return _rolled(spark, d, ["anomaly_std"], threshold=2.5).select("event_id", "anomaly_std")


@query(EV + f" select event_id, {r('avg(x) over (order by ts, event_id rows between 49 preceding and current row)', 'mean', 5)} from ev")
def rolling_mean_one_series(spark, d):
    """One series of all rows, in blocks."""
    e = events(spark, d)
    return rolling.rolling(e, "x", W, ORDER, (), ["mean"], prefix="", whole_rows=4096).select("event_id", rnd("mean", 5).alias("mean"))


# lags, scans -----------------------------------------------------------------------------------------------------


@query(EV + f" select event_id, {r(f'x - lag(x, 3) over {SER}', 'y')} from ev")
def diff(spark, d):
    return scans.lagged(events(spark, d), "x", ORDER, SERIES, "diff", 3, "y").select("event_id", rnd("y").alias("y"))


@query(EV + f" select event_id, lag(x, 2) over {SER} as y from ev")
def lag(spark, d):
    return scans.lagged(events(spark, d), "x", ORDER, SERIES, "lag", 2, "y").select("event_id", F.nanvl("y", F.lit(None)).alias("y"))


@query(EV + f" select event_id, {r(f'ln(x / lag(x) over {SER})', 'log_return')}, {r(f'(x - lag(x) over {SER}) / lag(x) over {SER}', 'pct_change', 5)} from ev")
def returns(spark, d):
    out = scans.lagged(scans.lagged(events(spark, d), "x", ORDER, SERIES, "log_return", 1, "lr"), "x", ORDER, SERIES, "pct_change", 1, "pc")
    return out.select("event_id", rnd("lr").alias("log_return"), rnd("pc", 5).alias("pct_change"))


@query(
    EV
    + f""", f as (select *, first_value(x is null) over {RUN} as bad from ev) select event_id, case when not bad then min(x) over {RUN} end as cmin, case when not bad then max(x) over {RUN} end as cmax from f"""
)
def cumulative_min_max(spark, d):
    out = scans.cumulative(scans.cumulative(events(spark, d), "x", ORDER, SERIES, "min", "cmin"), "x", ORDER, SERIES, "max", "cmax")
    return out.select("event_id", F.nanvl("cmin", F.lit(None)).alias("cmin"), F.nanvl("cmax", F.lit(None)).alias("cmax"))


@query(EV + f" select event_id, {r(f'sum(value) over {RUN}', 'inclusive', 4)}, {r(f'sum(value) over {RUN} - value', 'exclusive', 4)} from ev")
def prefix_sums(spark, d):
    out = scans.cumulative(scans.cumulative(events(spark, d), "value", ORDER, SERIES, "sum", "a"), "value", ORDER, SERIES, "sum_exclusive", "b")
    return out.select("event_id", rnd("a", 4).alias("inclusive"), rnd("b", 4).alias("exclusive"))


@query(EV + f" select event_id, {r('sum(value) over (order by ts, event_id rows unbounded preceding)', 'total', 3)} from ev")
def prefix_sum_one_series(spark, d):
    """One series of all rows, in blocks."""
    return scans.cumulative(events(spark, d), "value", ORDER, (), "sum", "total", whole_rows=4096).select("event_id", rnd("total", 3).alias("total"))


@query(
    EV
    + f""" select event_id, last_value(x ignore nulls) over {RUN} as forward,
    first_value(x ignore nulls) over (partition by event_type order by ts, event_id rows between current row and unbounded following) as backward from ev"""
)
def fills(spark, d):
    out = scans.cumulative(scans.cumulative(events(spark, d), "x", ORDER, SERIES, "fill_forward", "f"), "x", ORDER, SERIES, "fill_backward", "b")
    return out.select("event_id", F.nanvl("f", F.lit(None)).alias("forward"), F.nanvl("b", F.lit(None)).alias("backward"))


@query(EV + f", c as (select event_id, x * 0.25 + lead(x, 1) over {SER} * 0.5 - lead(x, 2) over {SER} * 0.75 as y, lead(1, 2) over {SER} as ok from ev) select event_id, {r('y', 'y')} from c where ok is not null")
def convolve(spark, d):
    return scans.convolve_valid(events(spark, d), "x", [0.25, 0.5, -0.75], ORDER, SERIES, "y").select("event_id", rnd("y").alias("y"))


_EW = """with recursive o as (select event_id, event_type, value as x, row_number() over (partition by event_type order by ts, event_id) as k from events),
e as (select event_id, event_type, k, x as m, 0.0::double as v from o where k = 1
union all select o.event_id, o.event_type, o.k, 0.2 * o.x + 0.8 * e.m, 0.8 * e.v + 0.2 * 0.8 * (o.x - e.m) * (o.x - e.m) from e join o on o.event_type = e.event_type and o.k = e.k + 1)"""


@query(_EW + f" select event_id, {r('m', 'ewma', 4)}, {r('v', 'ewvar', 2)}, {r('sqrt(v)', 'ewstd', 3)} from e")
def exponentially_weighted(spark, d):
    out = scans.exponentially_weighted(events(spark, d), "value", 0.2, ORDER, SERIES)
    return out.select("event_id", rnd("ew_mean", 4).alias("ewma"), rnd("ew_var", 2).alias("ewvar"), rnd("ew_std", 3).alias("ewstd"))


# normalisation, anomalies ----------------------------------------------------------------------------------------


@query(EV + ", s as (select event_type, avg(value) m, stddev_pop(value) sd from ev group by 1)" + f" select event_id, {r('(value - m) / sd', 'z')} from ev join s using (event_type)")
def zscore(spark, d):
    return normalize.zscore(events(spark, d), "value", SERIES, "z").select("event_id", rnd("z").alias("z"))


@query(EV + ", s as (select event_type, median(value) m, mad(value) ad from ev group by 1)" + f" select event_id, {r('(value - m) / (1.4826 * ad)', 'z')} from ev join s using (event_type)")
def robust_zscore(spark, d):
    return normalize.robust_zscore(events(spark, d), "value", SERIES, "z").select("event_id", rnd("z").alias("z"))


@query(EV + ", s as (select event_type, min(x) lo, max(x) hi, arg_min(x is null, (ts, event_id)) bad from ev group by 1)" + f" select event_id, {r('case when bad then 0.5 else (x - lo) / (hi - lo) end', 'y')} from ev join s using (event_type)")
def normalize_minmax(spark, d):
    return normalize.normalize_minmax(events(spark, d), "x", ORDER, SERIES, "y").select("event_id", rnd("y").alias("y"))


@query("with s as (select l_returnflag, quantile_cont(l_extendedprice, 0.05) lo, quantile_cont(l_extendedprice, 0.95) hi from lineitem group by 1) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest(l_extendedprice, lo), hi) + 1e-10, 3) as y from lineitem join s using (l_returnflag)")
def winsorize(spark, d):
    return normalize.winsorize(lines(spark, d), "l_extendedprice", 0.05, 0.95, ["l_returnflag"], "y").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("y", 3).alias("y"))


@query(EV + ", s as (select event_type, avg(value) m, stddev_pop(value) sd from ev group by 1) select event_id from ev join s using (event_type) where abs((value - m) / sd) > 2.5")
def detect_anomalies(spark, d):
    return normalize.detect_anomalies(events(spark, d), "value", 2.5, SERIES).where("anomaly").select("event_id")


@query(EV + ", s as (select event_type, median(value) m, mad(value) ad from ev group by 1) select event_id from ev join s using (event_type) where abs((value - m) / (1.4826 * ad)) > 3")
def detect_anomalies_robust(spark, d):
    return normalize.detect_anomalies_robust(events(spark, d), "value", 3.0, SERIES).where("anomaly").select("event_id")


_ROUND = "r{1} as (select e.* from r{0} e join (select event_type, median(value) m, mad(value) ad from r{0} group by 1) s using (event_type) where abs(value - m) <= 3 * 1.4826 * ad)"


@query("with r0 as (select event_id, event_type, value from events), " + ", ".join(_ROUND.format(i, i + 1) for i in range(3)) + " select event_id from r3")
def remove_outliers(spark, d):
    return normalize.remove_outliers(events(spark, d), "value", 3.0, 3, SERIES)[0].select("event_id")


# pipelines -------------------------------------------------------------------------------------------------------


@query(
    EV
    + f""", f as (select event_id, ts, event_type, last_value(x ignore nulls) over {RUN} as x from ev), g as (select *, x - lag(x) over {SER} as y from f),
    h as (select *, avg(y) over (partition by event_type order by ts, event_id rows between 9 preceding and current row) as m from g),
    k as (select event_id, case when m is not null then least(greatest(m * 2 + 1, -100), 100) end as y from h) select event_id, {r('y', 'y', 5)} from k"""
)
def pipeline_smooth(spark, d):
    p = pipeline().fill_forward().diff(1).rolling_mean(10).scale(2).shift(1).clip(-100, 100)
    return p.execute(events(spark, d), "x", ORDER, SERIES, "y").select("event_id", rnd("y", 5).alias("y"))


@query(
    f"""with a as (select event_id, ts, event_type, ln(value / lag(value) over {SER}) as x from events), b as (select *, abs(x) as y from a),
    c as (select event_id, ts, event_type, y, min(y) over {RUN} as lo, max(y) over {RUN} as hi, first_value(y is null) over {RUN} as bad from b)
    select event_id, cast(null as double) as y from c"""
)
def pipeline_leading_nan(spark, d):
    """A log return begins with NaN, which a running extreme keeps."""
    p = pipeline().log_return().abs().cumulative_max()
    return p.execute(events(spark, d), "value", ORDER, SERIES, "y").select("event_id", rnd("y", 5).alias("y"))


@query(
    _EW.replace("value as x", "sqrt(abs(value - 100)) as x")
    + f""", p as (select event_id, event_type, k, sum(m) over (partition by event_type order by k) as s from e),
    c as (select event_id, event_type, k, s * 0.5 + lead(s) over (partition by event_type order by k) * 0.5 as y, lead(1) over (partition by event_type order by k) as ok from p),
    n as (select event_id, y, min(y) over (partition by event_type) lo, max(y) over (partition by event_type) hi from c where ok is not null)
    select event_id, {r('(y - lo) / (hi - lo)', 'y')} from n"""
)
def pipeline_ewma_prefix_convolve(spark, d):
    p = pipeline().shift(-100).abs().sqrt().ewma(0.2).prefix_sum().convolve([0.5, 0.5]).normalize_minmax()
    return p.execute(events(spark, d), "value", ORDER, SERIES, "y").select("event_id", rnd("y").alias("y"))


@query(
    f"""with a as (select event_id, ts, event_type, (value - lag(value) over {SER}) / lag(value) over {SER} as x from events),
    b as (select event_id, ts, event_type, lag(x, 2) over {SER} as x from a),
    c as (select event_id, ts, event_type, coalesce(stddev_pop(x) over {OVER}, null) as y from b), s as (select event_type, count(*) - count(y) as bad from c group by 1)
    select event_id, {r('y', 'y', 5)} from c"""
)
def pipeline_volatility(spark, d):
    return pipeline().pct_change().lag(2).rolling_std(W).execute(events(spark, d), "value", ORDER, SERIES, "y").select("event_id", rnd("y", 5).alias("y"))


@query(
    f"""with a as (select event_id, ts, event_type, mad(value) over {OVER} as x, count(*) over {OVER} = 50 as ok from events),
    b as (select event_id, ts, event_type, coalesce(case when ok then x end, 0.0) as y from a), s as (select event_type, median(y) m, mad(y) ad from b group by 1)
    select event_id, {r('(y - m) / (1.4826 * ad)', 'y', 4)} from b join s using (event_type)"""
)
def pipeline_rolling_mad_robust(spark, d):
    p = pipeline().rolling_mad(W).map(lambda x: F.nanvl(x, F.lit(0.0))).robust_zscore()
    return p.execute(events(spark, d), "value", ORDER, SERIES, "y").select("event_id", rnd("y", 4).alias("y"))


# end-to-end ------------------------------------------------------------------------------------------------------


@query(
    EV
    + f""", z as (select event_type, case when count(*) over {OVER} = 50 and x is not null then (x - avg(x) over {OVER}) / stddev_pop(x) over {OVER} end as z from ev)
    select event_type, count(*) as n, count(z) as n_scored, count(*) filter (where abs(z) > 2.5) as n_flagged from z group by 1"""
)
def sensor_screening(spark, d):
    z = _rolled(spark, d, ["zscore"])
    flagged = F.count(F.when(ieee.beyond(F.col("zscore"), 2.5), 1))
    return z.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(~F.isnan("zscore"), 1)).alias("n_scored"), flagged.alias("n_flagged"))


@query(
    f"""with o as (select o_orderkey, o_custkey, o_orderdate, o_totalprice, c_mktsegment, n_name, r_name from orders
      left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey),
    w as (select *, avg(o_totalprice) over s7 as mean_7, stddev_pop(o_totalprice) over s7 as std_7, lag(o_totalprice, 1) over s as lag_1, lag(o_totalprice, 7) over s as lag_7,
      median(o_totalprice) over s28 as med_28, count(*) over s28 as n_28 from o
      window s as (partition by o_custkey order by o_orderdate, o_orderkey), s7 as (partition by o_custkey order by o_orderdate, o_orderkey rows between 6 preceding and current row),
      s28 as (partition by o_custkey order by o_orderdate, o_orderkey rows between 27 preceding and current row))
    select o_orderkey, c_mktsegment, n_name, r_name, {r('mean_7', 'mean_7', 3)}, {r('std_7', 'std_7', 3)}, lag_1, lag_7, {r('case when n_28 = 28 then med_28 end', 'median_28', 3)} from w"""
)
def feature_engineering(spark, d):
    """Order histories with their customers' attributes, rolling statistics and lags."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, g = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(spark, d, "region").select("r_regionkey", "r_name")
    # the chosen join follows the sides' sizes at run time
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    order, series = ("o_orderdate", "o_orderkey"), ("o_custkey",)
    w = rolling.rolling(joined, "o_totalprice", 7, order, series, ["mean", "std"], prefix="s7_")
    w = rolling.rolling(w, "o_totalprice", 28, order, series, ["median"], prefix="s28_")
    for k in (1, 7):
        w = scans.lagged(w, "o_totalprice", order, series, "lag", k, f"lag_{k}")
    lags = [F.nanvl(f"lag_{k}", F.lit(None)).alias(f"lag_{k}") for k in (1, 7)]
    return w.select("o_orderkey", "c_mktsegment", "n_name", "r_name", rnd("s7_mean", 3).alias("mean_7"), rnd("s7_std", 3).alias("std_7"), *lags, rnd("s28_median", 3).alias("median_28"))


_WIN = 50


@query(EV + f", s as (select event_type, avg(value) m, stddev_pop(value) sd from ev group by 1), z as (select event_id, ts, event_type, (value - m) / sd as z from ev join s using (event_type)) select event_id, {r(f'min(z) over {RUN}', 'y', 5)} from z")
def pipeline_zscore_cumulative_min(spark, d):
    return pipeline().zscore().cumulative_min().execute(events(spark, d), "value", ORDER, SERIES, "y").select("event_id", rnd("y", 5).alias("y"))


@query(EV + f" select event_id, {r(f'case when count(*) over {OVER} = 50 then median(value) over {OVER} end', 'y', 4)} from ev")
def pipeline_rolling_median(spark, d):
    return pipeline().rolling_median(_WIN).execute(events(spark, d), "value", ORDER, SERIES, "y").select("event_id", rnd("y", 4).alias("y"))


@query(_EW + f" select event_id, {r('v', 'variance', 2)}, {r('sqrt(v)', 'deviation', 3)} from e")
def pipeline_weighted_variance(spark, d):
    """The stages ewvar and ewstd."""
    out = pipeline().ewstd(0.2).execute(pipeline().ewvar(0.2).execute(events(spark, d), "value", ORDER, SERIES, "v"), "value", ORDER, SERIES, "s")
    return out.select("event_id", rnd("v", 2).alias("variance"), rnd("s", 3).alias("deviation"))


_ROW_WINDOW = "[list_avg(list_slice(embedding::double[], greatest(i - 4, 1), i)) for i in range(1, len(embedding) + 1)]"


@query(f"select vec_id, pos - 1 as pos, round(m + 1e-10, 5) + 0.0 as mean from (select vec_id, unnest({_ROW_WINDOW}) as m, generate_subscripts(embedding, 1) as pos from embeddings)")
def rolling_mean_rows(spark, d):
    """Windows along the rows of a matrix (axis 1)."""
    out = matrix(spark, d).select("vec_id", F.posexplode(arrays.row_rolling_mean(F.col("a"), 5)).alias("pos", "m"))
    return out.select("vec_id", F.col("pos").cast("bigint").alias("pos"), rnd("m", 5).alias("mean"))


@query("select s_suppkey, s_name, s_acctbal from supplier")
def csv_round_trip(spark, d):
    """A table written as CSV and read with its schema."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    path = written_path(spark, "csv")
    s.write.csv(path, header=True)
    return csv_series(spark, path, s.schema)


@query(f"select event_id, {r('2.5 * value', 'y')} from events")
def execute_into(spark, d):
    """A pipeline whose result is written to a sink and read again."""
    path = written_path(spark, "sink")
    n = write_into(pipeline().scale(2.5).execute(events(spark, d), "value", ORDER, SERIES, "y").select("event_id", rnd("y").alias("y")), path)
    return spark.read.parquet(path).where(F.lit(n) >= 0)
