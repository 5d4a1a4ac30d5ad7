"""Global, grouped and masked reductions with NaN semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline.functions.ieee import NAN, to_nan, to_null
from strandline.runtime import materialize


def _any_nan(x: Column) -> Column:
    return F.max(F.isnan(x))


def _guard(x: Column, result: Column) -> Column:
    return F.when(_any_nan(x), F.lit(NAN)).otherwise(result)


def sum_of(c: Column) -> Column:
    return F.sum(to_nan(c))


def mean_of(c: Column) -> Column:
    return F.avg(to_nan(c))


def var_of(c: Column) -> Column:
    """Population variance; a single row has 0, even where it is NaN."""
    x = to_nan(c)
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(_guard(x, F.var_pop(x)))


def std_of(c: Column) -> Column:
    return F.sqrt(var_of(c))


def min_of(c: Column) -> Column:
    x = to_nan(c)
    return _guard(x, F.min(x))


def max_of(c: Column) -> Column:
    return F.max(to_nan(c))  # ranks NaN above all, so it propagates


REDUCTIONS = {"sum": sum_of, "mean": mean_of, "var": var_of, "std": std_of, "min": min_of, "max": max_of}


def reduce_series(df: DataFrame, value: str, ops: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Reductions of ``value`` named in ``ops`` (sum, mean, var, std, min, max), per ``by`` or over all rows.

    Null counts as NaN, and NaN gives NaN; variance is that of the population. Partial aggregates are combined
    before the shuffle. No rows give null (no row with ``by``).
    """
    if unknown := set(ops) - set(REDUCTIONS):
        raise ValueError(f"unknown reductions: {sorted(unknown)}")
    x = F.col(value)
    return df.groupBy(*by).agg(*[REDUCTIONS[o](x).alias(o) for o in ops])


# order statistics ------------------------------------------------------------------------------------------------

_STEP = 2e-4  # twice the relative rank error of percentile_approx with accuracy 10,000
_WIDTHS = ((50_000, _STEP), (2_000, 2e-3), (100, 0.04))


def order_statistics(df: DataFrame, value: str, at: dict[str, tuple[float, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Exact order statistics per group: ``by``, ``n``, ``has_nan`` and a column for each entry of ``at``.

    ``at`` maps a name to (about which share of the ranks, the 0-based rank as an expression over ``n``); the rank must
    be within two of the share of n. NaN and null are set aside (``has_nan``).

    No group is sorted or collected: a first aggregate finds with mergeable digests a narrow bracket of values around
    each rank, a second counts the rows below the brackets and, for the values inside, rows per value. Only those
    distinct values, at most a few ten-thousandths of a large group's, are ranked. The brackets and the result, a row per
    group, are written out: they are read several times, and joins with tables known to be small leave the rows where they are.
    """
    by = list(by)
    x = to_nan(F.col(value))
    rows = df.select(*[F.col(b) for b in by], x.alias("_x"))
    probes, index = [], {}
    for name, (q, _) in at.items():
        for width in [w for _, w in _WIDTHS]:
            for p in (max(q - width, 0.0), min(q + width, 1.0)):
                index[name, width, p >= q and p != max(q - width, 0.0)] = len(probes)
                probes.append(p)
    good = F.when(~F.isnan("_x"), F.col("_x"))
    first = rows.groupBy(*by).agg(
        F.count(good).alias("n"), F.coalesce(F.max(F.isnan("_x")), F.lit(False)).alias("has_nan"), F.min(good).alias("_min"), F.max(good).alias("_max"),
        F.percentile_approx(good, probes, 10_000).alias("_p"),
    )
    names = list(at)
    for k, name in enumerate(names):
        lo, hi = F.col("_min"), F.col("_max")
        for least, width in reversed(_WIDTHS):
            lo = F.when(F.col("n") >= least, F.col("_p")[index[name, width, False]]).otherwise(lo)
            hi = F.when(F.col("n") >= least, F.col("_p")[index[name, width, True]]).otherwise(hi)
        first = first.withColumn(f"_lo{k}", lo).withColumn(f"_hi{k}", hi).withColumn(f"_rank{k}", at[name][1].cast("long"))
    first = materialize(first.drop("_p", "_min", "_max"), "brackets")
    keyed = first.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *[F.col(f"_{e}{k}") for k in range(len(names)) for e in ("lo", "hi", "rank")])
    finite = rows.where(~F.isnan("_x"))
    if by:
        on = F.lit(True)
        for i, b in enumerate(by):
            on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
        joined = finite.join(keyed, on)
    else:
        joined = finite.crossJoin(F.broadcast(keyed))  # one row
    ks = [F.col(f"_k{i}") for i in range(len(by))]
    # below a bracket only a count is needed; inside, rows per value, each row once per bracket it lies in
    ranks = [F.col(f"_rank{k}") for k in range(len(names))]
    below = joined.groupBy(*ks).agg(*[F.count(F.when(F.col("_x") < F.col(f"_lo{k}"), 1)).alias(f"_below{k}") for k in range(len(names))])
    entries = F.array_compact(F.array(*[F.when(F.col("_x").between(F.col(f"_lo{k}"), F.col(f"_hi{k}")), F.lit(k)) for k in range(len(names))]))
    counted = joined.select(*ks, *ranks, F.explode(entries).alias("k"), F.col("_x").alias("v")).groupBy(*ks, *[f"_rank{k}" for k in range(len(names))], "k", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*ks, "k").orderBy("v"))
    right = below.withColumnsRenamed({f"_k{i}": f"_j{i}" for i in range(len(by))})
    on = F.lit(True)
    for i in range(len(by)):
        on = on & F.col(f"_k{i}").eqNullSafe(F.col(f"_j{i}"))
    counted = counted.withColumn("_upto", upto).join(right if by else F.broadcast(right), on)  # one row where there are no groups
    rank = F.element_at(F.array(*ranks), F.col("k") + 1) - F.element_at(F.array(*[F.col(f"_below{k}") for k in range(len(names))]), F.col("k") + 1)
    hit = counted.where((F.col("_upto") > rank) & (F.col("_upto") - F.col("c") <= rank))
    found = hit.groupBy(*ks).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"_f{k}") for k in range(len(names))])
    head = first.select(*by, "n", "has_nan", *[f"_rank{k}" for k in range(len(names))])
    if by:
        on = F.lit(True)
        for i, b in enumerate(by):
            on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
        out = head.join(found, on, "left")
    else:
        out = head.join(F.broadcast(found), F.lit(True), "left")  # one row each
    # the digests' error is within the brackets; were it not, that must not pass for an empty group
    lost = [F.col(f"_f{k}").isNull() & F.col(f"_rank{k}").between(0, F.col("n") - 1) for k in range(len(names))]
    out = out.select(*by, "n", "has_nan", *[F.when(lost[k], F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).otherwise(F.col(f"_f{k}")).alias(name) for k, name in enumerate(names)])
    return materialize(out, "order_statistics")


def quantiles_of(df: DataFrame, value: str, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles by linear interpolation at rank (n - 1) q: ``by`` and a column per entry of ``qs``.

    NaN or null anywhere in a group gives NaN; an empty table gives null.
    """
    at = {}
    for name, q in qs.items():
        if not 0 <= q <= 1:
            raise ValueError("q must lie in 0..1")
        low = F.floor((F.col("n") - 1) * F.lit(float(q)))
        at[f"{name}_l"] = (q, F.greatest(low, F.lit(0)))
        at[f"{name}_h"] = (q, F.greatest(F.least(low + 1, F.col("n") - 1), F.lit(0)))
    s = order_statistics(df, value, at, by)
    cols = []
    for name, q in qs.items():
        h = (F.col("n") - 1) * F.lit(float(q))
        v = F.col(f"{name}_l") + (h - F.floor(h)) * (F.col(f"{name}_h") - F.col(f"{name}_l"))
        cols.append(F.when(F.col("has_nan"), F.lit(NAN)).otherwise(v).alias(name))
    return s.select(*by, *cols)


def median_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return quantiles_of(df, value, {"median": 0.5}, by)


def with_statistics(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the statistics of their group (null-safe); without ``by`` the one row of statistics goes to all."""
    if not by:
        return df.crossJoin(F.broadcast(stats))
    right = stats.withColumnsRenamed({b: f"_g{i}" for i, b in enumerate(by)})
    on = F.lit(True)
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    return df.join(right, on, "left").drop(*[f"_g{i}" for i in range(len(by))])


def mad_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``median`` and ``mad`` = median of |x - median|, unscaled; NaN in a group gives NaN."""
    by = list(by)
    rows = df.select(*by, to_nan(F.col(value)).alias("_v"))
    med = median_of(rows, "_v", by)
    away = with_statistics(rows, med, by).withColumn("_v", F.abs(F.col("_v") - F.col("median")))
    mad = median_of(away, "_v", by).withColumnRenamed("median", "mad")
    return with_statistics(med, mad, by)


def _trim_bounds(df: DataFrame, value: str, fraction: float, by: Sequence[str]) -> DataFrame:
    if not 0 <= fraction < 0.5:
        raise ValueError("fraction must lie in 0..0.5")
    m = F.floor(F.col("n") * F.lit(float(fraction)))
    return order_statistics(df, value, {"lo": (fraction, m), "hi": (1 - fraction, F.greatest(F.col("n") - m - 1, F.lit(0)))}, by)


def trimmed_mean_of(df: DataFrame, value: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the values between the order statistics floor(fraction n) and n - 1 - floor(fraction n), ties kept."""
    x = to_nan(F.col(value))
    rows = with_statistics(df.select(*by, x.alias("_v")), _trim_bounds(df, value, fraction, by), by)
    inside = F.avg(F.when(F.col("_v").between(F.col("lo"), F.col("hi")), F.col("_v")))
    return rows.groupBy(*by).agg(F.when(F.max("has_nan"), F.lit(NAN)).otherwise(inside).alias("trimmed_mean"))


def winsorized_mean_of(df: DataFrame, value: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean after clamping to the same two order statistics."""
    x = to_nan(F.col(value))
    rows = with_statistics(df.select(*by, x.alias("_v")), _trim_bounds(df, value, fraction, by), by)
    clamped = F.avg(F.least(F.greatest(F.col("_v"), F.col("lo")), F.col("hi")))
    return rows.groupBy(*by).agg(F.when(F.max("has_nan"), F.lit(NAN)).otherwise(clamped).alias("winsorized_mean"))


def select_kth(df: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k-th smallest value (from 0), null where a group has fewer."""
    x = to_null(F.col(value))
    n = df.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    if not by:
        total = n.collect()[0]["n"]
        share = k / max(total - 1, 1)
        return order_statistics(df, value, {"kth": (min(share, 1.0), F.lit(k))}).select("kth")
    # the rank is fixed, so its share differs between groups: rows per value, ranked within the group
    counted = df.select(*by, x.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*by).orderBy("v"))
    return counted.withColumn("_u", upto).groupBy(*by).agg(F.min(F.when(F.col("_u") > k, F.col("v"))).alias("kth"))


def select_two(df: DataFrame, value: str, k1: int, k2: int) -> DataFrame:
    """Two order statistics at once."""
    total = df.where(to_null(F.col(value)).isNotNull()).count()
    share = [min(k / max(total - 1, 1), 1.0) for k in (k1, k2)]
    return order_statistics(df, value, {"lower": (share[0], F.lit(k1)), "upper": (share[1], F.lit(k2))}).select("lower", "upper")


# dense groups ----------------------------------------------------------------------------------------------------


def dense_groups(df: DataFrame, value: str, group: str, n_groups: int, whole_nan: bool = False) -> DataFrame:
    """Sum, mean and population variance for the groups 0 .. n_groups - 1: ``g``, ``group_sum``, ``group_mean``, ``group_var``.

    Rows whose group lies outside are left out; empty groups have sum 0 and NaN mean and variance. NaN makes its
    group NaN, or with ``whole_nan`` every group.
    """
    inside = df.select(F.col(group).cast("long").alias("g"), to_nan(F.col(value)).alias("x"))
    part = inside.where(F.col("g").between(0, n_groups - 1)).groupBy("g").agg(F.sum("x").alias("s"), F.avg("x").alias("m"), _guard(F.col("x"), F.var_pop("x")).alias("v"))
    out = df.sparkSession.range(n_groups).withColumnRenamed("id", "g").join(part, "g", "left")
    out = out.select("g", F.coalesce("s", F.lit(0.0)).alias("group_sum"), F.coalesce("m", F.lit(NAN)).alias("group_mean"), F.coalesce("v", F.lit(NAN)).alias("group_var"))
    if whole_nan:
        bad = inside.agg(F.coalesce(F.max(F.isnan("x")), F.lit(False)).alias("_bad"))
        out = out.crossJoin(F.broadcast(bad)).select("g", *[F.when(F.col("_bad"), F.lit(NAN)).otherwise(F.col(c)).alias(c) for c in ("group_sum", "group_mean", "group_var")])
    return out


# masked ----------------------------------------------------------------------------------------------------------


def masked_reduce(df: DataFrame, value: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """``sum``, ``mean``, sample ``var`` and ``n_valid`` of the rows whose mask is not zero.

    NaN in a valid row gives NaN, as do groups without valid rows; variance needs two valid rows.
    """
    v = F.when(F.col(mask).cast("int") != 0, to_nan(F.col(value)))
    n, bad = F.count(v), F.coalesce(F.max(F.isnan(v)), F.lit(False))

    def guarded(result: Column, least: int = 1) -> Column:
        return F.when(bad | (n < least), F.lit(NAN)).otherwise(result)

    return df.groupBy(*by).agg(guarded(F.sum(v)).alias("sum"), guarded(F.avg(v)).alias("mean"), guarded(F.var_samp(v), 2).alias("var"), n.alias("n_valid"))


def masked_median_mad(df: DataFrame, value: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """``median`` and ``mad`` of the valid rows, NaN dropped; groups without valid rows are missing."""
    return mad_of(df.where((F.col(mask).cast("int") != 0) & to_null(F.col(value)).isNotNull()), value, by)
