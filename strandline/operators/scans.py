"""Lags, cumulative scans, fills, convolution and exponentially weighted statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from strandline.functions.ieee import NAN, ieee_div, ieee_ln, to_nan, to_null
from strandline.operators.blocks import blocks, prefix_scan
from strandline.runtime import column_numpy, key_codes, materialize, whole_groups


def lagged(df: DataFrame, value: str, order: Sequence[str], series: Sequence[str] = (), kind: str = "lag", k: int = 1, out: str = "out", whole_rows: int | None = None) -> DataFrame:
    """``kind``: lag (x k rows before), diff (x minus it), log_return, pct_change (against the row before). NaN where there is none."""
    if k < 1:
        raise ValueError("k must be at least 1")
    b = blocks(df, order, series, look_back=k, whole_rows=whole_rows)
    x = to_nan(F.col(value))
    b.df = b.df.withColumn("_x", x)
    b.df = b.df.withColumn("_p", F.coalesce(F.lag("_x", k).over(b.window()), F.lit(NAN)))
    x, p = F.col("_x"), F.col("_p")
    made = {"lag": p, "diff": x - p, "log_return": ieee_ln(ieee_div(x, p)), "pct_change": ieee_div(x - p, p)}
    if kind not in made:
        raise ValueError(f"unknown kind {kind}")
    b.df = b.df.withColumn(out, made[kind])
    return b.finish(["_x", "_p"])


def cumulative(df: DataFrame, value: str, order: Sequence[str], series: Sequence[str] = (), kind: str = "sum", out: str = "out", whole_rows: int | None = None) -> DataFrame:
    """Running ``sum``, ``sum_exclusive``, ``min``, ``max``, or ``fill_forward``/``fill_backward``.

    A NaN makes all later sums NaN. Running extremes skip NaN, unless a series begins with one: then all are NaN.
    Fills take the nearest value before (after); what has none stays NaN.
    """
    x, xn = to_nan(F.col(value)), to_null(F.col(value))
    asc = F.struct(*order)
    if kind in ("sum", "sum_exclusive"):
        before = F.coalesce(F.col("_carry"), F.lit(0.0)) + F.coalesce(F.col("_local"), F.lit(0.0))

        def local(run: WindowSpec) -> dict[str, Column]:
            return {"_local": F.sum(x).over(run if kind == "sum" else run.rowsBetween(W.unboundedPreceding, -1))}

        return prefix_scan(df, order, series, local, {"_total": F.sum(x)}, lambda back: {"_carry": F.sum("_total").over(back)}, {out: before}, whole_rows)
    if kind in ("min", "max"):
        agg = F.min if kind == "min" else F.max
        pick = F.least if kind == "min" else F.greatest

        def local(run: WindowSpec) -> dict[str, Column]:
            return {"_local": agg(xn).over(run), "_lead": F.first(F.isnan(x)).over(run)}

        return prefix_scan(
            df, order, series, local, {"_total": agg(xn), "_first": F.min_by(F.isnan(x), asc)}, lambda back: {"_carry": agg("_total").over(back), "_head": F.first("_first").over(back)},
            {out: F.when(F.coalesce("_head", "_lead"), F.lit(NAN)).otherwise(F.coalesce(pick("_local", "_carry"), F.lit(NAN)))}, whole_rows,
        )
    if kind in ("fill_forward", "fill_backward"):
        back = kind == "fill_backward"
        def local(run: WindowSpec) -> dict[str, Column]:
            return {"_local": F.last(xn, ignorenulls=True).over(run)}

        near = F.max_by if not back else F.min_by
        total = {"_total": near(xn, F.when(xn.isNotNull(), asc))}
        return prefix_scan(df, order, series, local, total, lambda b: {"_carry": F.last("_total", ignorenulls=True).over(b)}, {out: F.coalesce("_local", "_carry", F.lit(NAN))}, whole_rows, reverse=back)
    raise ValueError(f"unknown kind {kind}")


def convolve_valid(df: DataFrame, value: str, kernel: Sequence[float], order: Sequence[str], series: Sequence[str] = (), out: str = "out", whole_rows: int | None = None) -> DataFrame:
    """Sum of kernel[j] x[i + j] (the kernel is not flipped), for the rows that have all of them ahead."""
    if not kernel:
        raise ValueError("the kernel is empty")
    m = len(kernel)
    b = blocks(df, order, series, look_ahead=m - 1, whole_rows=whole_rows)
    w = b.window()
    b.df = b.df.withColumn("_x", to_nan(F.col(value)))
    total = F.lit(0.0)
    for j, c in enumerate(kernel):
        total = total + (F.lead("_x", j).over(w) if j else F.col("_x")) * F.lit(float(c))
    b.df = b.df.withColumn(out, total).withColumn("_last", F.lead(F.lit(1), m - 1).over(w) if m > 1 else F.lit(1))
    own = b.finish(["_x"])
    return own.where("_last is not null").drop("_last")


def _ew_pass(b_df: DataFrame, keys: list[str], order: list[str], alpha: float, value: str, schema: T.StructType, summary: bool) -> DataFrame:
    """Exponentially weighted mean and variance of sorted groups, from the state the block starts with."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys, 200_000):
            at = np.append(np.flatnonzero(key_codes(t, keys)), t.num_rows)
            x = column_numpy(t, "_x")
            m0, v0, begin = column_numpy(t, "_m0"), column_numpy(t, "_v0"), column_numpy(t, "_first")
            mean, var = np.empty(len(x)), np.empty(len(x))
            for a, z in zip(at[:-1], at[1:]):
                s = x[a:z]
                start = s[0] if begin[a] else m0[a]
                m = pd.Series(np.concatenate([[start], s])).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
                d2 = (s - m[:-1]) ** 2 * alpha  # v = (1 - alpha) (v + alpha d^2), a weighted mean of alpha d^2 (1 - alpha) / alpha
                v = pd.Series(np.concatenate([[0.0 if begin[a] else v0[a]], d2 * (1 - alpha) / alpha])).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
                m = m[1:]
                bad = np.isnan(s) if not np.isnan(start) else np.ones(len(s), dtype=bool)
                if bad.any():
                    k = int(bad.argmax())
                    m[k:], v[k:] = np.nan, np.nan
                    if begin[a]:
                        v[0] = 0.0  # a series begins with variance 0, whatever its first value
                mean[a:z], var[a:z] = m, v
            if summary:
                ends = pa.array(at[1:] - 1)
                head = t.select(keys).take(ends)
                yield from head.append_column("_m", pa.array(mean[at[1:] - 1])).append_column("_v", pa.array(var[at[1:] - 1])).append_column("_n", pa.array(np.diff(at))).combine_chunks().to_batches()
            else:
                done = t.drop_columns(["_x", "_m0", "_v0", "_first"]).append_column("_m", pa.array(mean)).append_column("_v", pa.array(var))
                yield from done.combine_chunks().to_batches()

    return b_df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(kernel, schema)


def exponentially_weighted(df: DataFrame, value: str, alpha: float, order: Sequence[str], series: Sequence[str] = (), prefix: str = "ew_", whole_rows: int | None = None) -> DataFrame:
    """``<prefix>mean``, ``<prefix>var``, ``<prefix>std``: m = alpha x + (1 - alpha) m from the first value on, and its variance.

    A NaN makes everything after it NaN. Runs as an Arrow kernel over sorted partitions; a series too long for one
    task is run in blocks: the recurrences are affine in the state a block starts with, so a first pass gives each
    block's map, the states are chained over the short table of blocks, and a last pass fills in the rows.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    b = blocks(df, order, series, whole_rows=whole_rows)
    base = b.df.withColumn("_x", to_nan(F.col(value)))
    nil = F.lit(0.0)
    keep = [f for f in b.df.schema.fields]
    keys = list(b.keys)
    schema = T.StructType([*keep, T.StructField("_m", T.DoubleType()), T.StructField("_v", T.DoubleType())])
    if not b.split:
        rows = base.withColumn("_m0", nil).withColumn("_v0", nil).withColumn("_first", F.lit(True))
        done = _ew_pass(rows, b.keys, b.order, alpha, value, schema, False)
    else:
        part = T.StructType([*[b.df.schema[k] for k in b.keys], T.StructField("_m", T.DoubleType()), T.StructField("_v", T.DoubleType()), T.StructField("_n", T.LongType())])
        firsts = F.col("_block") == 1

        def chained(df_blocks: DataFrame, what: str) -> DataFrame:
            state = T.StructType([*[b.df.schema[k] for k in b.keys], T.StructField("_s", T.DoubleType())])

            def chain(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("_block")
                now, out = np.nan, []
                for i, (end, n) in enumerate(zip(pdf[what], pdf["_n"])):
                    out.append(now)
                    now = end if i == 0 else end + now * (1 - alpha) ** n
                return pdf[keys].assign(_s=out)

            grouped = df_blocks.groupBy(*b.series) if b.series else df_blocks.groupBy(F.lit(0))
            return grouped.applyInPandas(chain, state)  # one row per block

        def started(rows: DataFrame, states: DataFrame, name: str) -> DataFrame:
            right = states.withColumnsRenamed({k: f"_k_{k}" for k in b.keys}).withColumnRenamed("_s", name)
            on = F.lit(True)
            for k in b.keys:
                on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            return rows.join(right, on, "left").drop(*[f"_k_{k}" for k in b.keys])

        rows = base.withColumn("_m0", nil).withColumn("_v0", nil).withColumn("_first", firsts)
        means = materialize(chained(_ew_pass(rows, b.keys, b.order, alpha, value, part, True), "_m"), "states")
        rows = started(base, means, "_m0").withColumn("_v0", nil).withColumn("_first", firsts)
        variances = materialize(chained(_ew_pass(rows, b.keys, b.order, alpha, value, part, True), "_v"), "states")
        rows = started(started(base, means, "_m0"), variances, "_v0").withColumn("_first", firsts)
        rows = rows.select(*[f.name for f in keep], "_x", "_m0", "_v0", "_first")
        done = _ew_pass(rows, b.keys, b.order, alpha, value, schema, False)
    done = done.withColumn(f"{prefix}mean", F.col("_m")).withColumn(f"{prefix}var", F.col("_v")).withColumn(f"{prefix}std", F.sqrt(F.greatest(F.col("_v"), F.lit(0.0))))
    b.df = done
    return b.finish(["_m", "_v"])
