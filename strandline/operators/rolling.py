"""Trailing windows of a fixed number of rows, the current row included."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.ieee import NAN, beyond, ieee_div, median_of_sorted, to_nan, to_null
from strandline.operators.blocks import blocks
from strandline.runtime import column_numpy

SUMS = ("sum", "mean", "var", "std", "count")
SORTED = ("median", "mad", "median_upper", "mad_upper", "robust_zscore", "anomaly")
#: Values of windows that are laid out side by side at a time.
_AT_ONCE = 500_000


def _middle_kernel(window: int, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Appends ``_ok`` (the window is full and free of NaN) and ``names`` of ``_med``, ``_mad``, ``_upper``, ``_away_upper``, null where not ok.

    Rows come series by series in order, with their value ``_x`` and their number ``_k`` in the series, from 1. Only the
    last values are kept from one batch to the next, so memory does not grow with a series.
    """
    lo, hi = (window - 1) // 2, window // 2

    def middle(v: np.ndarray, low: int) -> np.ndarray:
        s = np.partition(v, sorted({low, hi}), axis=1)
        return s[:, hi] if low == hi else (s[:, low] + s[:, hi]) / 2

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = np.empty(0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            k = column_numpy(t, "_k")
            if not np.all((k == 1) | (k == np.append(last, k[:-1]) + 1)):
                raise ValueError("rows of a window are out of order")
            x, held = np.append(before, column_numpy(t, "_x")), len(before)
            bad = np.append(0, np.cumsum(np.isnan(x)))
            at = np.flatnonzero(k >= window) + held  # a full window lies within what is held and the batch
            at = at[bad[at + 1] == bad[at + 1 - window]]
            made = {n: np.full(len(k), np.nan) for n in names}
            step = max(_AT_ONCE // window, 1)
            with np.errstate(invalid="ignore", over="ignore"):
                for a in range(0, len(at), step):
                    here = at[a : a + step]
                    v = np.lib.stride_tricks.sliding_window_view(x, window)[here + 1 - window]
                    for near, away, low in (("_med", "_mad", lo), ("_upper", "_away_upper", hi)):
                        if near in made or away in made:
                            m = middle(v, low)
                            if near in made:
                                made[near][here - held] = m
                            if away in made:
                                made[away][here - held] = middle(np.abs(v - m[:, None]), low)
            ok = np.zeros(len(k), dtype=bool)
            ok[at - held] = True
            t = t.append_column("_ok", pa.array(ok))
            for n in names:
                t = t.append_column(n, pa.array(made[n], mask=~ok))
            yield from t.combine_chunks().to_batches()
            before, last = x[max(len(x) - window + 1, 0) :], int(k[-1])

    return kernel


def rolling(
    df: DataFrame, value: str, window: int, order: Sequence[str], series: Sequence[str] = (), stats: Sequence[str] = ("mean",), mask: str | None = None,
    prefix: str = "rolling_", full_only: bool = False, threshold: float = 3.0, whole_rows: int | None = None, strict_mask: bool = False,
) -> DataFrame:
    """``df`` with a column ``<prefix><stat>`` for each of ``stats`` over the last ``window`` rows of each series.

    sum, mean, var, std (population), count: NaN and null are skipped, windows at the start are shorter, a window without
    values gives NaN (``full_only``: shorter windows give NaN). zscore: (x - mean) / std with NaN skipped, NaN
    where x is NaN, where the window is short or the std vanishes. median, mad, robust_zscore (0.6745 (x - median) /
    MAD, 0 where the MAD vanishes): NaN for short windows and for any NaN in the window; median_upper and mad_upper
    take the upper of two middle values. anomaly: |x - median| > ``threshold`` 1.4826 MAD; anomaly_std: |x - mean| >
    ``threshold`` std; both false for short windows. mean_masked, median_masked: of the rows whose ``mask`` is not zero and
    whose value is not NaN, shorter windows at the start; with ``strict_mask`` a NaN or null in a valid row fails the query.

    Windows longer than a series give only short windows. Rows must be in a total order by ``order``; ties are broken
    at random. One shuffle by series and one sort for all statistics; medians and MADs are an Arrow kernel over the sorted
    rows. A series too long for one task is worked on in blocks, see :func:`strandline.operators.blocks.blocks`.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    if mask is None and any(s.endswith("_masked") for s in stats):
        raise ValueError("masked statistics need a mask")
    b = blocks(df, order, series, look_back=window - 1, whole_rows=whole_rows)
    w = b.trailing(window)
    x, xn = to_nan(F.col(value)), to_null(F.col(value))
    full = F.count(F.lit(1)).over(w) == window
    need = set(stats)
    if strict_mask and mask is not None:
        bad = (F.col(mask).cast("int") != 0) & F.isnan(x)
        xn = F.when(bad, F.raise_error(F.lit("a valid row holds no number")).cast("double")).otherwise(xn)
    out = b.df.withColumn("_x", x).withColumn("_xn", xn)
    helpers = ["_x", "_xn"]

    def add(name: str, c: Column) -> None:
        nonlocal out
        out = out.withColumn(name, c)
        helpers.append(name)

    add("_full", full)
    if need & {"sum", "mean", "var", "std", "zscore", "anomaly_std", "count"}:
        add("_n", F.count("_xn").over(w))
    if "sum" in need:
        add("_sum", F.sum("_xn").over(w))
    if need & {"mean", "zscore", "anomaly_std"}:
        add("_mean", F.avg("_xn").over(w))
    if need & {"var", "std", "zscore", "anomaly_std"}:
        add("_var", F.var_pop("_xn").over(w))
    if "mean_masked" in need:
        add("_mean_masked", F.avg(F.when(F.col(mask).cast("int") != 0, F.col("_xn"))).over(w))
    if "median_masked" in need:
        add("_kept", F.sort_array(F.collect_list(F.when(F.col(mask).cast("int") != 0, F.col("_xn"))).over(w)))
    if need & set(SORTED):
        wanted = {"_med": need & {"median", "robust_zscore", "anomaly"}, "_mad": need & {"mad", "robust_zscore", "anomaly"}, "_upper": need & {"median_upper"}, "_away_upper": need & {"mad_upper"}}
        names = [n for n, used in wanted.items() if used]
        # the window of the row numbers is what brings the rows of a series together in order
        out = out.withColumn("_k", F.row_number().over(b.window()))
        kinds = [T.StructField("_ok", T.BooleanType()), *[T.StructField(n, T.DoubleType()) for n in names]]
        out = out.mapInArrow(_middle_kernel(window, names), T.StructType([*out.schema.fields, *kinds]))
        helpers += ["_k", "_ok", *names]
    short = F.lit(full_only) & ~F.col("_full")

    def shown(ok: Column, c: Column) -> Column:
        return F.when(ok & ~short, F.coalesce(c, F.lit(NAN))).otherwise(F.lit(NAN))

    made: dict[str, Column] = {}
    for s in stats:
        if s == "sum":
            made[s] = shown(F.col("_n") > 0, F.col("_sum"))
        elif s == "mean":
            made[s] = shown(F.col("_n") > 0, F.col("_mean"))
        elif s == "var":
            made[s] = shown(F.col("_n") > 0, F.col("_var"))
        elif s == "std":
            made[s] = shown(F.col("_n") > 0, F.sqrt("_var"))
        elif s == "count":
            made[s] = F.col("_n")
        elif s == "zscore":
            std = F.sqrt("_var")
            made[s] = F.when(F.col("_full") & ~F.isnan("_x") & (std > 1e-10), ieee_div(F.col("_x") - F.col("_mean"), std)).otherwise(F.lit(NAN))
        elif s == "median":
            made[s] = shown(F.col("_ok"), F.col("_med"))
        elif s == "mad":
            made[s] = F.when(F.col("_ok"), F.when(F.col("_mad") < 1e-12, 0.0).otherwise(F.col("_mad"))).otherwise(F.lit(NAN))
        elif s == "median_upper":
            made[s] = shown(F.col("_ok"), F.col("_upper"))
        elif s == "mad_upper":
            made[s] = shown(F.col("_ok"), F.col("_away_upper"))
        elif s == "robust_zscore":
            z = F.lit(0.6745) * (F.col("_x") - F.col("_med")) / F.col("_mad")
            made[s] = F.when(F.col("_ok"), F.when(F.col("_mad") <= 1e-10, 0.0).otherwise(z)).otherwise(F.lit(NAN))
        elif s == "anomaly":
            z = F.abs(F.col("_x") - F.col("_med")) / (F.lit(1.4826) * F.col("_mad"))
            made[s] = F.coalesce(F.col("_ok") & (F.col("_mad") >= 1e-12) & (z > threshold), F.lit(False))
        elif s == "anomaly_std":
            std = F.sqrt("_var")
            made[s] = F.coalesce(F.col("_full") & (F.col("_n") >= 2) & (std > 0) & beyond(ieee_div(F.col("_x") - F.col("_mean"), std), threshold), F.lit(False))
        elif s == "mean_masked":
            made[s] = F.coalesce("_mean_masked", F.lit(NAN))
        elif s == "median_masked":
            made[s] = F.coalesce(median_of_sorted(F.col("_kept")), F.lit(NAN))
        else:
            raise ValueError(f"unknown statistic {s}")
    out = out.withColumns({f"{prefix}{s}": c for s, c in made.items()})
    b.df = out
    return b.finish(helpers)


def rolling_arrays(df: DataFrame, array: str, window: int, order: Sequence[str], stats: Sequence[str] = ("mean",), full_only: bool = True, whole_rows: int | None = None) -> DataFrame:
    """Windows down the rows of a matrix, per array position: rows (order columns, ``pos``, statistics)."""
    long = df.select(*order, F.posexplode(array).alias("pos", "_value"))
    return rolling(long, "_value", window, order, ["pos"], stats, full_only=full_only, whole_rows=whole_rows).drop("_value")
