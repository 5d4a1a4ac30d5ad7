"""Running statistics over streams: state of constant size per series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_ewma(stream: DataFrame, value: str, order: str, series: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean and variance, running minimum, maximum, sum and count of each series of a stream.

    Rows of a batch are taken in ``order`` within their series, batches as they come; the state of a series is seven
    numbers. NaN and null make the weighted statistics NaN from there on, and are passed over by the others.
    Columns: ``series``, ``order``, ``value``, ``ewma``, ``ewvar``, ``low``, ``high``, ``total``, ``n``.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    rows = stream.select(F.col(series).cast("string").alias("series"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["order"].dataType.simpleString()
    out = f"series string, order {kind}, value double, ewma double, ewvar double, low double, high double, total double, n long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, v, low, high, total, n, seen = state.get if state.exists else (0.0, 0.0, np.inf, -np.inf, 0.0, 0, False)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("order", kind="stable", ignore_index=True)
        cols = {c: [] for c in ("ewma", "ewvar", "low", "high", "total", "n")}
        for x in pdf["value"].to_numpy(dtype=float):
            if seen:
                d = x - m
                m, v = m + alpha * d, (1 - alpha) * (v + alpha * d * d)
            else:
                m, v, seen = x, 0.0 * x, True
            if x == x:
                low, high, total, n = min(low, x), max(high, x), total + x, n + 1
            for c, y in zip(cols, (m, v, low, high, total, n)):
                cols[c].append(y)
        state.update((float(m), float(v), float(low), float(high), float(total), int(n), bool(seen)))
        yield pdf.assign(**cols)[["series", "order", "value", *cols]]

    return rows.groupBy("series").applyInPandasWithState(step, out, "m double, v double, low double, high double, total double, n long, seen boolean", "append", GroupStateTimeout.NoTimeout)


def streaming_windows(stream: DataFrame, value: str, time: str, series: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Sum, mean, standard deviation, minimum and maximum per series and time window; rows later than ``late`` are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    x = F.when(~F.isnan(F.col(value)), F.col(value))
    grouped = stream.withWatermark(time, late).groupBy(F.col(series).alias("series"), window.alias("window"))
    return grouped.agg(F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))
