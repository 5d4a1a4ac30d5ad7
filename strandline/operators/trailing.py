"""Rolling totals over trailing calendar periods (two-stack monoid queue)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.runtime import column_numpy, key_codes, whole_groups

#: Days of one block; a long series is split into blocks that are worked on apart.
BLOCK_DAYS = 512


class TwoStackQueue:
    """FIFO queue with the combined value of its content at any time, for any monoid (no inverse needed).

    ``front`` holds suffix combinations of the older elements, ``back`` the combination of the newer ones;
    when ``front`` runs empty the newer elements are turned over into it, so an element is combined at most twice.
    """

    def __init__(self, combine: Callable[[Any, Any], Any], identity: Any) -> None:
        self.combine, self.identity = combine, identity
        self.front: list[Any] = []
        self.items: list[Any] = []
        self.back = identity

    def push(self, x: Any) -> None:
        self.items.append(x)
        self.back = self.combine(self.back, x)

    def pop(self) -> None:
        if not self.front:
            total = self.identity
            while self.items:
                total = self.combine(self.items.pop(), total)
                self.front.append(total)
            self.back = self.identity
        self.front.pop()

    def value(self) -> Any:
        return self.combine(self.front[-1] if self.front else self.identity, self.back)


def two_stack_windows(x: np.ndarray, w: int, combine: np.ufunc, identity: float) -> np.ndarray:
    """Combined value of the ``w`` elements that end at each position (fewer at the start).

    The queue's schedule for a full window: it turns over every ``w`` elements, so its front stack is a suffix
    scan and its back value a prefix scan of runs of ``w``; both scans are done for all runs at once.
    """
    n = len(x)
    if not n:
        return x.astype(float)
    runs = -(-n // w)
    padded = np.full(runs * w, identity, dtype=float)
    padded[:n] = x
    grid = padded.reshape(runs, w)
    back = combine.accumulate(grid, axis=1).ravel()
    front = combine.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    out = back[:n].copy()
    at = np.arange(w, n)
    at = at[at % w != w - 1]  # where a run has just ended, the window is that run
    out[at] = combine(front[at - w + 1], back[at])
    return out


def trailing_totals(
    df: DataFrame,
    entity: str,
    day: str,
    value: str,
    windows: Sequence[int] = (7, 30),
    record_id: str | None = None,
    valid: Column | None = None,
    fold_names: bool = True,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Totals of ``value`` over the last ``windows`` days for each entity and calendar day.

    Gives a row for each day from the first to the last record of an entity: ``entity``, ``day``, ``n_records``,
    ``n`` (records with a value), ``value`` (mean of the day), and for each window ``sum_w``, ``mean_w``, ``min_w``,
    ``max_w``, ``n_w``; they are null where the period holds no value.

    Null and NaN are no values, nor are those for which ``valid`` is not true. Names that are equal after trimming
    and lower-casing are one entity (``fold_names``). A null name is an entity of its own; rows without a day
    belong to no day and are left out. Rows with the same entity, day and ``record_id`` are one record, whose
    largest value counts. An empty table gives an empty result; other columns are ignored.

    One shuffle of the records by entity and block of days, whatever the number of windows. A long series is many
    blocks, each with the days before it that its windows reach, so an entity with a third of all rows is spread
    over many tasks.
    """
    reach = max(windows) - 1
    if min(windows) < 1 or reach >= block_days:
        raise ValueError("windows must be at least one day and shorter than a block")
    name = F.lower(F.trim(F.col(entity))) if fold_names else F.col(entity)
    x = F.col(value).cast("double")
    keep = ~F.isnan(x) if valid is None else (~F.isnan(x) & valid)
    rec = df.select(
        name.alias("e"),
        F.unix_date(F.col(day).cast("date")).alias("d"),
        F.when(keep, x).alias("v"),
        (F.col(record_id).cast("string") if record_id else F.monotonically_increasing_id().cast("string")).alias("id"),
    ).where(F.col("d").isNotNull())
    block = F.floor(F.col("d") / block_days).cast("int")
    markers = (
        rec.groupBy("e")
        .agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        .select("e", F.explode(F.sequence(F.floor(F.col("lo") / block_days), F.floor(F.col("hi") / block_days))).alias("b"), "lo", "hi")
        .select("e", F.col("b").cast("int").alias("b"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("id"), "lo", "hi")
    )
    spread = F.when(F.pmod(F.col("d"), F.lit(block_days)) >= block_days - reach, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rec.select("e", F.explode(spread).alias("b"), "d", "v", "id", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    daily = (
        rows.unionByName(markers)
        .repartition("e", "b")
        .groupBy("e", "b", "d", "id")
        .agg(F.max("v").alias("v"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("e", "b", "d")
        .agg(
            F.count("id").alias("recs"), F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("mn"), F.max("v").alias("mx"),
            F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        )
        .sortWithinPartitions("e", "b", "d")
    )
    fields = [T.StructField(entity, df.schema[entity].dataType), T.StructField(day, T.DateType()), T.StructField("n_records", T.LongType()), T.StructField("n", T.LongType()), T.StructField(value, T.DoubleType())]
    for w in windows:
        fields += [T.StructField(f"{k}_{w}", T.LongType() if k == "n" else T.DoubleType()) for k in ("sum", "mean", "min", "max", "n")]
    names = [f.name for f in fields]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["e", "b"]):
            first = np.flatnonzero(key_codes(t, ["e", "b"]))
            size = np.diff(np.append(first, t.num_rows))
            group = np.repeat(np.arange(len(first)), size)
            lo, hi = (np.maximum.reduceat(np.asarray(column_numpy(t, k, -(2**31) + 1), dtype=np.int64), first) for k in ("lo", "hi"))
            b = np.asarray(column_numpy(t, "b"), dtype=np.int64)[first]
            marked = lo > -(2**31) + 1
            begin = np.maximum(b * block_days, lo)
            end = np.minimum(b * block_days + block_days - 1, hi)
            span = np.where(marked, end - begin + 1 + reach, 0)
            offset = np.concatenate([[0], np.cumsum(span)])
            total = int(offset[-1])
            if not total:
                continue
            d = np.asarray(column_numpy(t, "d", -(2**31) + 1), dtype=np.int64)
            at = d - (begin - reach)[group]
            use = marked[group] & (d > -(2**31) + 1) & (at >= 0) & (at < span[group])
            place = offset[group[use]] + at[use]

            def flat(k: str, empty: float, use=use, place=place, t=t, total=total) -> np.ndarray:
                out = np.full(total, float(empty))
                out[place] = np.asarray(column_numpy(t, k, empty), dtype=float)[use]
                return out

            recs, n, s, mn, mx = flat("recs", 0), flat("n", 0), flat("s", 0), flat("mn", np.inf), flat("mx", -np.inf)
            seg = np.repeat(np.arange(len(first)), span)
            within = np.arange(total) - offset[seg]
            out_rows = np.flatnonzero(within >= reach)
            seg, within = seg[out_rows], within[out_rows]
            days = (begin - reach)[seg] + within
            with np.errstate(divide="ignore", invalid="ignore"):
                cols: list[pa.Array] = [
                    t.column("e").combine_chunks().take(pa.array(first[seg])),
                    pa.array(days.astype("int32")).cast(pa.date32()),
                    pa.array(recs[out_rows].astype("int64")),
                    pa.array(n[out_rows].astype("int64")),
                    pa.array((s / n)[out_rows], mask=n[out_rows] == 0),
                ]
                for w in windows:
                    nw = two_stack_windows(n, w, np.add, 0)[out_rows]
                    none = nw == 0
                    sw = two_stack_windows(s, w, np.add, 0)[out_rows]
                    cols += [pa.array(sw, mask=none), pa.array(sw / nw, mask=none)]
                    cols += [pa.array(two_stack_windows(mn, w, np.minimum, np.inf)[out_rows], mask=none)]
                    cols += [pa.array(two_stack_windows(mx, w, np.maximum, -np.inf)[out_rows], mask=none)]
                    cols += [pa.array(nw.astype("int64"))]
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return daily.mapInArrow(kernel, T.StructType(fields))
