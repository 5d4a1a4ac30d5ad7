"""Ordered series in blocks: windows over a hot or un-partitioned series without collecting it into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from strandline.functions.times import utc_micros
from strandline.runtime import materialize

#: Rows up to which a series is worked on whole.
WHOLE_ROWS = 4_000_000
#: For ``whole_rows``: the caller has counted, no series is longer than a task can hold.
KNOWN_SHORT = 1 << 62


@dataclass
class Blocks:
    """Rows of series in blocks. ``keys`` partition windows; ``own`` is false for rows that a block only looks at."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    series: list[str]
    split: bool

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(*self.order)

    def trailing(self, rows: int) -> WindowSpec:
        return self.window().rowsBetween(-(rows - 1), 0)

    def finish(self, drop: Sequence[str] = ()) -> DataFrame:
        """Own rows only, without helper columns."""
        out = self.df.where("_own") if self.split else self.df
        return out.drop("_own", "_block", *drop)


def longest(df: DataFrame, series: Sequence[str]) -> int:
    """Rows of the longest series (a count with partial aggregates)."""
    found = df.groupBy(*series).agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0]
    return int(found or 0)


def _position(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return utc_micros(df, name).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise ValueError(f"a long series must be ordered by a number or time first, not by {name}")


def with_reach(plan: DataFrame, run: WindowSpec, series: Sequence[str], n: str, block: str, look_back: int, look_ahead: int, out: str) -> DataFrame:
    """``plan`` (slices with ``n`` rows each and their ``block``; ``run`` is its window by ``series`` in order) with the
    numbers of the blocks that need each slice: its own, the later ones that begin fewer than ``look_back`` rows after it
    and the earlier ones that end fewer than ``look_ahead`` rows before it.
    """
    plan = plan.withColumns({"_upto": F.sum(n).over(run), "_next": F.coalesce(F.lead(block).over(run), block), "_last": F.coalesce(F.lag(block).over(run), block)})
    plan = plan.withColumn("_from", F.col("_upto") - F.col(n))
    near = W.partitionBy(*series)
    first = last = F.col(block)
    if look_back > 0:
        last = F.max("_next").over(near.orderBy("_upto").rangeBetween(0, look_back - 1))
    if look_ahead > 0:
        first = F.min("_last").over(near.orderBy("_from").rangeBetween(1 - look_ahead, 0))
    return plan.withColumn(out, F.sequence(first, last)).drop("_upto", "_next", "_last", "_from")


def blocks(df: DataFrame, order: Sequence[str], series: Sequence[str] = (), look_back: int = 0, look_ahead: int = 0, whole_rows: int | None = None) -> Blocks:
    """Prepare ``df`` for windows of bounded reach over each series (``series`` columns, in the order of ``order``).

    Series of up to ``whole_rows`` rows are windows by ``series`` as usual. If one is longer, rows are counted by
    series and slice of the first order column; consecutive slices form blocks of about ``whole_rows`` rows, and each
    slice whose rows another block's windows reach is sent to that block too. So no task holds more than a
    block, whatever share of the rows a series has. The rows are written out once before they are sliced. Rows with equal order columns must not matter to the caller.
    """
    order, series = list(order), list(series)
    limit = WHOLE_ROWS if whole_rows is None else whole_rows
    if limit == KNOWN_SHORT or longest(df, series) <= limit:
        keys = series
        if not series:
            df, keys = df.withColumn("_block", F.lit(0)), ["_block"]
        return Blocks(df, keys, order, series, False)
    df = materialize(df, "series")  # read several times below
    where = _position(df, order[0])
    lo, hi, n = df.agg(F.min(where), F.max(where), F.count("*")).collect()[0]
    width = max((hi - lo) / min(max(32 * n // limit, 64), 1_000_000), 1e-9) if lo is not None else 1.0
    sliced = df.withColumn("_slice", F.coalesce(F.floor((where - F.lit(lo if lo is not None else 0.0)) / F.lit(width)), F.lit(-1)))
    count = sliced.groupBy(*series, "_slice").agg(F.count("*").alias("_n"))
    run = W.partitionBy(*series).orderBy("_slice") if series else W.orderBy("_slice")  # at most a million slices
    plan = count.withColumn("_block", F.floor((F.sum("_n").over(run) - F.col("_n")) / limit))
    plan = plan.withColumn("_block", F.dense_rank().over(W.partitionBy(*series).orderBy("_block") if series else W.orderBy("_block")))
    # a block can be short (after a slice of many rows), so a slice goes as many blocks on as its rows are within reach
    plan = with_reach(plan, run, series, "_n", "_block", look_back, look_ahead, "_goes")
    plan = plan.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(series)], F.col("_slice").alias("_p"), F.col("_block").alias("_home"), "_goes")
    on = sliced["_slice"] == plan["_p"]
    for i, s in enumerate(series):
        on = on & sliced[s].eqNullSafe(plan[f"_s{i}"])
    placed = sliced.join(plan, on).withColumn("_block", F.explode("_goes")).withColumn("_own", F.col("_block") == F.col("_home"))
    placed = placed.drop("_slice", "_p", "_goes", "_home", *[f"_s{i}" for i in range(len(series))])
    return Blocks(placed, [*series, "_block"], order, series, True)


def prefix_scan(
    df: DataFrame, order: Sequence[str], series: Sequence[str], local: Callable[[WindowSpec], dict[str, Column]], total: dict[str, Column], carry: Callable[[WindowSpec], dict[str, Column]], merge: dict[str, Column], whole_rows: int | None = None, reverse: bool = False
) -> DataFrame:
    """A scan from the start of each series: per block, then corrected by what the blocks before it carry over.

    ``local``: columns over the running window of a block. ``total``: aggregates of a block's rows. ``carry``: those
    combined over the blocks before (a window over the short table of blocks; null for the first). ``merge``: the
    final columns from local and carried ones. ``reverse`` scans from the end.
    """
    b = blocks(df, order, series, whole_rows=whole_rows)
    way = [F.col(o).desc() if reverse else F.col(o).asc() for o in b.order]
    run = W.partitionBy(*b.keys).orderBy(*way).rowsBetween(W.unboundedPreceding, 0)
    out = b.df.withColumns(local(run))
    if b.split:
        sums = b.df.groupBy(*b.keys).agg(*[c.alias(k) for k, c in total.items()])
        turn = F.col("_block").desc() if reverse else F.col("_block").asc()
        back = (W.partitionBy(*b.series).orderBy(turn) if b.series else W.orderBy(turn)).rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select(*[F.col(k).alias(f"_c_{k}") for k in b.keys], *[c.alias(k) for k, c in carry(back).items()])
        on = F.lit(True)
        for k in b.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        out = out.join(sums, on, "left").drop(*[f"_c_{k}" for k in b.keys])
    else:
        kinds = b.df.agg(*[c.alias(k) for k, c in total.items()]).select(*[c.alias(k) for k, c in carry(W.orderBy(F.lit(1))).items()]).schema
        out = out.withColumns({f.name: F.lit(None).cast(f.dataType) for f in kinds.fields})
    names = list(local(run)) + list(carry(run))
    out = out.withColumns(merge)
    keep = [c for c in out.columns if c not in set(names) - set(merge)]
    return Blocks(out.select(*keep), b.keys, b.order, b.series, b.split).finish()
