"""Implausible measurements: impossible, stuck and spiking values (Kalman innovations per source)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandline.functions.kalman import local_level_innovations
from strandline.functions.times import utc_micros
from strandline.operators.blocks import with_reach
from strandline.runtime import column_numpy, key_codes, materialize, whole_groups

DAY_US = 86_400_000_000
#: Readings of one chunk of a source, and readings beside a chunk that its filter also sees.
CHUNK, MARGIN = 16_384, 96
#: Standardised innovation that opens an excursion; those a little larger are withheld from the filter.
OPENS = 3.0
#: Readings in a row with one value that make a sensor stuck; readings within which a spike is over.
STUCK_RUN, SPIKE_RUN = 12, 6


@dataclass(frozen=True)
class Readings:
    """A table of readings: columns and the limits outside which a value is impossible."""

    name: str
    df: DataFrame
    source: str
    time: str
    record_id: str
    value: str
    lo: float
    hi: float


def _median_without(y: np.ndarray, reach: int, skip: np.ndarray) -> np.ndarray:
    """Median of the ``reach`` usable values before and after each position, those in ``skip`` not counted."""
    keep = np.flatnonzero(~skip)
    if len(keep) < 3:
        return np.full(len(y), np.nan)
    at = np.searchsorted(keep, np.arange(len(y)))
    after = at + (~skip)[np.minimum(np.arange(len(y)), len(y) - 1)]
    cols = np.concatenate([at[:, None] + np.arange(-reach, 0)[None, :], after[:, None] + np.arange(reach)[None, :]], axis=1)
    out = np.where((cols >= 0) & (cols < len(keep)), y[keep[np.clip(cols, 0, len(keep) - 1)]], np.nan)
    out.sort(axis=1)
    n = (~np.isnan(out)).sum(axis=1)
    i = np.arange(len(y))
    return np.where(n > 0, (out[i, np.maximum((n - 1) // 2, 0)] + out[i, np.maximum(n // 2, 0).clip(max=out.shape[1] - 1)]) / 2, np.nan)


def scatter_and_walk(y: np.ndarray) -> tuple[float, float]:
    """Variance of readings about their level, and of the level's step, both robust."""
    if len(y) < 8:
        return np.nan, np.nan
    res = y - _median_without(y, 5, np.zeros(len(y), dtype=bool))
    res = res[~np.isnan(res)]
    s = 1.4826 * np.median(np.abs(res)) / np.sqrt(1 + 1.57 / 10)  # the median of ten has variance 1.57 / 10 of its own
    steps = np.abs(np.diff(np.unique(y)))
    grain = steps.min() if len(steps) else 0.0
    s = max(s, grain / np.sqrt(12), 1e-6 * (1 + np.abs(np.median(y))))
    d1 = 1.4826 * np.median(np.abs(np.diff(y)))
    return s * s, max(d1 * d1 - 2 * s * s, 0.003 * s * s)


def vanished_variance(innovations: np.ndarray, window: int) -> np.ndarray:
    """Which readings lie in a run of ``window`` readings or more over which the innovation variance is nothing.

    ``innovations``: those of a filter that follows every reading (a walk read without noise), so a reading's innovation is
    its difference from the one before; the first has none (NaN). The run's first reading belongs to it.
    """
    n = len(innovations)
    out = np.zeros(n, dtype=bool)
    if n < window:
        return out
    power = np.append(0, np.cumsum(innovations != 0))  # NaN counts, so no window begins before the first reading
    still = np.flatnonzero(power[window:] == power[1 : n - window + 2])  # the window's readings after its first
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, still, 1)
    np.add.at(edge, still + window, -1)
    return np.cumsum(edge)[:n] > 0


def spike_mask(y: np.ndarray, z: np.ndarray, variance: float, candidate: float, threshold: float, opens: float = OPENS) -> np.ndarray:
    """Which readings are spikes: excursions that hold a gated innovation and end within a few readings.

    ``z``: standardised innovations of the filters forwards and backwards, two rows. A reading with one beyond ``opens``
    opens an excursion; without any there is no spike. The excursion is the readings on end that are candidates or far
    from the level around them; those of its readings are flagged that the median of the readings around it, candidates
    left out, confirms to be beyond ``threshold`` scatters.
    """
    out = np.zeros(len(y), dtype=bool)
    s = np.sqrt(variance)
    size = np.abs(np.nan_to_num(z)).max(axis=0)
    gated = size > opens
    if not gated.any():
        return out
    skip = np.abs(np.nan_to_num(z[0])) > candidate  # withheld forwards
    for _ in range(2):
        level = _median_without(y, 5, skip)
        far = np.nan_to_num(np.abs(y - level)) > threshold * s
        if not far.any():
            return out
        skip = far | (skip & (np.abs(y - level) > candidate * s))
    far = np.nan_to_num(np.abs(y - _median_without(y, 5, skip))) > threshold * s
    # a spike is short: neighbouring far values on end are one excursion
    edge = np.flatnonzero(np.diff(np.concatenate([[0], skip.astype(int), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a <= SPIKE_RUN and gated[a:b].any():
            out[a:b] = far[a:b]
    return out


def implausible_readings(tables: Sequence[Readings], candidate: float = 4.0, threshold: float = 8.0, chunk: int = CHUNK) -> DataFrame:
    """Readings that are impossible, stuck or spikes, measured against what is normal for their source.

    Gives one row per flagged record: ``table_name``, ``source``, ``record_id``, ``value``, ``reason``
    ('impossible', 'stuck' or 'spike', the first that holds) and ``z``, its standardised innovation.

    A local-level Kalman filter runs over each source's readings in order of time and id, and another one against it; their noise is the
    source's robust scatter about its level and the level's walk. Innovations beyond ``candidate`` are gated: withheld
    from the filter; after a few withheld in a row the level has moved and the filter starts again. An innovation beyond 3 in either
    direction opens an excursion. It is a spike where it ends within a few readings and they are confirmed to lie further than
    ``threshold`` scatters from the median of the readings around, gated ones left out. Where the innovation variance of
    a filter that follows every reading is nothing over 12 or more readings, missing values passed over, these
    are stuck. Impossible and stuck readings are kept from the level's filters.

    Null and NaN are passed over. Rows with the same source, time and id are one record. Null sources are one
    source; rows without time or id are left out. Sources with fewer than eight readings have no spikes. Empty
    tables give no rows.

    Two shuffles: by source and day, whose result is written once, counted and looked up with its chunk, then by source and chunk. A source with a
    third of all rows becomes many chunks of ``chunk`` readings, each seeing at least 96 readings on either side (from as
    many chunks as it takes),
    so runs and spikes at the edges are whole.
    """
    parts = []
    for i, t in enumerate(tables):
        x = F.col(t.value).cast("double")
        parts.append(
            t.df.select(
                F.lit(i).alias("tab"), F.col(t.source).cast("string").alias("src"), utc_micros(t.df, t.time).alias("t"),
                F.col(t.record_id).cast("long").alias("rid"), x.alias("y"),
            ).where(~F.isnan("y") & F.col("y").isNotNull() & F.col("t").isNotNull() & F.col("rid").isNotNull())
        )
    rec = parts[0]
    for p in parts[1:]:
        rec = rec.unionByName(p)
    rec = rec.withColumn("day", F.floor(F.col("t") / DAY_US).cast("int")).repartition("tab", "src", "day")
    rec = materialize(rec.groupBy("tab", "src", "day", "t", "rid").agg(F.max("y").alias("y")), "readings")
    per_day = rec.groupBy("tab", "src", "day").agg(F.count("*").alias("n"))
    by = W.partitionBy("tab", "src").orderBy("day")
    plan = per_day.withColumn("c", F.floor((F.sum("n").over(by) - F.col("n")) / chunk)).withColumn("c", F.dense_rank().over(W.partitionBy("tab", "src").orderBy("c")))
    plan = with_reach(plan, by, ["tab", "src"], "n", "c", MARGIN, MARGIN, "goes")
    plan = plan.select(F.col("tab").alias("_t"), F.col("src").alias("_s"), F.col("day").alias("_d"), "c", "goes")
    placed = rec.join(plan, (F.col("tab") == F.col("_t")) & F.col("src").eqNullSafe(F.col("_s")) & (F.col("day") == F.col("_d")))
    rows = placed.select("tab", "src", F.col("c").alias("own"), F.explode("goes").alias("c"), "t", "rid", "y").withColumn("own", F.col("own") == F.col("c"))
    lanes = rows.repartition("tab", "src", "c").sortWithinPartitions("tab", "src", "c", "t", "rid")
    lo, hi = np.array([t.lo for t in tables]), np.array([t.hi for t in tables])
    reasons = np.array(["", "impossible", "stuck", "spike"], dtype=object)
    names = np.array([t.name for t in tables], dtype=object)
    keys = ["tab", "src", "c"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 200_000):
            at = np.append(np.flatnonzero(key_codes(table, keys)), table.num_rows)
            y, own, tab = column_numpy(table, "y"), column_numpy(table, "own"), column_numpy(table, "tab")
            possible = (y >= lo[tab]) & (y <= hi[tab])
            why = np.zeros(len(y), dtype=np.int8)
            zs = np.full(len(y), np.nan)
            groups = []
            for a, b in zip(at[:-1], at[1:]):
                stuck = vanished_variance(np.diff(y[a:b], prepend=np.nan), STUCK_RUN)
                use = np.flatnonzero(possible[a:b] & ~stuck)  # what is normal is learned from the others
                why[a:b][stuck] = 2
                if len(use) >= 8:
                    x = y[a:b][use]
                    groups.append((a + use, x, *scatter_and_walk(x)))
            groups.sort(key=lambda g: len(g[0]))
            i = 0
            while i < len(groups):
                j = i + 1
                while j < len(groups) and len(groups[j][0]) <= 1.5 * len(groups[i][0]) + 64:
                    j += 1
                part, i = groups[i:j], j
                grid = np.full((len(part[-1][0]), len(part)), np.nan)
                for c, g in enumerate(part):
                    grid[: len(g[0]), c] = g[1]
                back = np.full_like(grid, np.nan)
                for c, g in enumerate(part):
                    back[: len(g[0]), c] = g[1][::-1]
                r, q = np.array([g[2] for g in part]), np.array([g[3] for g in part])
                z = local_level_innovations(np.concatenate([grid, back], axis=1), np.append(r, r), np.append(q, q), candidate)
                for c, g in enumerate(part):
                    both = np.stack([z[: len(g[0]), c], z[: len(g[0]), len(part) + c][::-1]])
                    zs[g[0]] = both[0]
                    why[g[0][spike_mask(g[1], both, g[2], candidate, threshold)]] = 3
            why[~possible] = 1
            hit = np.flatnonzero((why > 0) & own)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[tab[hit]].tolist(), pa.string()), table.column("src").combine_chunks().take(pa.array(hit)),
                        table.column("rid").combine_chunks().take(pa.array(hit)), pa.array(y[hit]),
                        pa.array(reasons[why[hit]].tolist(), pa.string()), pa.array(zs[hit], mask=np.isnan(zs[hit])),
                    ],
                    names=[f.name for f in out.fields],
                )

    out = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("record_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("reason", T.StringType()), T.StructField("z", T.DoubleType())])
    return lanes.mapInArrow(kernel, out)
