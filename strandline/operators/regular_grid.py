"""Irregular readings onto a regular grid (Kalman smoother with a continuous-time local trend)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandline.functions.kalman import MOMENTS, smooth_local_trend, trend_moments, trend_noise
from strandline.functions.times import utc_micros
from strandline.runtime import column_numpy, key_codes, materialize, whole_groups

DAY = 86_400
#: Periods of one block of a source, and periods beside a block whose readings its smoother also sees.
BLOCK_SLOTS, MARGIN_SLOTS = 2048, 192
NONE = -(2**62)
LANE_CELLS = 1_000_000
#: Sources up to which the noise of each (some hundred bytes) is sent to all tasks.
BROADCAST_SOURCES = 50_000
#: Blocks that are smoothed together.
TOGETHER = 64


def regular_grid(
    df: DataFrame,
    source: str,
    time: str,
    values: Sequence[str],
    record_id: str | None = None,
    cadence: DataFrame | None = None,
    minutes: str = "cadence_minutes",
    default_minutes: int = 60,
    block_slots: int = BLOCK_SLOTS,
    margin_slots: int = MARGIN_SLOTS,
) -> DataFrame:
    """One row per source and period, from the period of its first to that of its last record.

    Periods are ``minutes`` long (per source, from ``cadence``; else ``default_minutes``), counted from midnight.
    Gives ``source``, ``slot`` (start of the period), ``n_records`` (whose time falls into it), ``missing``
    (no record does), and for each value ``v`` its smoothed level at the slot, ``v_sd`` (standard deviation of that
    level) and ``v_n`` (readings with a value in the period; 0 marks a filling).

    Null and NaN are no values, though their records count as records. Rows without time are left out, a null
    source is a source of its own. Rows with the same source, time and ``record_id`` are one record (largest
    values count). A value without any reading in the source is null throughout. An empty table gives an empty
    result; other columns are ignored. Cadences that are null or below one minute fall back to the default.

    One shuffle of the readings by source and block of ``block_slots`` periods (whole days); a block also gets the readings of
    ``margin_slots`` periods on either side and the nearest value before and after it, however far, so a long series is smoothed
    in many tasks. Blocks are written once, a row each, with sums that give the noise of readings and level of the
    whole source and value; then each is smoothed; up to 50,000 sources their noise is
    broadcast, beyond it is joined. Sources meet their cadence by a join.
    """
    vals = [f"v{i}" for i in range(len(values))]
    k = len(vals)
    num = [F.col(c).cast("double") for c in values]
    rec = df.select(
        F.col(source).alias("src"), utc_micros(df, time).alias("t"),
        *[F.when(~F.isnan(x), x).alias(v) for x, v in zip(num, vals)],
        (F.col(record_id).cast("string") if record_id else F.lit("")).alias("id"),
    ).where("t is not null")
    if cadence is not None:
        per = cadence.select(F.col(source).alias("_src"), F.col(minutes).cast("int").alias("_m")).groupBy("_src").agg(F.max("_m").alias("_m"))
        rec = rec.join(per, F.col("src").eqNullSafe(F.col("_src")), "left").withColumn("p", F.when(F.col("_m") >= 1, F.col("_m")).otherwise(default_minutes).cast("long") * 60).drop("_src", "_m")
    else:
        rec = rec.withColumn("p", F.lit(default_minutes * 60).cast("long"))
    span = F.ceil(F.least("p", F.lit(DAY)) * block_slots / DAY) * (DAY * 1_000_000)  # of a block, microseconds
    margin = F.least(F.col("p") * (margin_slots * 1_000_000), span / 2).cast("long")
    rec = rec.withColumns({"b": F.floor(F.col("t") / span).cast("int"), "inside": F.pmod(F.col("t"), span), "span": span, "margin": margin})
    aggs = [F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("p").alias("p")]
    for v in vals:
        seen = F.when(F.col(v).isNotNull(), F.struct("t", v))
        aggs += [F.min(seen).alias(f"{v}_f"), F.max(seen).alias(f"{v}_l"), F.count(v).alias(f"{v}_c"), F.sum(v).alias(f"{v}_s"), F.sum(F.col(v) * F.col(v)).alias(f"{v}_q")]
    blocks = rec.groupBy("src", "b").agg(*aggs)
    whole, back = W.partitionBy("src"), W.partitionBy("src").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("src").orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)
    step = W.partitionBy("src").orderBy("b")
    plan = blocks.select(
        "src", "b", "t0", "t1", "p", F.lead("b").over(step).alias("next_b"), F.lag("b").over(step).alias("prev_b"),
        *[F.last(f"{v}_l", ignorenulls=True).over(back).alias(f"{v}_in") for v in vals],
        *[F.last(f"{v}_f", ignorenulls=True).over(ahead).alias(f"{v}_out") for v in vals],
        *[(F.sum(f"{v}_q").over(whole) / F.sum(f"{v}_c").over(whole) - F.pow(F.sum(f"{v}_s").over(whole) / F.sum(f"{v}_c").over(whole), 2)).alias(f"{v}_var") for v in vals],
    )
    extra = ["t0", "t1", "next_b", "prev_b", "p"]
    notes = [x for v in vals for x in (f"{v}_it", f"{v}_iv", f"{v}_ot", f"{v}_ov", f"{v}_var")]
    markers = plan.select(
        "src", "b", F.lit(None).cast("long").alias("t"), *[F.lit(None).cast("double").alias(v) for v in vals], F.lit(None).cast("string").alias("id"),
        *[F.col(x).cast("long").alias(x) for x in extra],
        *[c for v in vals for c in (F.col(f"{v}_in.t").cast("double").alias(f"{v}_it"), F.col(f"{v}_in.{v}").alias(f"{v}_iv"), F.col(f"{v}_out.t").cast("double").alias(f"{v}_ot"), F.col(f"{v}_out.{v}").alias(f"{v}_ov"), F.col(f"{v}_var"))],
    )
    block = F.col("b")
    targets = F.when(F.col("inside") < F.col("margin"), F.array(block - 1, block)).when(F.col("inside") >= F.col("span") - F.col("margin"), F.array(block, block + 1)).otherwise(F.array(block))
    rows = rec.select("src", F.explode(targets).alias("b"), "t", *vals, "id", *[F.lit(None).cast("long").alias(x) for x in extra], *[F.lit(None).cast("double").alias(x) for x in notes])
    grouped = (
        rows.unionByName(markers)
        .repartition("src", "b")
        .groupBy("src", "b", "t", "id")
        .agg(*[F.max(x).alias(x) for x in [*vals, *extra, *notes]])
        .sortWithinPartitions("src", "b", F.col("t").asc_nulls_first(), "id")
    )
    fields = [T.StructField(source, df.schema[source].dataType), T.StructField("slot", T.TimestampNTZType()), T.StructField("n_records", T.LongType()), T.StructField("missing", T.BooleanType())]
    for c in values:
        fields += [T.StructField(c, T.DoubleType()), T.StructField(f"{c}_sd", T.DoubleType()), T.StructField(f"{c}_n", T.LongType())]
    names = [f.name for f in fields]

    def span_of(p: int) -> int:
        return -(-min(p, DAY) * block_slots // DAY) * DAY

    def slot_of(s: np.ndarray | int, p: int) -> np.ndarray:
        day = np.floor_divide(s, DAY) * DAY
        return day + np.floor_divide(s - day, p) * p

    sums = [f"{v}_{m}" for v in vals for m in MOMENTS]
    packed = T.StructType(
        [T.StructField("src", df.schema[source].dataType), T.StructField("b", T.LongType())] + [T.StructField(x, T.LongType()) for x in extra] + [T.StructField(x, T.DoubleType()) for x in notes]
        + [T.StructField("t", T.ArrayType(T.LongType()))] + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in vals] + [T.StructField(x, T.DoubleType()) for x in sums]
    )

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its marker's notes, the times and values of its readings, and their moments."""
        for table in whole_groups(batches, ["src", "b"], 50_000):
            at = np.append(np.flatnonzero(key_codes(table, ["src", "b"])), table.num_rows)
            t_us = np.asarray(column_numpy(table, "t", NONE), dtype=np.int64)
            v_all = [np.asarray(column_numpy(table, v), dtype=float) for v in vals]
            p_all, b_all = np.asarray(column_numpy(table, "p", NONE), dtype=np.int64), np.asarray(column_numpy(table, "b"), dtype=np.int64)
            # readings of a neighbour alone make no block
            marks = [(int(i), int(j)) for i, j in zip(at[:-1], at[1:]) if t_us[i] == NONE and p_all[i] != NONE]
            if not marks:
                continue
            head = table.take(pa.array([i for i, _ in marks]))
            found = np.zeros((len(marks), k, len(MOMENTS)))
            for g, (i, j) in enumerate(marks):
                t = t_us[i + 1 : j]
                own = t // (span_of(int(p_all[i])) * 1_000_000) == b_all[i]
                for f in range(k):
                    seen = ~np.isnan(v_all[f][i + 1 : j])
                    if seen.sum() > 1:
                        found[g, f] = trend_moments(t[seen] / 1e6, v_all[f][i + 1 : j][seen], own[seen])
            offsets = np.append(0, np.cumsum([j - i - 1 for i, j in marks])).astype(np.int32)
            rows = np.concatenate([np.arange(i + 1, j) for i, j in marks])
            cols = [head.column("src").combine_chunks(), pa.array(b_all[[i for i, _ in marks]])]
            cols += [head.column(x).combine_chunks() for x in extra + notes]
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(t_us[rows])))
            cols += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[rows])) for v in v_all]
            cols += [pa.array(found[:, f, m]) for f in range(k) for m in range(len(MOMENTS))]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[f.name for f in packed])

    written = materialize(grouped.mapInArrow(to_blocks, packed), "blocks")
    noise = written.groupBy("src").agg(F.count("*").alias("_blocks"), *[F.sum(x).alias(f"_{x}") for x in sums])
    noise = materialize(noise.withColumnRenamed("src", "_src"), "noise")
    n_sources, n_blocks = noise.agg(F.count("*"), F.coalesce(F.sum("_blocks"), F.lit(0))).collect()[0]
    side = F.broadcast(noise) if n_sources <= BROADCAST_SOURCES else noise
    ready = written.drop(*sums).join(side, F.col("src").eqNullSafe(F.col("_src"))).drop("_src", "_blocks")
    # few bytes but much work: as many tasks as the blocks are worth, which adaptive execution would put together
    ready = ready.repartition(max(min(-(-n_blocks // 16), max(8 * df.sparkSession.sparkContext.defaultParallelism, n_blocks // 4096)), 1), "src", "b")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                yield smooth(pa.Table.from_batches([batch.slice(first, TOGETHER)]))

    def smooth(table: pa.Table) -> pa.RecordBatch:
        head = {x: np.asarray(column_numpy(table, x, NONE), dtype=np.int64) for x in ["b", *extra]}
        note = {x: np.asarray(column_numpy(table, x), dtype=float) for x in notes + [f"_{x}" for x in sums]}
        times = [np.asarray(x.values.to_numpy(), dtype=np.int64) for x in table.column("t")]
        series = [[np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=float) for x in table.column(v)] for v in vals]
        lanes, outs = [], []
        for i in range(table.num_rows):
            p, b, t = int(head["p"][i]), int(head["b"][i]), times[i]
            span_s = span_of(p)
            begin, margin_s = b * span_s, min(p * margin_slots, span_s / 2)
            lo = slot_of(head["t0"][i] // 1_000_000, p) if head["prev_b"][i] == NONE else begin
            hi = slot_of(head["t1"][i] // 1_000_000, p) if head["next_b"][i] == NONE else head["next_b"][i] * span_s - 1
            days = np.arange(lo // DAY, hi // DAY + 1) * DAY
            slots = (days[:, None] + np.arange(0, DAY, p)[None, :]).ravel()
            slots = slots[(slots >= lo) & (slots <= hi)]
            own = t // (span_s * 1_000_000) == b
            place = np.searchsorted(slots, t[own] // 1_000_000, side="right") - 1
            n_rec = np.bincount(place, minlength=len(slots))
            seen = [~np.isnan(s[i]) for s in series]
            n_val = [np.bincount(place[seen[f][own]], minlength=len(slots)) for f in range(k)]
            outs.append([i, slots, n_rec, n_val, np.full((k, len(slots)), np.nan), np.full((k, len(slots)), np.nan)])
            for f, v in enumerate(vals):
                tf, yf = t[seen[f]] / 1e6, series[f][i][seen[f]]
                it, ot = note[f"{v}_it"][i] / 1e6, note[f"{v}_ot"][i] / 1e6
                if not np.isnan(it) and it < begin - margin_s:
                    tf, yf = np.insert(tf, 0, it), np.insert(yf, 0, note[f"{v}_iv"][i])
                if not np.isnan(ot) and ot >= begin + span_s + margin_s:
                    tf, yf = np.append(tf, ot), np.append(yf, note[f"{v}_ov"][i])
                if len(tf):
                    at = np.concatenate([slots.astype(float), tf])
                    order = np.argsort(at, kind="stable")
                    both = trend_noise(np.array([note[f"_{v}_{m}"][i] for m in MOMENTS]), note[f"{v}_var"][i])
                    lanes.append((i, f, at[order], np.concatenate([np.full(len(slots), np.nan), yf])[order], order < len(slots), *both))
        lanes.sort(key=lambda x: len(x[2]))
        a = 0
        while a < len(lanes):
            z = a + 1
            while z < len(lanes) and len(lanes[z][2]) * (z + 1 - a) <= LANE_CELLS:
                z += 1
            part, a = lanes[a:z], z
            steps = len(part[-1][2])
            tt, yy = np.empty((steps, len(part))), np.full((steps, len(part)), np.nan)
            for c, (_, _, x, y, *_rest) in enumerate(part):
                tt[: len(x), c], yy[: len(x), c] = x, y
                tt[len(x) :, c] = x[-1]
            level, var = smooth_local_trend(tt, yy, np.array([x[5] for x in part]), np.array([x[6] for x in part]), typical=np.array([head["p"][x[0]] for x in part], dtype=float))
            for c, (o, f, x, _y, grid, _r, _q) in enumerate(part):
                outs[o][4][f] = level[: len(x), c][grid]
                outs[o][5][f] = np.sqrt(var[: len(x), c][grid])
        n_rec = np.concatenate([o[2] for o in outs])
        cols: list[pa.Array] = [
            table.column("src").combine_chunks().take(pa.array(np.repeat([o[0] for o in outs], [len(o[1]) for o in outs]))),
            pa.array(np.concatenate([o[1] for o in outs]) * 1_000_000, pa.int64()).cast(pa.timestamp("us")),
            pa.array(n_rec.astype("int64")),
            pa.array(n_rec == 0),
        ]
        for f in range(k):
            for e in (4, 5):
                x = np.concatenate([o[e][f] for o in outs])
                cols.append(pa.array(x, mask=np.isnan(x)))
            cols.append(pa.array(np.concatenate([o[3][f] for o in outs]).astype("int64")))
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names)

    return ready.mapInArrow(kernel, T.StructType(fields))
