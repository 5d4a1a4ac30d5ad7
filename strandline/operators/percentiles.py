"""Percentiles of very large columns by mergeable relative-rank sketches."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.relative_rank import RelativeRankSketch
from strandline.runtime import column_numpy, key_codes

#: Rows of a task that are sketched at once; memory of a task is bounded by this, not by its groups.
CHUNK = 1_000_000


def _merge_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the sketches of equal keys in partitions sorted by them, one at a time."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sketch, rows, done = None, None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                keys_table = pa.concat_tables(rows)
                yield from keys_table.append_column("sketch", pa.array(done, pa.binary())).combine_chunks().to_batches()
                rows.clear(), done.clear()

        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            at = np.append(np.flatnonzero(key_codes(t, keys)), t.num_rows)
            data = t.column("sketch")
            for a, z in zip(at[:-1], at[1:]):
                head = t.select(keys).slice(int(a), 1)
                key = tuple(c[0].as_py() for c in head.columns)
                if sketch is None or key != now:
                    if sketch is not None:
                        done.append(sketch.to_bytes())
                        if len(done) >= 1000:
                            yield from flush()
                    now, sketch = key, RelativeRankSketch.from_bytes(data[int(a)].as_py())
                    rows.append(head)
                    a += 1
                for i in range(int(a), int(z)):
                    sketch.merge(RelativeRankSketch.from_bytes(data[i].as_py()))
        if sketch is not None:
            done.append(sketch.to_bytes())
        yield from flush()

    return df.mapInArrow(kernel, T.StructType([df.schema[k] for k in keys] + [T.StructField("sketch", T.BinaryType())]))


def merge_sketches(df: DataFrame, keys: Sequence[str], salts: int = 32) -> DataFrame:
    """Sketches of parts (days, files, partitions) to one per ``keys``: first in ``salts`` shares of a key, then whole.

    A key with very many partial sketches is merged in that many tasks first; a task holds one sketch at a time.
    """
    keys = list(keys)
    part = df.select(*keys, F.pmod(F.xxhash64("sketch"), F.lit(salts)).alias("_salt"), "sketch")
    part = _merge_runs(part.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt"), [*keys, "_salt"])
    return _merge_runs(part.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys), keys)


def sketch_groups(df: DataFrame, keys: Sequence[str], value: str, record_id: str | None = None, section: int = 32, high: bool = True) -> DataFrame:
    """One sketch per ``keys``: columns ``keys`` and ``sketch`` (binary). Null and NaN are no values.

    Rows with the same ``record_id`` and keys are one record (its largest value counts); a null id is one record of its own
    for each row. A null key is a group. A group without values gives no sketch. Other columns are ignored.

    Without ``record_id`` sketches are built where the rows are; with it rows are first spread by id to tell repeats. Then only
    sketches, never the values of a group, meet in one task.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("_x"), *([F.col(record_id).alias("_id")] if record_id else [])).where(~F.isnan("_x") & F.col("_x").isNotNull())
    if record_id:
        spread = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null "), F.monotonically_increasing_id()))
        rows = rows.withColumn("_id", spread if dict(rows.dtypes)["_id"] == "string" else F.coalesce(F.col("_id"), -F.monotonically_increasing_id() - 2))
        rows = rows.groupBy("_id", *keys).agg(F.max("_x").alias("_x")).drop("_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        task = TaskContext.get()
        seeds = itertools.count((task.partitionId() if task else 0) << 32)  # the same when a task is run again

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            code = np.zeros(t.num_rows, dtype=np.int64)
            for k in keys:
                d = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
                code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
                code = np.unique(code, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            x = column_numpy(t, "_x")[order]
            at = np.append(np.flatnonzero(np.append(True, np.diff(code[order]) != 0)), len(x))
            made = []
            for a, z in zip(at[:-1], at[1:]):
                s = RelativeRankSketch(section, high=high, seed=next(seeds))
                s.update(x[a:z])
                made.append(s.to_bytes())
            head = t.select(keys).take(pa.array(order[at[:-1]])).combine_chunks()
            return head.append_column("sketch", pa.array(made, pa.binary())).combine_chunks().to_batches()[0]

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    parts = rows.mapInArrow(build, T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("sketch", T.BinaryType())]))
    return merge_sketches(parts, keys)


def read_percentiles(df: DataFrame, keys: Sequence[str], q: Sequence[float]) -> DataFrame:
    """Long form of sketches: ``keys``, ``q``, ``value``, ``n``, ``rank_error`` (share of n, three standard deviations)."""
    keys = list(keys)
    qs = np.asarray(q, dtype=float)
    fields = [df.schema[k] for k in keys] + [T.StructField("q", T.DoubleType()), T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = [RelativeRankSketch.from_bytes(x.as_py()) for x in b.column("sketch")]
            if not sketches:
                continue
            values = [s.quantiles(qs) for s in sketches]
            at = pa.array(np.repeat(np.arange(len(sketches)), len(qs)))
            cols = [b.column(b.schema.get_field_index(k)).take(at) for k in keys]
            cols += [pa.array(np.tile(qs, len(sketches))), pa.array(np.concatenate(values)), pa.array(np.repeat([s.n for s in sketches], len(qs)).astype("int64"))]
            cols.append(pa.array(np.concatenate([s.rank_error(v) for s, v in zip(sketches, values)])))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.mapInArrow(kernel, T.StructType(fields))
