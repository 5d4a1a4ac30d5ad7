"""Filling missing values through a dependency tree over discretised fields (Chow-Liu)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandline.runtime import column_numpy, materialize


@dataclass(frozen=True)
class Number:
    """A numeric field; values outside ``lo`` to ``hi``, null and NaN are absent. ``target``: fill it."""

    name: str
    lo: float
    hi: float
    target: bool = True


@dataclass(frozen=True)
class Category:
    """A categorical field; what is not one of ``known`` is absent."""

    name: str
    known: tuple[str, ...]
    target: bool = True


@dataclass
class Tree:
    """Chow-Liu tree: for each node its number of states, parent (-1: root) and table P(node | parent)."""

    sizes: list[int]
    parent: list[int]
    table: list[np.ndarray]
    order: list[int]


def mutual_information(counts: np.ndarray) -> float:
    """Of a table of joint counts, in nats."""
    n = counts.sum()
    if not n:
        return 0.0
    p = counts / n
    outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    at = p > 0
    return float((p[at] * np.log(p[at] / outer[at])).sum())


def chow_liu(sizes: Sequence[int], pairs: dict[tuple[int, int], np.ndarray], smoothing: float = 0.5) -> Tree:
    """Maximum spanning tree of pairwise mutual information (Prim), with smoothed conditional tables."""
    k = len(sizes)
    weight = np.full((k, k), -np.inf)
    for (i, j), c in pairs.items():
        # the expected information of independent fields is taken off, else fields with many states attract edges
        n = max(c.sum(), 1)
        weight[i, j] = weight[j, i] = mutual_information(c) - (sizes[i] - 1) * (sizes[j] - 1) / (2 * n)
    parent, best, order = [-1] * k, np.full(k, -np.inf), []
    inside = np.zeros(k, dtype=bool)
    best[0] = np.inf
    for _ in range(k):
        v = int(np.argmax(np.where(inside, -np.inf, best)))
        if inside[v]:
            v = int(np.flatnonzero(~inside)[0])
        inside[v] = True
        order.append(v)
        closer = ~inside & (weight[v] > best)
        for u in np.flatnonzero(closer):
            parent[u] = v
        best[closer] = weight[v][closer]
    table = []
    for v in range(k):
        p = parent[v]
        if p < 0:
            other = order[1] if k > 1 and v == order[0] else order[0]
            if k == 1:
                joint = pairs.get((0, 0), np.ones((sizes[0], sizes[0])))
            else:
                joint = pairs[(v, other)] if (v, other) in pairs else pairs[(other, v)].T
            prior = joint.sum(1) + smoothing
            table.append(prior / prior.sum())
        else:
            joint = pairs[(p, v)] if (p, v) in pairs else pairs[(v, p)].T
            marginal = joint.sum(0) + smoothing
            joint = joint + smoothing * sizes[v] * (marginal / marginal.sum())[None, :] / sizes[v] + 1e-9
            table.append(joint / joint.sum(1, keepdims=True))
    return Tree(list(sizes), parent, table, order)


def posteriors(tree: Tree, codes: np.ndarray, wanted: Sequence[int]) -> dict[int, np.ndarray]:
    """Posterior of each wanted node for every row, by messages up and down the tree. ``codes``: (rows, nodes), -1 absent."""
    n = len(codes)
    own = []
    for v, size in enumerate(tree.sizes):
        e = np.ones((n, size))
        seen = codes[:, v] >= 0
        e[seen] = 0
        e[np.flatnonzero(seen), codes[seen, v]] = 1
        own.append(e)
    up: dict[int, np.ndarray] = {}
    gathered = [e.copy() for e in own]
    for v in reversed(tree.order):
        p = tree.parent[v]
        if p >= 0:
            m = gathered[v] @ tree.table[v].T
            up[v] = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
            gathered[p] *= up[v]
    down: dict[int, np.ndarray] = {}
    found: dict[int, np.ndarray] = {}
    for v in tree.order:
        p = tree.parent[v]
        if p < 0:
            down[v] = np.broadcast_to(tree.table[v], (n, tree.sizes[v]))
        else:
            rest = gathered[p] * down[p] / np.maximum(up[v], 1e-300)
            m = rest @ tree.table[v]
            down[v] = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        if v in wanted:
            b = gathered[v] * down[v]
            found[v] = b / np.maximum(b.sum(1, keepdims=True), 1e-300)
    return found


def present(field: Number | Category, c: Column) -> Column:
    """The value where it is one, else null."""
    if isinstance(field, Category):
        return F.when(c.isin(*field.known), c)
    x = c.cast("double")
    return F.when(~F.isnan(x) & x.between(field.lo, field.hi), x)


def fill_missing_values(
    df: DataFrame, source: str, time: str, record_id: str, fields: Sequence[Number | Category], bins: int = 32, accuracy: int = 5000
) -> DataFrame:
    """Fill absent values from the records of the same source and time.

    Gives one row per record (``record_id``, ``source``, ``time``): each field, filled where it was absent, and
    for each target ``<field>_filled`` (true: the value is a filling).

    Nodes of the tree are the fields, the hour, and for each target what its source shows around the record: the
    mean of the last value before and the first after it, on that day or the nearest day that has one, else the mean
    of the source (for categories its commonest value). Numbers are cut into ``bins`` classes of equal frequency. The tree of the largest mutual
    information over all records is fitted, messages give the posterior of each absent field, and that is decoded
    to its mode (category) or to the median of the class that holds the posterior's median (number).

    Repeats (same source, time and id) are one record; where their values differ, the largest counts. Records
    without source or time form groups of their own. A target that has no value in the whole table stays null with
    its mark set. An empty table gives an empty result. Columns other than those named are dropped, so clashing
    names do not matter.

    The records are shuffled once, by source and day, so a source with a third of all rows is many groups; what other
    days show comes from a table of one row per source and day; the
    statistics of a source are joined to it under adaptive skew handling. Pair counts are summed before they are
    shuffled and hold at most pairs x bins^2 rows, whatever the data's size.
    """
    numbers = [f for f in fields if isinstance(f, Number)]
    cats = [f for f in fields if isinstance(f, Category)]
    targets = [f for f in fields if f.target]
    prefix = {f.name: f"x{i}" for i, f in enumerate(fields)}
    clean = df.select(
        F.col(record_id).alias("rid"), F.col(source).alias("src"), F.col(time).alias("ts"), F.to_date(F.col(time)).alias("day"),
        *[present(f, F.col(f.name)).alias(prefix[f.name]) for f in fields],
    )
    recs = clean.repartition("src", "day").groupBy("src", "day", "ts", "rid").agg(*[F.max(x).alias(x) for x in prefix.values()])
    before = W.partitionBy("src", "day").orderBy("ts", "rid").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("src", "day").orderBy(F.col("ts").desc(), F.col("rid").desc()).rowsBetween(W.unboundedPreceding, -1)
    for f in numbers:
        if f.target:
            x = prefix[f.name]
            recs = recs.withColumn(f"{x}_b", F.last(x, ignorenulls=True).over(before))
    for f in numbers:
        if f.target:
            x = prefix[f.name]
            recs = recs.withColumn(f"{x}_a", F.last(x, ignorenulls=True).over(after))
    recs = materialize(recs, "records")
    near = [prefix[f.name] for f in numbers if f.target]
    if near:  # a day's records also see the days before and after it: a short table of the ends of days
        at = F.struct("ts", "rid")
        ends = recs.where("day is not null").groupBy("src", "day").agg(
            *[F.min_by(x, F.when(F.col(x).isNotNull(), at)).alias(f"{x}_first") for x in near],
            *[F.max_by(x, F.when(F.col(x).isNotNull(), at)).alias(f"{x}_last") for x in near],
        )
        days = W.partitionBy("src").orderBy("day")
        earlier, later = days.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("src").orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(
            F.col("src").alias("_s"), F.col("day").alias("_d"),
            *[F.last(f"{x}_last", ignorenulls=True).over(earlier).alias(f"{x}_eb") for x in near],
            *[F.last(f"{x}_first", ignorenulls=True).over(later).alias(f"{x}_ea") for x in near],
        )
        recs = recs.join(carried, F.col("src").eqNullSafe(F.col("_s")) & (F.col("day") == F.col("_d")), "left")
        recs = recs.withColumns({f"{x}_{e}": F.coalesce(f"{x}_{e}", f"{x}_e{e}") for x in near for e in "ba"}).drop("_s", "_d", *[f"{x}_e{e}" for x in near for e in "ba"])
    stats = recs.groupBy("src").agg(
        *[F.avg(prefix[f.name]).alias(f"{prefix[f.name]}_s") for f in numbers if f.target],
        *[F.mode(prefix[f.name], deterministic=True).alias(f"{prefix[f.name]}_s") for f in cats if f.target],
    )
    points = [i / (2 * bins) for i in range(2 * bins + 1)]
    cuts = recs.agg(F.count("*").alias("n"), *[F.percentile_approx(prefix[f.name], points, accuracy).alias(prefix[f.name]) for f in numbers]).collect()[0]
    joined = recs.join(stats.withColumnRenamed("src", "_s"), F.col("src").eqNullSafe(F.col("_s")), "left").drop("_s")

    edges: dict[str, np.ndarray] = {}
    medians: dict[str, np.ndarray] = {}
    for f in numbers:
        q = cuts[prefix[f.name]]
        if not q:
            edges[f.name], medians[f.name] = np.array([]), np.array([np.nan])
            continue
        q = np.asarray(q, dtype=float)
        cut = np.unique(q[2:-1:2])
        which = np.searchsorted(cut, q, side="right")
        edges[f.name] = cut
        medians[f.name] = np.array([np.median(q[which == k]) if (which == k).any() else cut[min(k, len(cut) - 1)] for k in range(len(cut) + 1)])

    nodes: list[tuple[str, Number | Category | None, str]] = [(f.name, f, "own") for f in fields] + [("hour", None, "hour")] + [(f.name, f, "near") for f in targets]
    sizes = [24 if kind == "hour" else len(f.known) if isinstance(f, Category) else len(edges[f.name]) + 1 for _, f, kind in nodes]

    def encode(t: pa.Table) -> np.ndarray:
        out = np.full((t.num_rows, len(nodes)), -1, dtype=np.int64)
        for k, (name, f, kind) in enumerate(nodes):
            if kind == "hour":
                h = column_numpy(t, "hour", -1)
                out[:, k] = h
                continue
            x = prefix[name]
            if isinstance(f, Category):
                col = t.column(x if kind == "own" else f"{x}_s").combine_chunks()
                code = pa.compute.index_in(col, pa.array(f.known, pa.string()))
                out[:, k] = code.fill_null(-1).to_numpy(zero_copy_only=False)
                continue
            if kind == "own":
                v = np.asarray(column_numpy(t, x), dtype=float)
            else:
                b, a, s = (np.asarray(column_numpy(t, f"{x}_{e}"), dtype=float) for e in "bas")
                near = np.where(np.isnan(b), a, np.where(np.isnan(a), b, (a + b) / 2))
                v = np.where(np.isnan(near), s, near)
            seen = ~np.isnan(v)
            out[seen, k] = np.searchsorted(edges[f.name], v[seen], side="right")
        return out

    inputs = joined.withColumn("hour", F.hour("ts"))
    pair_ids = [(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        totals = [np.zeros(sizes[i] * sizes[j], dtype=np.int64) for i, j in pair_ids]
        for b in batches:
            c = encode(pa.Table.from_batches([b]))
            for total, (i, j) in zip(totals, pair_ids):
                both = (c[:, i] >= 0) & (c[:, j] >= 0)
                total += np.bincount(c[both, i] * sizes[j] + c[both, j], minlength=len(total))
        pair, cell, n = [], [], []
        for k, total in enumerate(totals):
            at = np.flatnonzero(total)
            pair.append(np.full(len(at), k)), cell.append(at), n.append(total[at])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("int64")) for x in (pair, cell, n)], names=["pair", "cell", "n"])

    # at most pairs x bins^2 rows come to the driver
    rows = inputs.drop("rid", "src", "day", "ts").mapInArrow(count, "pair long, cell long, n long").groupBy("pair", "cell").agg(F.sum("n").alias("n")).collect()
    pairs = {p: np.zeros(sizes[p[0]] * sizes[p[1]]) for p in pair_ids}
    for r in rows:
        pairs[pair_ids[r["pair"]]][r["cell"]] = r["n"]
    ever = [any(c.any() for p, c in pairs.items() if k in p) for k in range(len(nodes))]
    tree = chow_liu(sizes, {p: c.reshape(sizes[p[0]], sizes[p[1]]) for p, c in pairs.items()})

    wanted = [k for k, (_, f, kind) in enumerate(nodes) if kind == "own" and f.target]
    out_fields = [T.StructField(record_id, df.schema[record_id].dataType), T.StructField(source, df.schema[source].dataType), T.StructField(time, df.schema[time].dataType)]
    for f in fields:
        out_fields.append(T.StructField(f.name, T.StringType() if isinstance(f, Category) else T.DoubleType()))
        if f.target:
            out_fields.append(T.StructField(f"{f.name}_filled", T.BooleanType()))
    out_names = [f.name for f in out_fields]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in batches:
            t = pa.Table.from_batches([b])
            codes = encode(t)
            absent = codes[:, wanted] < 0
            rows = np.flatnonzero(absent.any(axis=1))
            beliefs = posteriors(tree, codes[rows], wanted) if len(rows) else {}
            cols = [t.column("rid").combine_chunks(), t.column("src").combine_chunks(), t.column("ts").combine_chunks()]
            for k, f in enumerate(fields):
                own = t.column(prefix[f.name]).combine_chunks()
                if not f.target:
                    cols.append(own)
                    continue
                gap = codes[:, k] < 0
                if isinstance(f, Category):
                    values = np.array(own.to_pylist(), dtype=object)
                    if len(rows) and ever[k]:
                        pick = np.array(f.known, dtype=object)[beliefs[k].argmax(axis=1)]
                        values[rows[gap[rows]]] = pick[gap[rows]]
                    cols.append(pa.array(values.tolist(), pa.string()))
                else:
                    values = own.to_numpy(zero_copy_only=False).astype(float)
                    if len(rows):
                        middle = (np.cumsum(beliefs[k], axis=1) >= 0.5).argmax(axis=1)
                        values = values.copy()
                        values[rows[gap[rows]]] = medians[f.name][middle][gap[rows]]
                    cols.append(pa.array(values, mask=np.isnan(values)))
                cols.append(pa.array(gap))
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=out_names)

    return inputs.mapInArrow(decode, T.StructType(out_fields))
