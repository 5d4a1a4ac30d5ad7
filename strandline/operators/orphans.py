"""References to records that do not exist (fixpoint cascade of semi and anti joins)."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import materialize


def _accent_table() -> tuple[str, str]:
    """Letters that Unicode takes apart into a base letter and marks, and the base letters."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and unicodedata.category(c)[0] == "L":
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accent_table()
_SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(sys.maxunicode + 1) if chr(c).isspace()) + r"\x{200b}\x{2060}\x{feff}]"


def folded_name(c: Column) -> Column:
    """Name without regard to case, accents, outer white space of any kind and repeated inner white space.

    Null, and names of white space only, become null. Stays in the JVM (translate and regular expressions).
    """
    x = F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), _FROM, _TO)
    x = F.regexp_replace(x, r"\p{M}+", "")
    x = F.regexp_replace(x, _SPACE + "+", " ")
    x = F.trim(x)
    return F.when(x != "", x)


@dataclass(frozen=True)
class Reference:
    """``child.child_cols`` refer to ``parent.parent_cols``; null in any of the columns is no reference.

    With ``at``, ``opened`` and ``closed`` a parent counts only on the child's date, see :func:`orphans_at`.
    """

    child: str
    child_cols: Sequence[str]
    parent: str
    parent_cols: Sequence[str]
    at: str | None = None
    opened: str | None = None
    closed: str | None = None


def orphans_at(child: DataFrame, key: Sequence[str], at: str, parent: DataFrame, opened: str, closed: str) -> DataFrame:
    """Rows of ``child`` whose key is that of no parent row valid on date ``at`` (valid from ``opened`` up to, not including, ``closed``).

    A null key is no reference. A null ``opened`` means always, a null ``closed`` still valid; a child without a
    date is an orphan only if no parent has its key. Repeated parent rows change nothing.

    The validity of a parent is cut into months between the first and last date of the children, so the join is
    on key and month: a key that holds a third of all rows is spread over its months, and the parents of a month
    are few. The distinct (key, date) pairs are looked up, never pairs of rows.
    """
    key = list(key)
    refs = child.where(" and ".join(f"`{k}` is not null" for k in key))
    asked = refs.select(*key, F.col(at).alias("_at")).distinct().withColumn("_m", F.coalesce(F.trunc("_at", "month"), F.lit("0001-01-01").cast("date")))
    lo, hi = refs.agg(F.trunc(F.min(at), "month"), F.trunc(F.max(at), "month")).collect()[0]
    lo, hi = (F.lit(x) if x is not None else F.trunc(F.current_date(), "month") for x in (lo, hi))
    valid = parent.select(*key, F.col(opened).alias("_o"), F.col(closed).alias("_c")).distinct()
    first = F.greatest(F.coalesce(F.trunc("_o", "month"), lo), lo)
    last = F.least(F.coalesce(F.trunc(F.date_sub("_c", 1), "month"), hi), hi)
    months = valid.where(first <= last).select(*key, "_o", "_c", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("_m"))
    ever = valid.select(*key, F.lit(None).cast("date").alias("_o"), F.lit(None).cast("date").alias("_c"), F.lit("0001-01-01").cast("date").alias("_m")).distinct()
    spans = months.unionByName(ever)
    on = [asked[k] == spans[k] for k in key] + [asked["_m"] == spans["_m"]]
    inside = F.coalesce(asked["_at"] >= spans["_o"], F.lit(True)) & F.coalesce(asked["_at"] < spans["_c"], F.lit(True))
    for c in on:
        inside = inside & c
    lost = asked.join(spans, inside, "left_anti").select(*key, F.col("_at"))
    same = F.col("r._at_key").eqNullSafe(F.col("l._at"))
    left = refs.withColumn("_at_key", F.col(at)).alias("r")
    cond = same
    for k in key:
        cond = cond & (F.col(f"r.{k}") == F.col(f"l.{k}"))
    return left.join(lost.alias("l"), cond, "left_semi").drop("_at_key")


def _unresolved(child: DataFrame, parent: DataFrame, r: Reference) -> DataFrame:
    """Rows of ``child`` for which reference ``r`` finds no row of ``parent``."""
    keys = list(r.child_cols)
    dates = [F.col(r.opened).alias("_opened"), F.col(r.closed).alias("_closed")] if r.at else []
    parent = parent.select(*[F.col(p).alias(k) for p, k in zip(r.parent_cols, keys)], *dates).where(" and ".join(f"`{k}` is not null" for k in keys))
    if r.at:
        return orphans_at(child, keys, r.at, parent, "_opened", "_closed")
    asked = child.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct()
    missing = asked.join(parent.select(*keys).distinct(), keys, "left_anti")
    return child.join(missing, keys, "left_semi")


def orphan_cascade(
    tables: dict[str, DataFrame], ids: dict[str, str], references: Sequence[Reference], deleted: dict[str, DataFrame] | None = None, max_rounds: int = 50
) -> dict[str, DataFrame]:
    """Direct and inherited orphans of a graph of foreign keys.

    A row is a direct orphan where a reference finds no parent row, an inherited one where it found some but all
    of them are orphans or ``deleted`` (frames that hold the ids of rows to be seen as gone; those are reported
    as 'deleted'). Gives for each table ``id`` (string), ``kind`` and ``via`` (the first reference that failed).

    Rounds of semi-joins go down the graph from the orphans found last, until a round finds none: as many rounds
    as the graph is deep, for cyclic or self references as long as the chains are. A round joins only the new
    orphans' distinct keys against parents and children, so a key with many children is aggregated before it is
    shuffled. A null in a key column is no reference, a row without an id is not reported. Repeated rows count
    once. Tables without rows have no orphans, but all references to them are.
    """
    label = lambda r: f"{r.child}.{','.join(r.child_cols)}->{r.parent}"
    spark = next(iter(tables.values())).sparkSession

    def needed(t: str) -> DataFrame:
        cols = {ids[t]}
        for r in references:
            cols |= set(r.child_cols) | {r.at} if r.child == t else set()
            cols |= set(r.parent_cols) | {r.opened, r.closed} if r.parent == t else set()
        return tables[t].select(*sorted(c for c in cols if c))

    def gather(parts: list[DataFrame]) -> DataFrame:
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return materialize(df.where("id is not null").groupBy("id").agg(F.min("kind").alias("kind"), F.min("via").alias("via")), "orphans")

    def named(df: DataFrame, t: str, kind: str, via: str) -> DataFrame:
        return df.select(F.col(ids[t]).cast("string").alias("id"), F.lit(kind).alias("kind"), F.lit(via).alias("via"))

    def without(df: DataFrame, t: str, gone: DataFrame) -> DataFrame:
        return df.join(gone.select(F.col("id").alias("_gone")), F.col(ids[t]).cast("string") == F.col("_gone"), "left_anti")

    start: dict[str, list[DataFrame]] = {t: [] for t in tables}
    for t, s in (deleted or {}).items():
        start[t].append(named(s, t, "deleted", "deleted"))
    for r in references:
        start[r.child].append(named(_unresolved(needed(r.child), needed(r.parent), r), r.child, "direct", label(r)))
    found = {t: gather(parts) if parts else spark.createDataFrame([], "id string, kind string, via string") for t, parts in start.items()}
    new = {t: found[t] for t, parts in start.items() if parts}
    for _ in range(max_rounds):
        new = {t: df for t, df in new.items() if any(r.parent == t for r in references) and not df.isEmpty()}
        if not new:
            return found
        parts: dict[str, list[DataFrame]] = {}
        for r in references:
            if r.parent not in new:
                continue
            parent, keys = needed(r.parent), list(r.parent_cols)
            lost = parent.join(new[r.parent].select(F.col("id").alias("_gone")), F.col(ids[r.parent]).cast("string") == F.col("_gone"), "left_semi").select(*keys).distinct()
            asked = lost.withColumnsRenamed({p: f"_p{i}" for i, p in enumerate(keys)}).withColumnsRenamed({f"_p{i}": c for i, c in enumerate(r.child_cols)})
            children = needed(r.child).join(asked, list(r.child_cols), "left_semi")
            left = without(parent.join(lost, keys, "left_semi"), r.parent, found[r.parent])
            parts.setdefault(r.child, []).append(named(_unresolved(children, left, r), r.child, "inherited", label(r)))
        new = {}
        for t, dfs in parts.items():
            df = gather([x.join(found[t].select("id"), "id", "left_anti") for x in dfs])
            new[t] = df
            found[t] = found[t].unionByName(df)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def orphan_report(table_name: str, rows: DataFrame, orphans: DataFrame, row_id: str, at: str) -> DataFrame:
    """Orphans per table and month: ``table_name``, ``month`` (yyyy-MM, null without a date), ``kind``, ``n``."""
    joined = rows.select(F.col(row_id).cast("string").alias("id"), F.date_format(at, "yyyy-MM").alias("month")).distinct().join(orphans.select("id", "kind"), "id")
    return joined.groupBy("month", "kind").agg(F.count("*").alias("n")).select(F.lit(table_name).alias("table_name"), "month", "kind", "n")
