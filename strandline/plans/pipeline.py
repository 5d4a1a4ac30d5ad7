"""Pipelines of stages over ordered series, lowered to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import ieee
from strandline.operators import normalize, rolling, scans
from strandline.operators.blocks import KNOWN_SHORT, WHOLE_ROWS, longest
from strandline.runtime import materialize
from strandline.sources.tables import write_into


class StageError(ValueError):
    """A stage could not be planned."""


@dataclass(frozen=True)
class Stage:
    name: str
    params: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Series:
    """What a stage works on: rows, the value column, order and series columns."""

    df: DataFrame
    value: str
    order: tuple[str, ...]
    series: tuple[str, ...]
    whole_rows: int | None = None


@dataclass(frozen=True)
class Pipeline:
    """Immutable list of stages; each method gives a new pipeline with one stage more.

    Stages of one row only are fused into one projection by the optimiser; window stages over the same series share a
    shuffle, and neighbouring ones a sort. ``strict`` is the mode's name, kept for the summary.
    """

    stages: tuple[Stage, ...] = field(default=())
    mode: str = "safe"

    def _add(self, name: str, **params: object) -> Pipeline:
        return replace(self, stages=(*self.stages, Stage(name, tuple(params.items()))))

    @staticmethod
    def _check(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    def diff(self, order: int = 1) -> Pipeline:
        self._check(order >= 1, "order must be at least 1")
        return self._add("diff", order=order)

    def _weighted(self, name: str, alpha: float) -> Pipeline:
        self._check(0 < alpha <= 1, "alpha must lie in (0, 1]")
        return self._add(name, alpha=alpha)

    def ewma(self, alpha: float) -> Pipeline:
        return self._weighted("ewma", alpha)

    def ewvar(self, alpha: float) -> Pipeline:
        return self._weighted("ewvar", alpha)

    def ewstd(self, alpha: float) -> Pipeline:
        return self._weighted("ewstd", alpha)

    def _rolling(self, name: str, window: int) -> Pipeline:
        self._check(window >= 1, "window must be at least 1")
        return self._add(name, window=window)

    def rolling_mean(self, window: int) -> Pipeline:
        return self._rolling("rolling_mean", window)

    def rolling_std(self, window: int) -> Pipeline:
        return self._rolling("rolling_std", window)

    def rolling_median(self, window: int) -> Pipeline:
        return self._rolling("rolling_median", window)

    def rolling_mad(self, window: int) -> Pipeline:
        return self._rolling("rolling_mad", window)

    def zscore(self) -> Pipeline:
        return self._add("zscore")

    def robust_zscore(self, eps: float = 1e-12) -> Pipeline:
        """``eps`` is accepted and has no effect."""
        return self._add("robust_zscore", eps=eps)

    def normalize_minmax(self) -> Pipeline:
        return self._add("normalize_minmax")

    def clip(self, lo: float, hi: float) -> Pipeline:
        self._check(lo <= hi, "lo is above hi")
        return self._add("clip", lo=lo, hi=hi)

    def cumulative_min(self) -> Pipeline:
        return self._add("cumulative_min")

    def cumulative_max(self) -> Pipeline:
        return self._add("cumulative_max")

    def fill_forward(self) -> Pipeline:
        return self._add("fill_forward")

    def prefix_sum(self) -> Pipeline:
        return self._add("prefix_sum")

    def convolve(self, kernel: Sequence[float]) -> Pipeline:
        """Drops the last len(kernel) - 1 rows of each series."""
        self._check(len(kernel) > 0, "the kernel is empty")
        return self._add("convolve", kernel=tuple(map(float, kernel)))

    def lag(self, k: int = 1) -> Pipeline:
        self._check(k >= 1, "k must be at least 1")
        return self._add("lag", k=k)

    def log_return(self) -> Pipeline:
        return self._add("log_return")

    def pct_change(self) -> Pipeline:
        return self._add("pct_change")

    def scale(self, factor: float) -> Pipeline:
        return self._add("scale", factor=factor)

    def shift(self, offset: float) -> Pipeline:
        """Adds ``offset`` to the values."""
        return self._add("shift", offset=offset)

    def abs(self) -> Pipeline:
        return self._add("abs")

    def sqrt(self) -> Pipeline:
        return self._add("sqrt")

    def map(self, fn: Callable[[Column], Column]) -> Pipeline:
        """Any column expression of the value."""
        return self._add("map", fn=fn)

    def summary(self) -> str:
        lines = [f"{i}: {s.name}({', '.join(f'{k}={v}' for k, v in s.params)})" for i, s in enumerate(self.stages)]
        return "\n".join([f"pipeline, mode {self.mode}, {len(self.stages)} stages", *lines])

    def execute(self, df: DataFrame, value: str, order: Sequence[str], series: Sequence[str] = (), out: str | None = None) -> DataFrame:
        """``df`` with the result in ``out`` (default: in place of ``value``). Without stages, the values as doubles."""
        result = "_pipe"
        # series never grow on the way, so they are counted once
        short = not any(s.name in _ORDERED for s in self.stages) or longest(df, series) <= WHOLE_ROWS
        now = Series(df.withColumn(result, ieee.to_nan(F.col(value))), result, tuple(order), tuple(series), KNOWN_SHORT if short else None)
        for i, stage in enumerate(self.stages):
            if stage.name in _OFTEN_READ and any(s.name in _ORDERED for s in self.stages[:i]):
                now = replace(now, df=materialize(now.df, "pipeline"))  # else the windows are worked out again by each pass
            try:
                now = replace(now, df=_LOWER[stage.name](now, **dict(stage.params)))
            except ValueError as e:
                raise StageError(f"stage {i} ({stage.name}) failed: {e}") from e
        return now.df.withColumn(out or value, F.col(result)).drop(result)

    def execute_into(self, df: DataFrame, path: str, value: str, order: Sequence[str], series: Sequence[str] = (), out: str | None = None) -> int:
        """Write the result as Parquet; the number of rows."""
        return write_into(self.execute(df, value, order, series, out), path)


def _row(fn: Callable[..., Column]) -> Callable[..., DataFrame]:
    return lambda s, **p: s.df.withColumn(s.value, fn(F.col(s.value), **p))


def _windowed(stat: str) -> Callable[..., DataFrame]:
    def lower(s: Series, window: int) -> DataFrame:
        return rolling.rolling(s.df, s.value, window, s.order, s.series, [stat], prefix="_r_", whole_rows=s.whole_rows).withColumn(s.value, F.col(f"_r_{stat}")).drop(f"_r_{stat}")

    return lower


def _weighted(stat: str) -> Callable[..., DataFrame]:
    def lower(s: Series, alpha: float) -> DataFrame:
        df = scans.exponentially_weighted(s.df, s.value, alpha, s.order, s.series, "_e_", s.whole_rows)
        return df.withColumn(s.value, F.col(f"_e_{stat}")).drop("_e_mean", "_e_var", "_e_std")

    return lower


def _scan(kind: str) -> Callable[..., DataFrame]:
    return lambda s: scans.cumulative(s.df, s.value, s.order, s.series, kind, s.value, s.whole_rows)


def _lag(kind: str, name: str | None = None) -> Callable[..., DataFrame]:
    return lambda s, **p: scans.lagged(s.df, s.value, s.order, s.series, kind, int(p.get(name, 1)) if name else 1, s.value, s.whole_rows)


_LOWER: dict[str, Callable[..., DataFrame]] = {
    "diff": _lag("diff", "order"),
    "lag": _lag("lag", "k"),
    "log_return": _lag("log_return"),
    "pct_change": _lag("pct_change"),
    "ewma": _weighted("mean"),
    "ewvar": _weighted("var"),
    "ewstd": _weighted("std"),
    "rolling_mean": _windowed("mean"),
    "rolling_std": _windowed("std"),
    "rolling_median": _windowed("median"),
    "rolling_mad": _windowed("mad"),
    "zscore": lambda s: normalize.zscore(s.df, s.value, s.series, s.value),
    "robust_zscore": lambda s, eps: normalize.robust_zscore(s.df, s.value, s.series, s.value),
    "normalize_minmax": lambda s: normalize.normalize_minmax(s.df, s.value, s.order, s.series, s.value),
    "clip": _row(ieee.clip),
    "cumulative_min": _scan("min"),
    "cumulative_max": _scan("max"),
    "fill_forward": _scan("fill_forward"),
    "prefix_sum": _scan("sum"),
    "convolve": lambda s, kernel: scans.convolve_valid(s.df, s.value, kernel, s.order, s.series, s.value, s.whole_rows),
    "scale": _row(lambda x, factor: x * F.lit(float(factor))),
    "shift": _row(lambda x, offset: x + F.lit(float(offset))),
    "abs": _row(F.abs),
    "sqrt": _row(lambda x: F.sqrt(x)),
    "map": _row(lambda x, fn: fn(x)),
}


_ORDERED = {"diff", "lag", "log_return", "pct_change", "ewma", "ewvar", "ewstd", "rolling_mean", "rolling_std", "rolling_median", "rolling_mad", "cumulative_min", "cumulative_max", "fill_forward", "prefix_sum", "convolve"}
#: Stages that read their rows many times.
_OFTEN_READ = {"robust_zscore"}


def pipeline(mode: str = "safe") -> Pipeline:
    """An empty pipeline."""
    if mode not in ("safe", "fast", "deterministic"):
        raise ValueError("mode must be safe, fast or deterministic")
    return Pipeline(mode=mode)
