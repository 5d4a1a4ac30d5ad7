"""IEEE semantics on Spark columns: NaN stands for a missing number, division and logarithm never fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def to_nan(c: Column) -> Column:
    """Double, with NaN for null."""
    return F.coalesce(c.cast("double"), F.lit(NAN))


def to_null(c: Column) -> Column:
    """Double, with null for NaN."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN in place of errors."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def ieee_ln(x: Column) -> Column:
    """Natural logarithm: -inf at zero, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(NAN))


def beyond(z: Column, threshold: float) -> Column:
    """|z| above the threshold; false for NaN, which Spark would rank above every number."""
    return F.coalesce(~F.isnan(z) & (F.abs(z) > threshold), F.lit(False))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clamp to lo..hi; NaN stays, null becomes NaN."""
    if lo > hi:
        raise ValueError("lo is above hi")
    v = to_nan(x)
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


def where(mask: Column, a: Column, b: Column) -> Column:
    """a where the mask is not zero, b elsewhere and where the mask is null."""
    return F.when(mask.cast("int") != 0, a).otherwise(b)


def fill_missing(x: Column, missing: float, replacement: float, nan_too: bool = False) -> Column:
    """Replace a sentinel, and with ``nan_too`` NaN and null."""
    v = to_nan(x)
    hit = (v == F.lit(float(missing))) & ~F.isnan(v)
    return F.when(hit | (F.isnan(v) & F.lit(nan_too)), F.lit(float(replacement))).otherwise(v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, also where the body uses it within a higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def median_of_sorted(a: Column) -> Column:
    """Median of a sorted array: mean of the two middle elements; null if empty."""
    n = F.size(a)
    return F.when(n > 0, (F.element_at(a, ((n + 1) / 2).cast("int")) + F.element_at(a, (n / 2).cast("int") + 1)) / 2)


def upper_median_of_sorted(a: Column) -> Column:
    """Middle element of a sorted array, the upper one of two."""
    n = F.size(a)
    return F.when(n > 0, F.element_at(a, (n / 2).cast("int") + 1))


def type7_of_sorted(a: Column, q: float) -> Column:
    """Quantile of a sorted array by linear interpolation at (n - 1) q; null if empty."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie in 0..1")
    h = (F.size(a) - 1) * F.lit(float(q))
    lo = F.floor(h).cast("int")
    x, y = F.element_at(a, lo + 1), F.element_at(a, F.least(lo + 2, F.size(a)))
    return F.when(F.size(a) > 0, x + (h - lo) * (y - x))
