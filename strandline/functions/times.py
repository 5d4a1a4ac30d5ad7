"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a date or timestamp; those without time zone are read as UTC, whatever the session's zone."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86_400_000_000)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(c.cast("timestamp"))
