"""Timestamps without zone as microseconds since 1970, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(column: Column | str) -> Column:
    """Microseconds of a timestamp's own calendar reading; null stays null."""
    t = F.col(column) if isinstance(column, str) else column
    second = (F.extract(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("bigint")
    return F.unix_date(t.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(t).cast("bigint") * 3_600_000_000 + F.minute(t).cast("bigint") * 60_000_000 + second


def from_micros(column: Column) -> Column:
    """The timestamp without zone that micros() came from."""
    seconds = F.floor(column / F.lit(1_000_000)).cast("bigint")
    rest = F.pmod(column, F.lit(1_000_000))
    whole = (seconds.cast("decimal(18,6)") + rest.cast("decimal(18,6)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole)
