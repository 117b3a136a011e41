"""Text forms of a point in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The zone of the load clock and the formats.
LOAD_ZONE = "Asia/Kolkata"
LOAD_CLOCK = "yyyyMMddHHmmssSSSSSS"
SEQUENCE_CLOCK = "yyyyMMddHHmmss"
START_CLOCK = "yyyy-MM-dd HH:mm:ss.SSS"


def load_clock(ts: Column, zone: str = LOAD_ZONE) -> Column:
    """Microsecond clock in ``zone``; ``ts`` is an instant, or wall time of the session zone."""
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.date_format(local, LOAD_CLOCK)


def sequence_clock(ts: Column) -> Column:
    return F.date_format(ts, SEQUENCE_CLOCK)


def start_clock(ts: Column) -> Column:
    return F.date_format(ts, START_CLOCK)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of wall time that carries no zone, taken as UTC."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))
