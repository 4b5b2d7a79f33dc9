"""Time helpers that do not depend on the session time zone.

The supplied ``events.ts`` is ``TIMESTAMP_NTZ`` (a wall time).  Watermarks
and event-time windows need ``TIMESTAMP`` (an instant); casting would read
the wall time in the session time zone, so results would change with a
cluster setting.  These helpers read it as UTC instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_utc_instant(c: Column, dtype: T.DataType) -> Column:
    """``TIMESTAMP_NTZ`` wall time read as a UTC instant; ``TIMESTAMP`` as is."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                                F.date_part(F.lit("SECOND"), c), F.lit("UTC"))
    return c


def utc_date(instant: Column) -> Column:
    """The UTC calendar date of an instant (not the session time zone's)."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / F.lit(86_400)).cast("int"))
