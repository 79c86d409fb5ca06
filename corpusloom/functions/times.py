"""Time literals."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(value: datetime) -> Column:
    """A literal of a UTC time without a zone: the same in every session, whatever zone that or the machine is set to."""
    plain = value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
    return F.lit(plain.isoformat(sep=" ")).cast("timestamp_ntz")
