"""Days and quota days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

#: Fixed value: the zone whose midnight renews quotas.
QUOTA_ZONE = "America/Los_Angeles"


def utc_day(ts) -> Column:
    """M02."""
    return F.to_date(F.date_trunc("day", col(ts)))


def quota_day(ts) -> Column:
    """M01. The date in the quota zone; days are 23 or 25 hours long when clocks change."""
    return F.to_date(F.from_utc_timestamp(col(ts), QUOTA_ZONE))


def quota_day_start(ts) -> Column:
    return F.to_utc_timestamp(quota_day(ts).cast("timestamp"), QUOTA_ZONE)


def next_reset(ts) -> Column:
    return F.to_utc_timestamp(F.date_add(quota_day(ts), 1).cast("timestamp"), QUOTA_ZONE)
