"""14-digit archive timestamps. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMAT = "yyyyMMddHHmmss"
#: The Unix seconds of 1000-01-01 00:00:00 and 9999-12-31 23:59:59.
LEAST, MOST = -30_610_224_000, 253_402_300_799


def parse(text: Column) -> Column:
    """The timestamp of 14 digits that exist in calendar and clock, year 1000 or later; else null."""
    return F.when(text.rlike(r"\A[1-9][0-9]{13}\z"), F.try_to_timestamp(text, F.lit(FORMAT)))


def is_real(text: Column) -> Column:
    return F.coalesce(parse(text).isNotNull(), F.lit(False))


def text_of(moment: Column) -> Column:
    return F.date_format(moment, FORMAT)


def to_unix(moment: Column) -> Column:
    return F.unix_seconds(moment)


def from_unix(seconds: Column) -> Column:
    """The timestamp of Unix seconds within the years 1000 to 9999; else null."""
    return F.when(seconds.between(LEAST, MOST), F.timestamp_seconds(seconds))


def observed_second(moment: Column) -> Column:
    """Whole seconds, rounded down also before 1970."""
    return F.floor(F.unix_micros(moment) / F.lit(1_000_000)).cast("bigint")
