"""Fields of index records. JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The known status codes; - stands for none.
STATUS_CODES = (200, 301, 302, 303, 307, 308, 400, 401, 403, 404, 408, 426, 429, 431, 500, 502, 503, 504, 520, 521, 522, 524, 525, 530)
CLOUDFLARE = (520, 521, 522, 524, 525, 530)
HEADER = ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length")
EXTENDED_HEADER = ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "redirect", "robotflags", "length", "offset", "filename")
LONGEST = 65_535


def status_value(text: Column) -> Column:
    """The number of a known status code, 0 for -; null for any other."""
    return F.when(text == "-", 0).when(text.isin([str(c) for c in STATUS_CODES]), F.try_to_number(text, F.lit("999")).cast("int"))


def status_text(value: Column) -> Column:
    return F.when(value == 0, "-").when(value.isin(*STATUS_CODES), value.cast("string"))


def status_logical(text: Column) -> Column:
    """The HTTP status that a known code stands for: none means 200, the proxy's own errors mean 500."""
    value = status_value(text)
    return F.when(value == 0, 200).when(value.isin(*CLOUDFLARE), 500).otherwise(value)


def dash_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit("-"))


def length_value(text: Column) -> Column:
    """A signed whole number; null for - and for what is none (see length_fault)."""
    return F.when(text.rlike(r"\A[-+]?[0-9]+\z"), text.try_cast("bigint"))


def length_fault(text: Column) -> Column:
    return text.isNotNull() & (text != "-") & length_value(text).isNull()


def item_fault(key: Column, seconds: Column, url: Column, mime: Column, digest: Column, digest_valid: Column) -> Column:
    """The first reason why an index can't hold a record, else null."""
    return (
        F.when(F.instr(key, "\0") > 0, "surt_nul")
        .when(seconds < 0, "negative_timestamp")
        .when(F.octet_length(url) > LONGEST, "url_too_long")
        .when(F.octet_length(mime) > LONGEST, "mime_type_too_long")
        .when(~digest_valid & (F.octet_length(digest) > LONGEST), "digest_too_long")
    )
