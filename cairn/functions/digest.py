"""SHA-1 digests in Base32 text: making, checking, ordering. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Base32 alphabet, and the alphabet in which text order is byte order.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORDERED = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PATTERN = r"\A[A-Z2-7]{32}\z"
BLANKS = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """text without white space around it (any Unicode white space); null stays null."""
    return F.regexp_replace(text, BLANKS, "")


def sha1_base32(data: Column) -> Column:
    """The 32 Base32 characters of the SHA-1 of a string or binary column; null for null."""
    code = F.upper(F.sha1(data))
    parts = [F.lpad(F.conv(F.substring(code, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), ORDERED, ALPHABET)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(PATTERN), F.lit(False))


def digest_bytes(text: Column) -> Column:
    """The 20 bytes of a well-formed digest, else null."""
    ordered = F.translate(text, ALPHABET, ORDERED)
    parts = [F.lpad(F.conv(F.substring(ordered, 1 + 8 * i, 8), 32, 16), 10, "0") for i in range(4)]
    return F.when(is_digest(text), F.unhex(F.concat(*parts)))


def order_key(text: Column) -> Column:
    """A text whose order is the byte order of well-formed digests; null for others."""
    return F.when(is_digest(text), F.translate(text, ALPHABET, ORDERED))


def lenient_order(text: Column) -> list[Column]:
    """Sort keys that put well-formed digests first, by bytes, and all others after them, by text."""
    return [order_key(text).isNull(), order_key(text), text]


def clean(text: Column) -> Column:
    """The clean form: no blanks around it, upper case, without a leading SHA1: (null for null)."""
    return F.regexp_replace(F.upper(strip(text)), "^SHA1:", "")


def clean_digest(text: Column) -> Column:
    """The clean form where it is a digest, else null."""
    c = clean(text)
    return F.when(c.rlike(PATTERN), c)
