"""Words as the operators here count them, as Column builders and for Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Everything of ASCII but digits and small letters separates words; the rest of Unicode is kept.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BYTE_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words as an array; null and blank texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words of one text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTE_TABLE).split()
