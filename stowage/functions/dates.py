"""Dates found in tags, as zone-free timestamps.

Tags name no zone (a closing 'Z' is read as a letter), so no zone enters the parsing.  A
value must have one of the shapes below in full; the JVM's own cast, which takes one or
two digits per field and gives null for days that do not exist, does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.functions.names import clean

# Date formats seen in photo tags and in container tags.
#   Y:m:d H:M:S   Y-m-d H:M:S                                      (both)
#   Y-m-dTH:M:S.fZ   Y-m-dTH:M:SZ   Y-m-d                          (containers)
_DAY = r"([0-9]{1,2})"
_TIME = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
_YEAR = r"(?!0000)([0-9]{4})"
EXIF_SHAPE = rf"\A{_YEAR}([:-]){_DAY}\2{_DAY}\s+({_TIME})\z"
CONTAINER_SHAPE = (
    rf"\A{_YEAR}(?:-{_DAY}-{_DAY}(?:T({_TIME}(?:\.[0-9]{{1,6}})?)Z|\s+({_TIME}))?"
    rf"|:{_DAY}:{_DAY}\s+({_TIME}))\z"
)

# Photo tags that hold a date; container fields in order of trust.
EXIF_DATE_TAGS = ("DateTime", "DateTimeOriginal", "DateTimeDigitized")
CONTAINER_DATE_FIELDS = (
    "creation_time",
    "date",
    "com.apple.quicktime.creationdate",
    "com.apple.quicktime.make",
    "DATE_DIGITIZED",
    "DATE",
)


def _cast(text: Column, shape: str, standard: str) -> Column:
    iso = F.regexp_replace(text, shape, standard)
    return F.when(text.rlike(shape), iso.try_cast("timestamp_ntz"))


def parse_exif(value: Column) -> Column:
    return _cast(clean(value), EXIF_SHAPE, "$1-$3-$4 $5")


def parse_container(value: Column) -> Column:
    """All-zero dates are no dates and give null."""
    text = F.btrim(value, F.lit(" \t\n\r\x0b\x0c"))
    return _cast(text, CONTAINER_SHAPE, "$1-$2$6-$3$7 $4$5$8")


def container_keys(fields: Sequence[str] = CONTAINER_DATE_FIELDS) -> list[str]:
    """Each field as it is, in lower and in upper case; every spelling once."""
    spelled = [s for f in fields for s in (f, f.lower(), f.upper())]
    return list(dict.fromkeys(spelled))


def container_date(tags: Column) -> Column:
    """First spelling whose value parses, from a MAP<STRING, STRING>; no further one is looked at."""
    return F.coalesce(*[parse_container(F.try_element_at(tags, F.lit(k))) for k in container_keys()])


def file_date(mtime: Column) -> Column:
    return mtime.cast("timestamp_ntz")
