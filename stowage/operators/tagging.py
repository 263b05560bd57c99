"""Values picked from tags: dates, makes and music fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import dates, names
from stowage.sources.tags import first_of_list

# Tags to look at for each music field, in order.
MUSIC_TAGS = {
    "artist": ["TPE1", "ARTIST", "albumartist", "TPE2"],
    "album": ["TALB", "ALBUM"],
    "title": ["TIT2", "TITLE"],
    "track": ["TRCK", "TRACKNUMBER"],
    "date": ["TDRC", "DATE", "YEAR"],
    "genre": ["TCON", "GENRE"],
}


def photo_facts(tags: DataFrame) -> DataFrame:
    """(path, taken, make) from rows (path, pos, tag, value).

    ``taken`` is the first date tag, in stored order, that parses.
    """
    dated = F.col("tag").isin(*dates.EXIF_DATE_TAGS)
    taken = F.when(dated, dates.parse_exif(F.col("value")))
    make = F.when(F.col("tag") == "Make", F.col("value"))
    return (
        tags.filter(dated | (F.col("tag") == "Make"))
        .select("path", "pos", taken.alias("taken"), make.alias("make"))
        .groupBy("path")
        .agg(
            F.min_by("taken", F.when(F.col("taken").isNotNull(), F.col("pos"))).alias("taken"),
            F.min_by("make", F.when(F.col("make").isNotNull(), F.col("pos"))).alias("make"),
        )
    )


def known_make(make: Column) -> Column:
    """Null for a missing, empty or 'Unknown' make."""
    text = names.clean(make)
    return F.when((text != "") & (text != names.UNKNOWN), text)


def music_field(tags: Column, field: str) -> Column:
    """First tag of the field that is present in MAP<STRING, ARRAY<STRING>>, even if empty."""
    present = [F.try_element_at(tags, F.lit(t)) for t in MUSIC_TAGS[field]]
    return first_of_list(F.coalesce(*present))
