"""Shapes shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("dir", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),  # file, other (broken link, special), dir
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("read_error", T.StringType()),
    ]
)

#: Bytes a file system takes in one name.
NAME_BYTES = 255

#: Columns of every plan, in this order.
PLAN_COLUMNS = ["path", "action", "target", "reason", "size", "group_key"]

# Suffixes of each media family.
MEDIA_FAMILIES = {
    "photo": [
        ".arw", ".bmp", ".cr2", ".dng", ".gif", ".heic", ".heif", ".jpeg", ".jpg",
        ".nef", ".png", ".raw", ".tif", ".tiff", ".webp",
    ],
    "video": [
        ".3gp", ".asf", ".avi", ".flv", ".m2ts", ".m2v", ".m4v", ".mkv", ".mov", ".mp4",
        ".mpeg", ".mpg", ".mts", ".ts", ".webm", ".wmv",
    ],
    "music": [".ape", ".flac", ".m4a", ".mp3", ".ogg", ".wav"],
}
