"""Names, suffixes and target paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_EXTENSION = "no_extension"
UNKNOWN = "Unknown"

# Characters a file name may not hold, and the longest name kept.
FORBIDDEN = '<>:"/\\|?*'
MAX_NAME = 200


def path_decoder():
    """From the path of a manifest to the one the file system knows, for use in workers.

    A byte of a name that is not UTF-8 stands in a manifest as a NUL, which no name holds, and two hex
    digits.  Built as a closure so that it travels to executors without the package.
    """

    def decode(path):
        import re

        return re.sub("\x00([0-9A-F]{2})", lambda m: chr(0xDC00 + int(m[1], 16)), path) if path else path

    return decode


def path_encoder():
    """The inverse of ``path_decoder``."""

    def encode(path):
        import re

        return re.sub("[\udc80-\udcff]", lambda m: f"\x00{ord(m[0]) - 0xDC00:02X}", path)

    return encode


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Everything before the last slash, '' for a bare name."""
    return F.left(path, F.greatest(F.length(path) - F.length(name_of(path)) - 1, F.lit(0)))


def suffix_of(name: Column) -> Column:
    """Suffix with its dot and its case, '' if there is none.

    It starts at the last dot, unless that dot is the first or the last character.
    """
    tail = F.substring_index(name, ".", -1)
    before = F.length(name) - F.length(tail)
    found = F.right(name, F.length(tail) + 1)
    return F.when((before > 1) & (tail != ""), found).when(name.isNotNull(), "")


def stem_of(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix_of(name)))


def extension(name: Column) -> Column:
    """Lower-case suffix without its dot, '' if there is none."""
    return F.ltrim(F.lower(suffix_of(name)), F.lit("."))


def extension_label(name: Column) -> Column:
    """Lower-case suffix without its dot, or the label for none."""
    return F.coalesce(_nonempty(extension(name)), F.lit(NO_EXTENSION))


def suffix_label(name: Column) -> Column:
    """Lower-case suffix with its dot, or the label for none."""
    return F.coalesce(_nonempty(F.lower(suffix_of(name))), F.lit(NO_EXTENSION))


def display_label(label: Column) -> Column:
    return F.when(label == NO_EXTENSION, F.lit("(no extension)")).otherwise(label)


def is_hidden(rel_path: Column) -> Column:
    """Any component below the root starts with a dot."""
    return rel_path.startswith(".") | rel_path.contains("/.")


def depth_of(rel_path: Column) -> Column:
    """1 for a direct child of the root."""
    return F.length(rel_path) - F.length(F.replace(rel_path, F.lit("/"), F.lit(""))) + 1


def sanitize(text: Column) -> Column:
    """A name that any file system takes; the strip comes before the cut."""
    swapped = F.translate(text, FORBIDDEN, "_" * len(FORBIDDEN))
    cut = F.left(F.btrim(swapped, F.lit(". ")), F.lit(MAX_NAME))
    return F.regexp_replace(cut, r"\A\z", UNKNOWN)  # only if empty; evaluates ``cut`` once


def under(root: str, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), *parts) if root else F.concat_ws("/", *parts)


def dated_name(name: Column, taken: Column) -> Column:
    """Stamp, sanitized stem and suffix; the whole is sanitized once more."""
    stamp = F.date_format(taken, "yyyyMMdd_HHmmss")
    return sanitize(F.concat(stamp, F.lit("_"), sanitize(stem_of(name)), suffix_of(name)))


def dated_dir(taken: Column) -> Column:
    return F.date_format(taken, "yyyy/MM-MMMM")


def make_dir(make: Column, raw: bool = False) -> Column:
    """Directory per camera make.  ``raw`` keeps a make as it is, slashes included."""
    trimmed = clean(make)
    return F.concat_ws("/", F.lit("by_make"), trimmed if raw else sanitize(trimmed))


def clean(text: Column) -> Column:
    """White space off both ends, then NUL characters."""
    return F.btrim(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")), F.lit("\x00"))


def track_prefix(track: Column) -> Column:
    """'3/12' -> '03'; text that is no number stays; null when nothing is left."""
    first = F.split_part(track, F.lit("/"), F.lit(1))
    digits = F.regexp_replace(first, r"\A0+(?=.)", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return _nonempty(F.when(first.rlike(r"\A[0-9]+\z"), padded).otherwise(first))


def music_dir(artist: Column, album: Column) -> Column:
    return F.concat_ws(
        "/",
        sanitize(F.coalesce(artist, F.lit("Unknown Artist"))),
        sanitize(F.coalesce(album, F.lit("Unknown Album"))),
    )


def music_name(name: Column, title: Column, track: Column) -> Column:
    """'NN - title.suffix', or 'title.suffix' without a track."""
    song = F.concat(sanitize(F.coalesce(title, stem_of(name))), suffix_of(name))
    return sanitize(F.concat_ws(" - ", track_prefix(track), song))


def batch_dir(batch: Column) -> Column:
    return F.format_string("batch_%03d", batch)


def extension_dir(ext: Column) -> Column:
    return F.concat(ext, F.lit("_files"))


def normalize_extensions(extensions: list[str]) -> list[str]:
    """User input: lower case, no leading dots, each once, in ascending order."""
    return sorted({e.lower().lstrip(".") for e in extensions})


def hash_prefix(digest: Column) -> Column:
    return F.left(digest, F.lit(16))
