from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from stowage.functions import globs, names, sizes

ODD = [
    "a.TXT", "c.tar.gz", "README", ".bashrc", "foo.", ".a.b", "..a", "a..b", "x.y z", "...", ".", "é.JPG",
    "a\nb.txt", "sp ace.mp3", "noext.", "a.b.",
]


def evaluate(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def python_suffix(name):
    dot = name.rfind(".")
    return name[dot:] if 0 < dot < len(name) - 1 else ""


def test_suffix_and_stem(spark):
    v = F.col("v")
    rows = evaluate(spark, ODD, names.suffix_of(v), names.stem_of(v))
    for name, (suffix, stem) in zip(ODD, rows):
        assert suffix == python_suffix(name), name
        assert stem + suffix == name
    plain = [n for n in ODD if n not in ("...", ".", "..a")]
    for name, (suffix, _) in zip(ODD, rows):
        if name in plain:
            assert suffix == PurePosixPath(name).suffix or name.endswith(".")


def test_labels(spark):
    v = F.col("v")
    rows = evaluate(
        spark, ["a.TXT", "README"], names.extension_label(v), names.suffix_label(v), names.extension(v),
        names.display_label(names.extension_label(v)),
    )
    assert rows == [("txt", ".txt", "txt", "txt"), ("no_extension", "no_extension", "", "(no extension)")]


def test_paths(spark):
    v = F.col("v")
    rows = evaluate(spark, ["a/b/c.t", "c.t", ".x/y"], names.name_of(v), names.parent_of(v), names.depth_of(v), names.is_hidden(v))
    assert rows == [("c.t", "a/b", 3, False), ("c.t", "", 1, False), ("y", ".x", 2, True)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("<1>:2", "_1__2"),
        ('what?"*|', "what____"),
        ("a/b\\c", "a_b_c"),
        (" . .x. y .", "x. y"),
        ("", "Unknown"),
        (" .. ", "Unknown"),
        ("A" * 250, "A" * 200),
        ("x" * 199 + " .tail", "x" * 199 + " "),
        ("😀" * 201, "😀" * 200),
    ],
)
def test_sanitize(spark, text, expected):
    assert evaluate(spark, [text], names.sanitize(F.col("v"))) == [(expected,)]


@pytest.mark.parametrize(
    "name, taken, expected",
    [
        ("lake at dusk.heic", "1999-02-03 04:05:06", "1999/02-February/19990203_040506_lake at dusk.heic"),
        ("bad<file>name.jpg", "2023-01-15 09:45:30", "2023/01-January/20230115_094530_bad_file_name.jpg"),
        ("n" * 220 + ".jpg", "2023-01-15 09:45:30", "2023/01-January/20230115_094530_" + "n" * 184),
    ],
)
def test_dated_path(spark, name, taken, expected):
    when = F.lit(taken).cast("timestamp_ntz")
    path = F.concat_ws("/", names.dated_dir(when), names.dated_name(F.col("v"), when))
    assert evaluate(spark, [name], path) == [(expected,)]


@pytest.mark.parametrize(
    "track, expected",
    [("1", "01"), ("1/10", "01"), ("12/9", "12"), ("007", "07"), ("0", "00"), ("A1", "A1"), ("/9", None),
     ("", None), ("123", "123"), ("²", "²"), (None, None)],
)
def test_track(spark, track, expected):
    assert evaluate(spark, [track], names.track_prefix(F.col("v"))) == [(expected,)]


@pytest.mark.parametrize(
    "artist, album, title, track, expected",
    [
        ("Some Choir", "Hymns", "Dawn", "7", "Some Choir/Hymns/07 - Dawn.mp3"),
        ("Some Choir", "Hymns", "Dawn", "7/12", "Some Choir/Hymns/07 - Dawn.mp3"),
        (None, None, None, None, "Unknown Artist/Unknown Album/test.mp3"),
        ("", "", "", "", "Unknown/Unknown/Unknown.mp3"),
        ("N/A", "Two: Three", "Who? Me?", "30", "N_A/Two_ Three/30 - Who_ Me_.mp3"),
    ],
)
def test_music_path(spark, artist, album, title, track, expected):
    df = spark.createDataFrame([(artist, album, title, track)], "a string, b string, t string, n string")
    path = F.concat_ws(
        "/",
        names.music_dir(F.col("a"), F.col("b")),
        names.music_name(F.lit("test.mp3"), F.col("t"), F.col("n")),
    )
    assert df.select(path).first()[0] == expected


def test_make_directory(spark):
    v = F.col("v")
    rows = evaluate(spark, [" Canon ", "A/B"], names.make_dir(v), names.make_dir(v, raw=True))
    assert rows == [("by_make/Canon", "by_make/Canon"), ("by_make/A_B", "by_make/A/B")]


def test_extensions_are_normalized():
    assert names.normalize_extensions([".PY", "Java", ".C", "TXT", "py"]) == ["c", "java", "py", "txt"]
    assert names.normalize_extensions(["."]) == [""]


def test_directory_names(spark):
    df = spark.range(1).select(
        names.batch_dir(F.lit(7)), names.batch_dir(F.lit(1234)), names.extension_dir(F.lit("py"))
    )
    assert tuple(df.first()) == ("batch_007", "batch_1234", "py_files")


@pytest.mark.parametrize(
    "pattern, hits",
    [
        ("*.jpg", ["Photo.JPG", "a.jpg"]),
        ("?.jpg", ["a.jpg"]),
        ("[!a]*", ["Photo.JPG", "x(1).txt", "new\nline.txt", "[z]"]),
        ("[a-b]*", ["a.jpg"]),
        ("x(1).txt", ["x(1).txt"]),
        ("*", ["Photo.JPG", "a.jpg", "x(1).txt", "new\nline.txt", "[z]"]),
        ("*n*e*", ["new\nline.txt"]),
        ("[[]z]", ["[z]"]),
        ("a", []),
    ],
)
def test_globs(spark, pattern, hits):
    values = ["Photo.JPG", "a.jpg", "x(1).txt", "new\nline.txt", "[z]"]
    rows = evaluate(spark, values, globs.matches_any(F.col("v"), [pattern]))
    assert [v for v, (hit,) in zip(values, rows) if hit] == hits


def test_sizes(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1024**3,), (5 * 1024**5,)], "s long")
    text = [r[0] for r in df.select(sizes.human_bytes(F.col("s"))).collect()]
    assert text == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 GB", "5.0 PB"]
