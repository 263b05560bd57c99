import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stowage.operators import batching, counting, emptiness, filters
from stowage.plans import common, media
from stowage.plans.curate import curate
from stowage.plans.dedupe import dedupe_files
from stowage.plans.extensions import organize_by_extension, output_directories
from stowage.plans.split import flatten_batches, split_into_batches
from stowage.sinks import apply, reports
from stowage.sources import tree
from stowage.sources.tables import from_table

from test_sources import make, rels

MIB = 1024**2
FILE_TIME = datetime(2022, 3, 4, 5, 6, 7)


def manifest(spark, rows):
    """rows: (rel_path, size[, ...]); further columns are given by the caller."""
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "rel string, s long")
    return from_table(df, F.col("rel"), size=F.col("s"), mtime=F.lit(FILE_TIME))


def actions(plan):
    return {r.path: (r.action, r.target) for r in plan.collect()}


# -- by extension ------------------------------------------------------------------------


def test_files_go_to_their_extension(spark):
    names = ["script1.py", "nested/script2.py", "Program.JAVA", "header.c", "image.jpg"]
    plan = organize_by_extension(manifest(spark, [(n, 1) for n in names]), ["py", "java", "c"], "/out")
    assert actions(plan) == {
        "script1.py": ("move", "/out/py_files/script1.py"),
        "nested/script2.py": ("move", "/out/py_files/script2.py"),
        "Program.JAVA": ("move", "/out/java_files/Program.JAVA"),
        "header.c": ("move", "/out/c_files/header.c"),
    }
    row = common.outcome(plan).first()
    assert (row.processed, row.moved, row.errors) == (4, 4, 0)


def test_recovery_tree(spark):
    names = ["f1.py", "f2.py", "f3.py", "g1.java", "g2.java", "h.c", "h.h", "h.cpp", "k1.dll", "k2.dll", "x.txt", "y.log", "z"]
    rows = manifest(spark, [(f"recup_dir.{i % 7}/{n}", 1) for i, n in enumerate(names)])
    plan = organize_by_extension(rows, ["py", "java", "c", "h", "cpp"], "/out")
    assert common.outcome(plan).first().moved == 8


def test_files_without_extension(spark):
    plan = organize_by_extension(manifest(spark, [("README", 1), ("a.t", 1)]), ["."], "/out")
    assert actions(plan) == {"README": ("move", "/out/_files/README")}


def test_name_conflicts_and_copies(spark):
    held = manifest(spark, [("py_files/test.py", 5)])
    rows = manifest(spark, [("a/test.py", 1), ("b/test.py", 2), ("c/other.py", 5)])
    plan = organize_by_extension(
        rows, ["py"], "/out", copy=True, existing=held, skip_duplicates=True, method="size"
    )
    assert actions(plan) == {
        "a/test.py": ("copy", "/out/py_files/test_1.py"),
        "b/test.py": ("copy", "/out/py_files/test_2.py"),
        "c/other.py": ("skip", None),
    }


def test_cap_admits_whole_batches(spark):
    rows = manifest(spark, [(f"{e}{i}.{e}", i + 1) for e in ("a", "b", "c") for i in range(5)])
    plan = organize_by_extension(rows, ["a", "b", "c"], "/out", max_files=6, batch_size=2)
    row = common.outcome(plan).first()
    assert row.moved == 7  # 2 + 2 + 1 of a, then one batch of b
    assert plan.filter("action = 'not_reached'").count() == 8
    assert common.outcome(organize_by_extension(rows, ["a"], "/out", max_files=0)).first().moved == 5


def sequential_cap(rows, batch_size, limit):
    """rows: (ext, path, moves) in order -> paths admitted."""
    moved, admitted = 0, set()
    for ext in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == ext]
        for start in range(0, len(mine), batch_size):
            if limit and moved >= limit:
                break
            for _, path, moves in mine[start : start + batch_size]:
                admitted.add(path)
                moved += moves
    return admitted


@pytest.mark.parametrize("group_rows", [None, 4])
def test_cap_equals_the_loop(spark, group_rows):
    import random

    rng = random.Random(4)
    for limit, size in [(1, 3), (7, 2), (12, 5), (500, 3)]:
        rows = sorted((rng.choice("abc"), f"p{i:03d}", rng.random() < 0.6) for i in range(40))
        df = spark.createDataFrame(rows, "ext string, path string, moves boolean")
        df = df.withColumn("action", F.when(F.col("moves"), "move").otherwise("skip"))
        capped = batching.cap_moves(batching.chunk(df, size, group_rows=group_rows), limit, group_rows=group_rows)
        found = {r.path for r in capped.filter("admitted").collect()}
        assert found == sequential_cap(rows, size, limit)


def test_space_gate(spark):
    rows = manifest(spark, [("a.py", 1000), ("b.py", 1000), ("c.c", 10)])
    plan = organize_by_extension(rows, ["py", "c"], "/out", free_bytes=199)
    row = common.outcome(plan).first()
    assert (row.moved, row.skipped_space) == (1, 2)
    assert common.outcome(organize_by_extension(rows, ["py"], "/out", free_bytes=200)).first().moved == 2
    assert common.outcome(organize_by_extension(rows, ["py"], "/o", copy=True, free_bytes=2199)).first().moved == 0


def test_removing_needs_skipping(spark):
    with pytest.raises(ValueError):
        organize_by_extension(manifest(spark, [("a.py", 1)]), ["py"], "/out", remove_source_duplicates=True)


def test_directories_of_all_extensions(spark):
    found = output_directories(manifest(spark, [("a.py", 1)]), ["py", ".RS"], "/out").collect()
    assert sorted(r.directory for r in found) == ["/out/py_files", "/out/rs_files"]


# -- media -------------------------------------------------------------------------------


def tags(spark, rows):
    return spark.createDataFrame(rows, "path string, pos int, tag string, value string")


def test_photos(spark):
    rows = manifest(spark, [(n, 1) for n in ["a/vac.jpg", "b/vac.jpg", "c/vac.jpg", "no.png", "make.jpg", "x.txt", "bad.jpg"]])
    rows = rows.withColumn("tag_error", F.col("path") == "bad.jpg")
    date = "2023:12:25 14:30:22"
    exif = tags(
        spark,
        [
            ("a/vac.jpg", 0, "DateTime", date),
            ("b/vac.jpg", 0, "DateTime", "invalid"),
            ("b/vac.jpg", 1, "DateTimeOriginal", date),
            ("b/vac.jpg", 2, "DateTimeDigitized", "2001:01:01 00:00:00"),
            ("c/vac.jpg", 3, "DateTimeDigitized", "2023-12-25 14:30:22"),
            ("make.jpg", 0, "Make", " A/B "),
            ("make.jpg", 1, "Software", date),
            ("no.png", 0, "Make", "  "),
        ],
    )
    plan = media.organize_photos(rows, exif, "/out")
    base = "/out/2023/12-December/20231225_143022_vac"
    assert actions(plan) == {
        "a/vac.jpg": ("move", f"{base}.jpg"),
        "b/vac.jpg": ("move", f"{base}_1.jpg"),
        "c/vac.jpg": ("move", f"{base}_1_2.jpg"),
        "make.jpg": ("move", "/out/by_make/A_B/make.jpg"),
        "no.png": ("skip", None),
        "bad.jpg": ("error", None),
    }
    raw = actions(media.organize_photos(rows, exif, "/out", raw_make=True, fallback="mtime"))
    assert raw["make.jpg"][1] == "/out/by_make/A/B/make.jpg"
    assert raw["no.png"][1] == "/out/2022/03-March/20220304_050607_no.png"


def test_names_too_long_are_errors(spark):
    long = "é" * 150 + ".jpg"  # 150 characters, 300 bytes
    exif = tags(spark, [(long, 0, "DateTime", "2023:12:25 14:30:22")])
    plan = media.organize_photos(manifest(spark, [(long, 1)]), exif, "/out").first()
    assert (plan.action, plan.target, plan.reason) == ("error", None, "name too long")


def test_existing_photo_keeps_its_name(spark):
    held = manifest(spark, [("2023/12-December/20231225_143022_vac.jpg", 1)])
    exif = tags(spark, [("vac.jpg", 0, "DateTime", "2023:12:25 14:30:22")])
    plan = media.organize_photos(manifest(spark, [("vac.jpg", 1)]), exif, "/out", existing=held)
    assert actions(plan)["vac.jpg"][1].endswith("_vac_1.jpg")


def test_videos(spark):
    probes = {
        "good.MP4": '{"format": {"tags": {"creation_time": "2023-12-25T14:30:22.000000Z"}}}',
        "none.mov": '{"format": {}}',
        "broken.avi": "no json",
        "zero.mkv": '{"format": {"tags": {"date": "0000-00-00T00:00:00.000000Z"}}}',
    }
    probe = F.create_map(*[F.lit(x) for item in probes.items() for x in item])[F.col("name")]
    rows = manifest(spark, [(n, 1) for n in [*probes, "x.txt"]]).withColumn("probe", probe)
    plan = media.organize_videos(rows, "/out")
    assert actions(plan) == {
        "good.MP4": ("move", "/out/2023/12-December/20231225_143022_good.MP4"),
        "none.mov": ("move", "/out/2022/03-March/20220304_050607_none.mov"),
        "zero.mkv": ("move", "/out/2022/03-March/20220304_050607_zero.mkv"),
        "broken.avi": ("error", None),
    }
    row = common.outcome(plan).first()
    assert (row.processed, row.moved, row.errors) == (4, 3, 1)


def test_music(spark):
    rows = [
        ("1.mp3", {"TPE1": ["The Beatles"], "TALB": ["Abbey Road"], "TIT2": ["Come Together"], "TRCK": ["1/17"]}),
        ("2.flac", {"ARTIST": ["The Beatles"], "ALBUM": ["Abbey Road"], "TITLE": ["Something"], "TRACKNUMBER": ["2"]}),
        ("3.mp3", None),
        ("4.mp3", {"TPE1": [], "TPE2": ["Second"], "TALB": [""]}),
        ("5.txt", {}),
    ]
    df = spark.createDataFrame(rows, "rel string, tags map<string,array<string>>")
    plan = media.organize_music(from_table(df, F.col("rel"), size=F.lit(1), tags=F.col("tags")), "/m")
    assert actions(plan) == {
        "1.mp3": ("move", "/m/The Beatles/Abbey Road/01 - Come Together.mp3"),
        "2.flac": ("move", "/m/The Beatles/Abbey Road/02 - Something.flac"),
        "3.mp3": ("move", "/m/Unknown Artist/Unknown Album/3.mp3"),
        "4.mp3": ("move", "/m/Unknown Artist/Unknown/4.mp3"),
    }


# -- batches -----------------------------------------------------------------------------


def test_split(spark):
    sizes = [8, 7, 4, 3, 1, 1]
    rows = manifest(spark, [(f"f{i}.bin", s * MIB) for i, s in enumerate(sizes)] + [("sub/deep.bin", MIB), ("empty", 0)])
    plan = split_into_batches(rows, "/out", 0.01)
    assert {p: t for p, (_, t) in actions(plan).items()} == {
        "f0.bin": "/out/batch_001/f0.bin",
        "f1.bin": "/out/batch_002/f1.bin",
        **{f"f{i}.bin": f"/out/batch_003/f{i}.bin" for i in (2, 3, 4, 5)},
    }


def test_split_next_to_existing_files(spark):
    held = manifest(spark, [("batch_001/a.txt", 1), ("batch_001/a_001.txt", 1)])
    plan = split_into_batches(manifest(spark, [("a.txt", 1)]), "/out", 1.0, held)
    assert actions(plan)["a.txt"][1] == "/out/batch_001/a_002.txt"


def test_flatten(spark):
    rows = manifest(spark, [("batch_001/a.txt", 1), ("batch_002/b.txt", 1), ("batch_002/a.txt", 0), ("top", 1), ("x/y/z", 1)])
    assert actions(flatten_batches(rows, "/out")) == {
        "batch_001/a.txt": ("move", "/out/a.txt"),
        "batch_002/a.txt": ("move", "/out/a_001.txt"),
        "batch_002/b.txt": ("move", "/out/b.txt"),
    }


def test_statistics(spark):
    sizes = [("a.jpg", 2), ("b.jpg", 3), ("c.pdf", 1.5), ("d.txt", 0.5)]
    rows = manifest(spark, [(n, int(s * MIB)) for n, s in sizes])
    row = counting.directory_statistics(rows, 10_737_418).first()
    assert (row.total_files, row.total_size_gb, row.estimated_subdirs) == (4, 7 / 1024, 1)
    empty = counting.directory_statistics(rows.limit(0), 10).first()
    assert (empty.total_files, empty.total_size_gb, empty.estimated_subdirs) == (0, 0.0, 0)


# -- counting and reports ----------------------------------------------------------------


def test_examples(spark):
    rows = manifest(spark, [(f"d/f{i:02d}.txt", 1) for i in range(13)] + [("x.pdf", 1)])
    found = counting.type_examples(rows).collect()
    assert [r.path for r in sorted(found, key=lambda r: r["rank"]) if r.ext == "txt"] == [f"d/f{i:02d}.txt" for i in range(10)]
    assert {(r.ext, r.more) for r in found} == {("txt", 3), ("pdf", 0)}
    plan = counting.type_examples(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def lines(report, folder):
    reports.write_lines(report, str(folder))
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return "".join((folder / p).read_text() for p in parts).splitlines()


def test_type_report(spark, tmp_path):
    rows = manifest(spark, [(f"d/f{i:02d}.txt", 1) for i in range(12)] + [("v1.2/README", 1), ("b.pdf", 1), ("c.pdf", 1)])
    text = lines(reports.type_report(rows, details=True), tmp_path / "r")
    assert text[:4] == [
        "File Type Count Summary (Total: 15 files)", "=" * 50,
        "txt             :     12 files ( 80.0%)", "    └── d/f00.txt",
    ]
    assert text[13:15] == ["    └── ... and 2 more", ""]
    assert text[15:] == [
        "pdf             :      2 files ( 13.3%)", "    └── b.pdf", "    └── c.pdf", "",
        "(no extension)  :      1 files (  6.7%)", "    └── v1.2/README", "",
    ]
    assert len(lines(reports.type_report(rows), tmp_path / "s")) == 5
    empty = lines(reports.type_report(rows.limit(0)), tmp_path / "e")
    assert empty == ["No files found in the directory."]


def test_duplicate_report(spark, tmp_path):
    rows = [("b", MIB, "h2"), ("a", MIB, "h2"), ("c", 3 * MIB, "h1"), ("dd", 3 * MIB, "h1"), ("e", 1, "h3")]
    df = spark.createDataFrame(rows, "path string, size long, hash string")
    text = lines(reports.duplicate_report(df, "2024-01-01 00:00:00"), tmp_path / "r")
    assert text[2:7] == [
        "Generated: 2024-01-01 00:00:00", "Total files scanned: 5", "Duplicate sets found: 2",
        "Duplicate files to remove: 2", "Space to be saved: 0.00 GB",
    ]
    assert text[8:] == [
        "Duplicate Set #1", "Hash: h1", "Files (2):", "  - c (3.0 MB)", "  - dd (3.0 MB)", "",
        "Duplicate Set #2", "Hash: h2", "Files (2):", "  - a (1.0 MB)", "  - b (1.0 MB)", "",
    ]


def test_tag_dump(spark, tmp_path):
    files = spark.createDataFrame(
        [("p/b.jpg", "b.jpg", None), ("p/a.jpg", "a.jpg", None), ("p/c.jpg", "c.jpg", "broken")],
        "path string, name string, tag_error string",
    )
    text = lines(reports.tag_dump(files, tags(spark, [("p/b.jpg", 0, "Make", "X"), ("p/b.jpg", 1, "Model", "Y")])), tmp_path / "r")
    assert text == [
        "==========", "a.jpg", "No EXIF data found.", "==========", "b.jpg", "Make: X", "Model: Y",
        "Error reading EXIF from p/c.jpg: broken",
    ]


def test_summary(spark):
    plan = organize_by_extension(manifest(spark, [("a.py", 1)]), ["py"], "/out")
    assert reports.summary_lines(plan)[:2] == ["Total files processed: 1", "Files moved: 1"]


# -- carrying plans out ------------------------------------------------------------------


def test_remove_duplicates_on_disk(spark, tmp_path):
    root = make(tmp_path, {"keep.txt": "same", "subdir/remove.txt": "same", "other.txt": "four", "e1": "", "e2": ""})
    plan = dedupe_files(tree.scan_files(spark, root))
    assert plan.count() == 5
    status = apply.apply_plan(plan)
    assert {r.path.removeprefix(root + "/") for r in status.filter("status = 'done'").collect()} == {"subdir/remove.txt", "e2"}
    assert rels(tree.scan_files(spark, root)) == ["e1", "keep.txt", "other.txt"]


def test_every_digest(spark, tmp_path):
    root = make(tmp_path, {"a": "1", "b": "22"})
    plan = dedupe_files(tree.scan_files(spark, root), every_digest=True)
    assert plan.filter("group_key is not null").count() == 2


def test_moves_can_be_repeated(spark, tmp_path):
    root = make(tmp_path / "in", {"deep/x.py": "1", "deep/er/x.py": "2", "keep.txt": "3", "empty/.gone": ""})
    os.unlink(f"{root}/empty/.gone")
    entries = tree.scan_entries(spark, root)
    plan = organize_by_extension(entries.filter("kind = 'file'"), ["py", "rs"], str(tmp_path / "out"))
    assert apply.make_directories(output_directories(entries, ["py", "rs"], str(tmp_path / "out"))) == 2
    assert {r.status for r in apply.apply_plan(plan).collect()} == {"done"}
    assert {r.status for r in apply.apply_plan(plan).collect()} == {"already_done"}
    assert sorted(os.listdir(tmp_path / "out" / "py_files")) == ["x.py", "x_1.py"]
    assert os.listdir(tmp_path / "out" / "rs_files") == []

    listed = tree.scan_entries(spark, root)
    empty = emptiness.left_empty(
        tree.directories(listed).withColumnRenamed("rel_path", "dir"), listed.filter("kind <> 'dir'")
    )
    assert sorted(r.dir for r in empty.collect()) == ["deep", "deep/er", "empty"]
    gone = apply.remove_directories(empty.select(F.concat(F.lit(root + "/"), "dir").alias("path")))
    assert {r.status for r in gone.collect()} == {"done"}
    assert os.listdir(root) == ["keep.txt"]


def test_copy_and_failures(spark, tmp_path):
    root = make(tmp_path, {"a.txt": "abc", "taken.txt": "other"})
    rows = [
        (f"{root}/a.txt", "copy", f"{root}/to/a.txt", 3),
        (f"{root}/a.txt", "move", f"{root}/taken.txt", 3),
        (f"{root}/none.txt", "move", f"{root}/x.txt", 3),
        (f"{root}/a.txt", "keep", None, 3),
    ]
    plan = spark.createDataFrame(rows, "path string, action string, target string, size long")
    found = {(r.action, r.target): r.status for r in apply.apply_plan(plan).collect()}
    assert found == {
        ("copy", f"{root}/to/a.txt"): "done",
        ("move", f"{root}/taken.txt"): "failed",
        ("move", f"{root}/x.txt"): "failed",
        ("keep", None): "nothing_to_do",
    }
    assert (tmp_path / "taken.txt").read_text() == "other" and (tmp_path / "a.txt").exists()


def test_curate_places_every_file_once(spark):
    names = ["a.jpg", "b.jpg", "c.tmp", "dup/c2.tmp", "song.mp3", "clip.mp4", "text.txt"]
    rows = manifest(spark, [(n, 1) for n in names])
    digest = F.when(F.col("name").startswith("c"), F.lit("same")).otherwise(F.col("name"))
    rows = rows.withColumn("hash", F.when(F.col("name") == "clip.mp4", "clip").otherwise(digest))
    rows = rows.withColumn("probe", F.lit("{}")).withColumn("tags", F.lit(None).cast("map<string,array<string>>"))
    plan = curate(rows, "/o", ["tmp"], "/junk", tags(spark, [("a.jpg", 0, "DateTime", "2023:12:25 14:30:22")]))
    assert actions(plan) == {
        "a.jpg": ("move", "/o/2023/12-December/20231225_143022_a.jpg"),
        "b.jpg": ("skip", None),
        "c.tmp": ("move", "/junk/tmp_files/c.tmp"),
        "dup/c2.tmp": ("remove", None),
        "song.mp3": ("move", "/o/Unknown Artist/Unknown Album/song.mp3"),
        "clip.mp4": ("move", "/o/2022/03-March/20220304_050607_clip.mp4"),
        "text.txt": ("keep", None),
    }
    assert plan.count() == len(names)


def test_flat_scan_filters(spark):
    rows = manifest(spark, [("a", 1), ("b", 0), ("d/c", 2)])
    assert [r.path for r in filters.non_empty(filters.at_depth(rows, 1)).collect()] == ["a"]
