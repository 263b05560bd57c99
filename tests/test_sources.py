import hashlib
import json
import os
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import projections
from stowage.operators import counting, filters
from stowage.plans.dedupe import dedupe_files
from stowage.operators import scratch
from stowage.operators.scan import scan
from stowage.sinks import apply
from stowage.sinks import digests as digest_sink
from stowage.sources import digests, jsonblocks, tree


def make(root, files):
    for rel, content in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(root)


def rels(df):
    return sorted(r.rel_path for r in df.select("rel_path").collect())


def hash_count(df):
    return digests.hash_files(df).select("hash").distinct().count()


def test_recursive_and_flat(spark, tmp_path):
    root = make(tmp_path, {"file1.txt": "1", "file2.jpg": "2", "subdir/file3.pdf": "3"})
    found = tree.scan_files(spark, root)
    assert found.count() == 3 and hash_count(found) == 3
    assert rels(tree.scan_files(spark, root, recursive=False)) == ["file1.txt", "file2.jpg"]
    assert rels(filters.at_depth(found, 2)) == ["subdir/file3.pdf"]
    row = found.filter("name = 'file3.pdf'").first()
    assert (row.dir, row.size, row.depth, row.path) == ("subdir", 1, 2, f"{root}/subdir/file3.pdf")
    assert abs(row.mtime.timestamp() - os.stat(row.path).st_mtime) < 1e-3


def test_several_roots_are_one_collection(spark, tmp_path):
    a, b = make(tmp_path / "a", {"x": "1"}), make(tmp_path / "b", {"x": "1"})
    assert tree.scan_files(spark, a, b).count() == 2


def test_hidden_empty_and_underscore_files_are_listed(spark, tmp_path):
    root = make(tmp_path, {".h": "", "_u": "", "d/.x/y": "1", "sp ace%20.JPG": "1", "é": "2"})
    assert rels(tree.scan_files(spark, root)) == sorted([".h", "_u", "d/.x/y", "sp ace%20.JPG", "é"])
    assert rels(tree.scan_files(spark, root, include_hidden=False)) == sorted(["_u", "sp ace%20.JPG", "é"])


def test_links(spark, tmp_path):
    root = make(tmp_path / "r", {"real/f.txt": "abc"})
    os.symlink(f"{root}/real", f"{root}/dirlink")
    os.symlink(f"{root}/real/f.txt", f"{root}/filelink.txt")
    os.symlink(f"{root}/gone", f"{root}/broken.txt")
    entries = {r.rel_path: (r.kind, r.size) for r in tree.scan_entries(spark, root).collect()}
    assert entries["dirlink"][0] == "link" and entries["broken.txt"][0] == "other"
    assert entries["filelink.txt"] == ("file", 3) and "dirlink/f.txt" not in entries
    assert rels(tree.scan_files(spark, root)) == ["filelink.txt", "real/f.txt"]
    assert tree.scan_countable(spark, root).count() == 3


def test_names_that_are_no_text(spark, tmp_path):
    root = make(tmp_path, {"ok": "1"})
    open(os.fsencode(root) + b"/bad\xff.txt", "w").close()
    kinds = {r.kind: r.read_error for r in tree.scan_entries(spark, root).collect()}
    assert set(kinds) == {"file", "unreadable"} and "UTF-8" in kinds["unreadable"]


def test_files_and_trees_below_names_that_are_no_text(spark, tmp_path):
    root = make(tmp_path, {"ok.txt": "same", "b\udce9.jpg": "same", "d\udcff/e/f.txt": "more", "d\udcff/g\udcfe": ""})
    make(tmp_path, {"b%E9.jpg": "else", ".h\udcff/x": "1"})
    found = {r.rel_path: (r.name, r.dir, r.size, r.depth) for r in tree.scan_files(spark, root, include_hidden=False).collect()}
    assert found == {
        "ok.txt": ("ok.txt", "", 4, 1),
        "b%E9.jpg": ("b%E9.jpg", "", 4, 1),
        "b\x00E9.jpg": ("b\x00E9.jpg", "", 4, 1),
        "d\x00FF/e/f.txt": ("f.txt", "d\x00FF/e", 4, 3),
        "d\x00FF/g\x00FE": ("g\x00FE", "d\x00FF", 0, 2),
    }
    assert rels(tree.scan_countable(spark, root)) == sorted(found)
    plan = dedupe_files(tree.scan_files(spark, root, include_hidden=False))
    removed = [r for r in apply.apply_plan(plan).collect() if r.action == "remove"]
    assert [(r.path, r.status) for r in removed] == [(f"{root}/b\x00E9.jpg", "done")]
    assert sorted(os.listdir(root)) == sorted(["ok.txt", "b%E9.jpg", "d\udcff", ".h\udcff"])


def test_directories_that_cannot_be_listed(spark, tmp_path, monkeypatch):
    root = make(tmp_path, {"empty.txt": "", "gone/x": ""})
    whole = tree.save

    def save(df, label):
        saved = whole(df, label)
        if os.path.exists(f"{root}/gone"):
            os.rename(f"{root}/gone", tmp_path.parent / f"{tmp_path.name}-elsewhere")
        return saved

    monkeypatch.setattr(tree, "save", save)
    monkeypatch.setattr(tree, "DESCENT", 1)
    files = tree.scan_files(spark, root)
    rows = {r.rel_path: (r.kind, r.size, r.read_error is None) for r in files.collect()}
    assert rows == {"empty.txt": ("file", 0, True), "gone": ("unreadable", None, False)}
    actions = {r.path: r.action for r in dedupe_files(files).collect()}
    assert actions == {f"{root}/empty.txt": "keep", f"{root}/gone": "error"}


def listed_paths(root):
    found = []
    for folder, folders, files in os.walk(root):
        found += [os.path.relpath(os.path.join(folder, n), root) for n in folders + files]
    return sorted(found)


def test_a_deep_chain_takes_few_jobs(spark, tmp_path, monkeypatch):
    root = tmp_path / "c"
    root.mkdir()
    here = os.getcwd()
    os.chdir(root)
    try:
        for i in range(1500):  # the path is longer than one call may name, its steps are not
            os.mkdir("d")
            os.chdir("d")
            if i % 500 == 0:
                open("f", "w").close()
    finally:
        os.chdir(here)
    saved = []
    monkeypatch.setattr(tree, "save", lambda df, label: saved.append(label) or scratch.save(df, label))
    entries = tree.scan_entries(spark, str(root))
    assert entries.count() == 1503 and len(saved) <= 3
    assert tree.scan_files(spark, str(root)).count() == 3


@pytest.mark.parametrize("descent", [1, 7, 1000])
def test_descents_list_everything_once(spark, tmp_path, monkeypatch, descent):
    for i in range(40):
        folder = tmp_path / f"a{i % 5}" / f"b{i % 7}" / (f".h{i}" if i % 9 == 0 else f"c{i}")
        folder.mkdir(parents=True)
        (folder / "f.txt").write_text("x")
    monkeypatch.setattr(tree, "DESCENT", descent)
    entries = tree.scan_entries(spark, str(tmp_path))
    assert entries.columns == tree.MANIFEST.fieldNames()
    assert sorted(r.rel_path for r in entries.collect()) == listed_paths(tmp_path)
    shown = tree.scan_entries(spark, str(tmp_path), include_hidden=False)
    visible = [p for p in listed_paths(tmp_path) if "/." not in p]
    assert sorted(r.rel_path for r in shown.collect()) == visible


def test_hashing_is_dealt_by_bytes_and_files(spark, monkeypatch):
    monkeypatch.setattr(digests, "OPEN_BYTES", 10)
    monkeypatch.setattr(digests, "TASK_BYTES", 500)
    rows = [(f"p{i:05d}", 0) for i in range(2000)] + [(f"q{i}", 400) for i in range(20)] + [("r", None), ("s", 9000)]
    dealt = digests.balanced(spark.createDataFrame(rows, "path string, size long"))
    tasks = {}
    for r in dealt.withColumn("task", F.spark_partition_id()).collect():
        tasks.setdefault(r.task, []).append((r.size or 0) + 10)
    assert sum(len(t) for t in tasks.values()) == len(rows)
    assert all(sum(t) - max(t) <= 500 for t in tasks.values()) and len(tasks) >= 56


def test_tasks_hold_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    """Listing gives rows in small frames, costs are summed over short ranges, texts are written one by one."""
    root = make(tmp_path / "r", {f"f{i}": "" for i in range(2500)})
    start = pd.DataFrame({"root": [root], "path": [root], "rel_path": [""], "depth": [0]})
    frames = [len(frame) for frame in tree._lister(10, True)(iter([start]))]
    assert sum(frames) == 2500 and max(frames) <= 1000

    ranges = []
    monkeypatch.setattr(digests, "scan", lambda *a: ranges.append(a[4]) or scan(*a))
    files = spark.createDataFrame([(f"/f{i}", i) for i in range(100)], "path string, size long")
    assert digests.balanced(files).count() == 100 and ranges == [25_000]

    def texts():
        for i in range(3):
            yield f"d/{i}", str(i)
            assert (tmp_path / "out" / "d" / str(i)).read_text() == str(i)

    projections._file_writer(str(tmp_path / "out"))(texts())


def test_sketches_of_scans_are_merged(spark, tmp_path):
    rows = [(f"{i % 3000:064x}", f"/p/{i}") for i in range(5000)] + [(None, "/broken")]
    df = spark.createDataFrame(rows, "hash string, path string")
    first, second = df.filter("path < '/p/3'"), df.filter("path >= '/p/3' or path = '/broken'")
    digest_sink.save_digests(first, str(tmp_path / "a"), "sha256", "t", sketch=True)
    digest_sink.save_digests(second, str(tmp_path / "b"), "sha256", "t", sketch=True)
    found = digests.approximate_unique(digests.load_sketches(spark, str(tmp_path / "a"), str(tmp_path / "b"))).first()
    assert found.files == 5000
    assert abs(found.unique_hashes - 3000) <= digest_sink.RELATIVE_ERROR * 3000
    assert digests.load_digests(spark, str(tmp_path / "a")).count() == first.filter("hash is not null").count()
    nothing = digests.approximate_unique(digest_sink.sketch_of(df.limit(0))).first()
    assert tuple(nothing) == (0, 0)


def test_missing_roots(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tree.scan_files(spark, str(tmp_path / "none"))
    make(tmp_path, {"f": "1"})
    with pytest.raises(NotADirectoryError):
        tree.scan_files(spark, str(tmp_path / "f"))


def test_empty_root(spark, tmp_path):
    assert tree.scan_files(spark, str(tmp_path)).count() == 0


def test_type_counts(spark, tmp_path):
    files = ["a.TXT", "b.txt", "c.tar.gz", "README", ".bashrc", ".git/config", "sub/.x/y.md"]
    root = make(tmp_path, {f: "" for f in files})
    counts = lambda hidden: {
        r.ext: r.n for r in counting.type_counts(tree.scan_countable(spark, root, hidden)).collect()
    }
    assert counts(False) == {"txt": 2, "gz": 1, "no_extension": 1}
    assert counts(True) == {"txt": 2, "gz": 1, "no_extension": 3, "md": 1}


@pytest.mark.parametrize(
    "names, include, exclude, left",
    [
        (["photo1.jpg", "photo2.png", "document.pdf", "text.txt"], ["*.jpg", "*.png"], None, 2),
        (["photo1.jpg", "photo2.png", "document.pdf", "backup.bak"], None, ["*.bak", "*.tmp"], 3),
        (["Photo.JPG", "image.PNG", "doc.PDF"], ["*.jpg", "*.png"], [], 2),
        (["a.jpg", "b.jpg"], ["*.jpg"], ["a*"], 1),
        (["a.jpg"], [], None, 1),
    ],
)
def test_globs(spark, names, include, exclude, left):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert filters.exclude_globs(filters.include_globs(df, include), exclude).count() == left


@pytest.mark.parametrize(
    "family, inside",
    [
        ("photo", ["a.JPG", "b.Jpeg", "c.heic", "d.cr2", "e.dng", "f.tiff"]),
        ("video", ["a.MP4", "b.mkv", "c.m2ts", "d.3gp", "e.TS"]),
        ("music", ["a.mp3", "b.FLAC", "c.ape", "d.m4a"]),
    ],
)
def test_media_families(spark, family, inside):
    others = ["x.txt", "y.pdf", "noext", ".jpg"]
    df = spark.createDataFrame([(n,) for n in inside + others], "name string")
    assert sorted(r.name for r in filters.media(df, family).collect()) == sorted(inside)


def test_requested_extensions(spark, tmp_path):
    files = ["script.py", "nested/program.java", "deep/nested/header.c", "deep/nested/another.py", "i.jpg", "deep/c.ini"]
    found = tree.scan_files(spark, make(tmp_path, {f: "1" for f in files}))
    counts = {r.ext: r.n for r in counting.requested_counts(found, [".PY", "Java", "c", "rs"]).collect()}
    assert counts == {"py": 2, "java": 1, "c": 1, "rs": 0}
    assert filters.with_extensions(found, ["py", "java", "c"]).count() == 4


@pytest.mark.parametrize("algorithm", digests.ALGORITHMS)
def test_hashes(spark, tmp_path, algorithm):
    big = os.urandom(1 << 20)
    root = make(tmp_path, {"a": "Hello, World!", "big": big, "empty": ""})
    os.symlink("/nowhere", f"{root}/broken")
    rows = digests.hash_files(tree.scan_entries(spark, root), algorithm).collect()
    found = {r.name: r.hash for r in rows}
    for name, content in [("a", b"Hello, World!"), ("big", big), ("empty", b"")]:
        assert found[name] == hashlib.new(algorithm, content).hexdigest()
    assert found["broken"] is None and [r.read_error for r in rows if r.name == "broken"][0]


def test_only_shared_sizes_need_a_digest(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "path string, size long")
    for group_rows in (None, 1):
        assert sorted(r.path for r in digests.same_size_only(df, group_rows=group_rows).collect()) == ["b", "c"]


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        digests.hash_files(spark.createDataFrame([("a", 1)], "path string, size long"), "crc")


DIGESTS = [("aa01", "/x/1"), ("aa01", "/x/2"), ("bb02", '/x/qu"ote, [.txt'), ("cc03", "/x/ends],"), ("cc03", "/x/é\\b")]


def test_parquet_database(spark, tmp_path):
    df = spark.createDataFrame(DIGESTS + [(None, "/bad")], "hash string, path string")
    digest_sink.save_digests(df, str(tmp_path / "db"), "md5", "2024-01-01 00:00:00")
    rows = digests.load_digests(spark, str(tmp_path / "db")).collect()
    assert sorted((r.hash, r.path) for r in rows) == DIGESTS
    assert {(r.algorithm, r.generated) for r in rows} == {("md5", "2024-01-01 00:00:00")}


def grouped():
    out = {}
    for digest, path in DIGESTS:
        out.setdefault(digest, []).append(path)
    return out


def test_json_database_is_one_document(spark, tmp_path):
    df = spark.createDataFrame(DIGESTS, "hash string, path string").repartition(3)
    digest_sink.save_digests_json(df, str(tmp_path / "db"), "md5", "2024-01-01 00:00:00")
    parts = sorted(p for p in os.listdir(tmp_path / "db") if p.startswith("part-"))
    document = json.loads("".join((tmp_path / "db" / p).read_text() for p in parts))
    assert document["metadata"] == {"algorithm": "md5", "generated": "2024-01-01 00:00:00", "total_files": 5}
    assert document["hashes"] == grouped()
    rows, meta = digests.load_digests_json(spark, str(tmp_path / "db"))
    assert sorted((r.hash, r.path) for r in rows.collect()) == DIGESTS
    assert meta == {"algorithm": "md5", "generated": "2024-01-01 00:00:00", "total_files": "5"}


def test_json_database_split_over_tasks(spark, tmp_path):
    """A key and its paths may lie in different blocks of the file."""
    many = {f"{i:04x}": [f"/p/{i}/{j}" for j in range(1 + i % 40)] for i in range(300)}
    text = json.dumps({"metadata": {"algorithm": "sha256", "generated": "t", "total_files": 1}, "hashes": many}, indent=2)
    (tmp_path / "db.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows, _ = digests.load_digests_json(spark, str(tmp_path / "db.json"))
        found = sorted((r.hash, r.path) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == sorted((h, p) for h, paths in many.items() for p in paths)


LAYOUTS = {
    "one line": {},
    "no spaces": {"separators": (",", ":")},
    "four spaces": {"indent": 4},
    "tabs": {"indent": "\t", "separators": (" ,", "  :  ")},
    "plain text": {"ensure_ascii": False},
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("metadata_last", [False, True])
def test_json_database_in_any_layout_over_many_tasks(spark, tmp_path, layout, metadata_last):
    odd = ['a"b', "back\\slash\\", '\\"', "é ü 𝄞", 'tab\t, [x]: {"y": 1}', "", " ", 'end"', "\\\\"]
    many = {f"{i:064x}": [f"/p/{i}/{j}" for j in range(i % 9)] for i in range(150)}
    many["ab"] = [f"/odd/{i}/{name}" for i, name in enumerate(odd)] + ["/long/" + "n" * 3000]
    facts = {"algorithm": "sha256", "generated": 'now, "then"', "total_files": 12}
    members = [("metadata", facts), ("hashes", many)]
    text = json.dumps(dict(members[::-1] if metadata_last else members), **LAYOUTS[layout])
    (tmp_path / "db.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows, metadata = digests.load_digests_json(spark, str(tmp_path / "db.json"))
        found = sorted((r.hash, r.path) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == sorted((h, p) for h, paths in many.items() for p in paths)
    assert metadata == {"algorithm": "sha256", "generated": 'now, "then"', "total_files": "12"}


def test_json_blocks_are_read_piece_by_piece():
    """A block of any size is read in the memory of a batch, and a state takes few bytes."""

    def batches(state=False):
        for i in range(0, 40_000, 100):
            pieces = ["{", "hashes", ":{"] if i == 0 else []
            pieces += [x for j in range(i, i + 100) for x in (f"{j:064x}", ":[", f"/p/{j}", "],")]
            files = {"file": ["f"] * len(pieces), "block": [0] * len(pieces), "piece": pieces, "at": [i] * len(pieces)}
            start = [jsonblocks._dumps(jsonblocks.State()) if i == 0 else None] + [None] * (len(pieces) - 1)
            yield pa.record_batch({"piece": pieces, "state": pa.array(start, pa.string())} if state else files)

    next(batches())  # what pyarrow imports is not counted
    tracemalloc.start()
    (effect,) = jsonblocks._tabulate(batches())
    found = 0
    for batch in jsonblocks._read(batches(state=True)):
        found += batch.num_rows
        last = batch.to_pylist()[-1]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 4 << 20
    assert effect["first"].to_pylist() == [0] and effect.nbytes < 1500
    assert found == 40_000 and last == {"kind": "path", "key": f"{39_999:064x}", "value": "/p/39999"}


def test_json_database_without_entries(spark, tmp_path):
    (tmp_path / "db.json").write_text('{"metadata": {"algorithm": "md5"}, "hashes": {}}')
    rows, metadata = digests.load_digests_json(spark, str(tmp_path / "db.json"))
    assert rows.count() == 0 and metadata == {"algorithm": "md5"}
    (tmp_path / "other.json").write_text('{"some": ["thing"]}')
    with pytest.raises(ValueError):
        digests.load_digests_json(spark, str(tmp_path / "other.json"))


def test_files_of_unknown_size_are_planned(spark, tmp_path):
    from stowage.plans.dedupe import dedupe_files

    for name in "abc":
        (tmp_path / name).write_text("same")
    (tmp_path / "d").write_text("else")
    rows = [(str(tmp_path / n), None, None) for n in "abcd"]
    manifest = spark.createDataFrame(rows, "path string, size long, mtime timestamp")
    plan = dedupe_files(manifest)
    assert sorted(r.action for r in plan.collect()) == ["keep", "keep", "remove", "remove"]


def test_bracket_in_glob_class(spark):
    from stowage.functions.globs import matches_any

    names = spark.createDataFrame([("x1",), ("[2",), ("]3",), ("a4",)], "n string")

    def found(pattern):
        return [r.n for r in names.filter(matches_any(names.n, [pattern])).collect()]

    assert found("[x[]*") == ["x1", "[2"]
    assert found("[a-z[]?") == ["x1", "[2", "a4"]
    assert found("[]]*") == ["]3"] and found("[!]x[]*") == ["a4"]
