"""Directory trees, listed by descents of bounded work on the executors.

Built-in file sources skip empty files and names that start with '.' or '_', so the
listing is done here.  A task goes down from the directories it is given until it has listed ``DESCENT`` of
them, and gives back those it has only seen; the next job deals these to as many tasks as they need.  So
a deep tree takes few jobs and a broad one many tasks, and nothing is listed on the driver.
The tree must be mounted at the same place on all executors.  Names that are not UTF-8 are
escaped (``names.path_decoder``) and listed like all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.names import is_hidden, path_decoder, path_encoder
from stowage.operators.scratch import save
from stowage.schema import MANIFEST

#: Directories a task lists before it gives back what is left.
DESCENT = 1000

_CHUNK = 1000
_LISTED = T.StructType([*MANIFEST.fields, T.StructField("todo", T.BooleanType())])


def _lister(descent: int, include_hidden: bool):
    """Built as a closure so that it travels to executors without the package."""
    columns = _LISTED.fieldNames()
    decode, encode = path_decoder(), path_encoder()

    def entry_row(root, rel_dir, depth, entry):
        import datetime

        name = encode(entry.name)
        row = dict(
            path=encode(entry.path), root=root, rel_path=f"{rel_dir}/{name}" if rel_dir else name,
            dir=rel_dir, name=name, kind="other", size=0, mtime=None, depth=depth, read_error=None, todo=False,
        )
        try:
            if entry.is_dir(follow_symlinks=False):
                row["kind"] = "dir"
            elif entry.is_dir():
                row["kind"] = "link"
            elif entry.is_file():
                row["kind"] = "file"
                if name != entry.name:
                    row |= {"kind": "unreadable", "read_error": "name is not UTF-8"}
                stat = entry.stat()
                row["size"] = stat.st_size
                row["mtime"] = datetime.datetime.fromtimestamp(stat.st_mtime, datetime.UTC)
        except OSError as error:
            row["read_error"] = str(error)
        return row

    def listed(root, path, rel_dir, depth):
        """Rows of the entries of one directory."""
        import os

        try:
            with os.scandir(decode(path)) as entries:
                for entry in entries:
                    yield entry_row(root, rel_dir, depth + 1, entry)
        except OSError as error:
            yield dict(
                path=path, root=root, rel_path=rel_dir, dir=rel_dir, name=os.path.basename(path),
                kind="unreadable", size=None, mtime=None, depth=depth, read_error=str(error), todo=False,
            )

    def list_directories(batches):
        import collections

        import pandas as pd

        def frame(rows):
            return pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

        rows = []
        queue = collections.deque()
        left = descent
        for batch in batches:
            given = zip(batch["root"], batch["path"], batch["rel_path"], batch["depth"].astype(int))
            for start in given:
                queue.append(start)
                while queue:
                    root, path, rel_dir, depth = queue.popleft()
                    left -= 1
                    for row in listed(root, path, rel_dir, depth):
                        if row["kind"] == "dir" and (include_hidden or not row["name"].startswith(".")):
                            # what is in the queue is listed here, all else by another task
                            if left > len(queue):
                                queue.append((root, row["path"], row["rel_path"], depth + 1))
                            else:
                                row["todo"] = True
                        rows.append(row)
                        if len(rows) == _CHUNK:
                            yield frame(rows)
                            rows = []
        if rows:
            yield frame(rows)

    return list_directories


def _check_roots(roots: Sequence[str]) -> None:
    import os

    for root in roots:
        if not os.path.exists(root):
            raise FileNotFoundError(f"there is no folder {root}")
        if not os.path.isdir(root):
            raise NotADirectoryError(f"{root} is a file, not a folder")


def scan_entries(
    spark: SparkSession,
    *roots: str,
    include_hidden: bool = True,
    recursive: bool = True,
) -> DataFrame:
    """All entries below the roots: files, directories, links to directories, others.

    With ``include_hidden=False`` hidden directories are not even listed.  A file whose name is not UTF-8
    has the kind ``unreadable`` and its size and time; a directory that can't be listed has a row of
    that kind without a size, next to its own.
    """
    encode = path_encoder()
    roots = [r.rstrip("/") or "/" for r in roots]
    _check_roots(roots)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame(
        [(encode(r), encode(r), "", 0) for r in roots], "root string, path string, rel_path string, depth int"
    )
    descent = DESCENT if recursive else 0
    rounds: list[DataFrame] = []
    waiting = len(roots)
    while True:
        tasks = max(usual, waiting // max(descent, 1) + 1)
        spread = frontier.repartition(tasks, "path") if rounds else frontier
        found = save(spread.mapInPandas(_lister(descent, include_hidden), _LISTED), "listed")
        rounds.append(found)
        frontier = found.filter("todo").select("root", "path", "rel_path", "depth")
        waiting = frontier.count() if recursive else 0
        if not waiting:
            break
    entries = rounds[0]
    for found in rounds[1:]:
        entries = entries.unionByName(found)
    entries = entries.drop("todo")
    return entries if include_hidden else entries.filter(~is_hidden(F.col("rel_path")))


def scan_files(spark: SparkSession, *roots: str, **options: bool) -> DataFrame:
    """Regular files (and links to them).  Several roots are one collection.

    A directory that can't be listed is a row too (kind ``unreadable``, no size), which a plan by content
    makes an error.
    """
    return scan_entries(spark, *roots, **options).filter("kind in ('file', 'unreadable')")


def scan_countable(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """What a type count sees: files plus broken links and special files.

    Directories that can't be listed are no files; ``scan_entries`` has them.
    """
    entries = scan_entries(spark, root, include_hidden=include_hidden)
    return entries.filter("kind in ('file', 'other') or (kind = 'unreadable' and size is not null)")


def directories(entries: DataFrame) -> DataFrame:
    return entries.filter("kind = 'dir'").select("root", "path", "rel_path", "depth")
