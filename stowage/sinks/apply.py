"""Carry out a plan on a file system that all executors mount.

A task may run twice, also while its first attempt still runs somewhere.  So the plan is written first (the
intents, each with a token), and every step can be repeated:

1. A file gets its target name by a link, which fails where a name is taken and never replaces anything.  Across
   devices, a copy is made beside the target first, under a name of its attempt, and that is linked.
2. Only then the source goes, and last the copy's first name.

An attempt that finds the target taken looks whether it is the same file as the source, or as a copy under the
intent's token: then an earlier attempt was lost after its link, and this one goes on from there.  A row whose work
is found done reports ``already_done``; a target that has appeared meanwhile makes the row ``failed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.names import path_decoder
from stowage.operators.scratch import save

STATUS = "path string, action string, target string, size long, status string, error string"
_INTENT = ("path", "action", "target", "size", "hash")


def _worker(algorithm: str = "sha256"):
    """Built as a closure so that it travels to executors without the package."""
    decode = path_decoder()

    def same(one, two):
        import os

        try:
            return os.path.samestat(os.lstat(one), os.lstat(two))
        except FileNotFoundError:
            return False

    def copies(target, token):
        """Copies that attempts of this intent have made beside the target."""
        import glob
        import os

        return glob.glob(os.path.join(glob.escape(os.path.dirname(target)), f".stowage-{token}-*.part"))

    def clear(paths):
        import contextlib
        import os

        for path in paths:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)

    def link(source, target):
        """Give ``source`` the name ``target`` as well, if that is free."""
        import errno
        import os

        try:
            os.link(source, target, follow_symlinks=False)
        except OSError as error:
            if error.errno not in (errno.EPERM, errno.EOPNOTSUPP, errno.ENOSYS, errno.EMLINK):
                raise
            # no links here: take the name with an empty file, then put the file in its place
            os.close(os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            os.replace(source, target)

    def content(path):
        import hashlib

        with open(path, "rb") as stream:
            return hashlib.file_digest(stream, algorithm).hexdigest()

    def place(source, target, token, keep_source):
        import errno
        import os
        import shutil
        import uuid

        os.makedirs(os.path.dirname(target), exist_ok=True)
        if not keep_source:
            try:
                link(source, target)
                clear([source])
                return
            except OSError as error:
                if error.errno != errno.EXDEV:
                    raise
        part = os.path.join(os.path.dirname(target), f".stowage-{token}-{uuid.uuid4().hex}.part")
        try:
            shutil.copy2(source, part, follow_symlinks=False)
            link(part, target)
        except BaseException as error:
            if isinstance(error, Exception):
                clear([part])
            raise
        finish(source, target, token, keep_source)

    def finish(source, target, token, keep_source):
        """What is left to do once the target is in place: the source, then the copies."""
        if not keep_source:
            clear([source])
        clear(copies(target, token))

    def found(source, target, token, size, digest, keep_source):
        """The target is taken: by an earlier attempt of this intent, or by something else."""
        import os

        there = os.path.lexists(source)
        if there and not keep_source and same(source, target):
            clear([source])  # lost between link and unlink
            return "done"
        if any(same(part, target) for part in copies(target, token)):
            finish(source, target, token, keep_source)
            return "done"
        if os.path.isfile(target) and os.path.getsize(target) == size:
            if not there and not keep_source:
                return "already_done"
            if keep_source and content(target) == (digest or content(source)):
                return "already_done"
        raise FileExistsError(f"target exists: {target}")

    def act(path, action, target, size, digest, token):
        import os

        if action == "remove":
            try:
                os.unlink(path)
            except FileNotFoundError:
                return "already_done"
            return "done"
        if action not in ("move", "copy"):
            return "nothing_to_do"
        if os.path.isdir(path) and not os.path.islink(path):
            raise IsADirectoryError(f"no file: {path}")
        keep_source = action == "copy"
        if not os.path.lexists(target):
            try:
                place(path, target, token, keep_source)
                return "done"
            except FileExistsError:
                pass  # it has appeared in between
        return found(path, target, token, size, digest, keep_source)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    target = decode(row.target)
                    status, error = act(decode(row.path), row.action, target, row.size, row.hash, row.token), None
                except (OSError, ValueError) as problem:
                    status, error = "failed", str(problem).encode("utf-8", "backslashreplace").decode()
                rows.append((row.path, row.action, row.target, row.size, status, error))
            yield pd.DataFrame(rows, columns=["path", "action", "target", "size", "status", "error"])

    return run


def _check_session(df: DataFrame) -> None:
    conf = df.sparkSession.sparkContext.getConf()
    if conf.get("spark.speculation", "false").lower() == "true":
        raise RuntimeError("turn spark.speculation off: two attempts must not touch one file at once")


def _intents(plan: DataFrame) -> DataFrame:
    """The rows to carry out; a row's token names it in every run of the same plan."""
    if "hash" not in plan.columns:
        plan = plan.withColumn("hash", F.lit(None).cast("string"))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("path", "action", "target")]
    token = F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 24).alias("token")
    return plan.select(*_INTENT, token)


def _carried_out(intents: DataFrame, algorithm: str) -> DataFrame:
    tasks = int(intents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return intents.repartition(tasks, "path").mapInPandas(_worker(algorithm), STATUS)


def apply_plan(plan: DataFrame, journal: str | None = None, algorithm: str = "sha256") -> DataFrame:
    """Run the plan once and return one status row per plan row.

    ``journal`` is a new folder that keeps the intents and the statuses; after a lost application, ``resume``
    goes on with them.  A column ``hash`` of the plan (by ``algorithm``) saves a repeated copy the digest of its source.
    """
    _check_session(plan)
    if journal is None:
        return save(_carried_out(save(_intents(plan), "plan"), algorithm), "status")
    _intents(plan).withColumn("algorithm", F.lit(algorithm)).write.parquet(f"{journal}/intents")
    return resume(plan.sparkSession, journal)


def resume(spark: SparkSession, journal: str) -> DataFrame:
    """Carry out the intents of a journal, whatever has been done of them; what was done is found done."""
    intents = spark.read.parquet(f"{journal}/intents")
    _check_session(intents)
    first = intents.select("algorithm").first()
    algorithm = first.algorithm if first else "sha256"
    _carried_out(intents.drop("algorithm"), algorithm).write.mode("overwrite").parquet(f"{journal}/status")
    return spark.read.parquet(f"{journal}/status")


def make_directories(directories: DataFrame) -> int:
    """Create every directory of the single-column input; returns how many there are."""
    decode = path_decoder()

    def make(batches):
        import os

        for batch in batches:
            for path in batch["directory"]:
                os.makedirs(decode(path), exist_ok=True)
            yield batch

    only = directories.select("directory").distinct()
    return save(only.mapInPandas(make, "directory string"), "made").count()


def remove_directories(directories: DataFrame) -> DataFrame:
    """Remove directories (``path``) that are empty, deepest first, one job per level."""
    _check_session(directories)
    decode = path_decoder()

    def remove(batches):
        import os

        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    os.rmdir(decode(path))
                    rows.append((path, "done", None))
                except FileNotFoundError:
                    rows.append((path, "already_done", None))
                except OSError as problem:
                    rows.append((path, "failed", str(problem)))
            yield pd.DataFrame(rows, columns=["path", "status", "error"])

    level = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    listed = save(directories.select("path", level.alias("level")).distinct(), "empty")
    deepest = listed.agg(F.max("level"), F.min("level")).first()
    done = listed.sparkSession.createDataFrame([], "path string, status string, error string")
    if deepest[0] is None:
        return done
    for depth in range(deepest[0], deepest[1] - 1, -1):
        paths = listed.filter(F.col("level") == depth).select("path")
        done = done.unionByName(save(paths.mapInPandas(remove, done.schema), "removed"))
    return done
