"""Tables made of immutable folders, and the log that says which are in force.

<path>/data/<name>/ is written once and never changed. Each row of <path>/log adds or removes a
folder, and the rows of one change stand in one file, so a change is there as a whole or not at
all. A folder is in force if it was added and not removed: writers that run side by side add their
own, and one that replaces folders names exactly those it has read.

A log that has grown is folded: one more file repeats what the others come to and names them. Those
files stay until the next fold, so a reader that has listed them still finds them.
"""

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Log files from which on a change folds the log.
LOG_FILES = 32
# ``covers`` names a file that the rows beside it stand for.
_LOG = "folder string, added boolean, covers string"


def new_folder(path):
    """A folder of its own for a write; later ones sort behind earlier ones."""
    return f"{path}/data/{time.time_ns():020d}-{uuid.uuid4().hex}"


def batch_folder(path, name):
    """The folder of a named batch: a replay of the batch has the same."""
    return f"{path}/data/batch-{name}"


def put_in_force(spark: SparkSession, path, add=(), remove=()):
    """Log one change; its rows are few: a row for each folder."""
    _write_log(spark, path, [(f.rsplit("/", 1)[1], True, None) for f in add] + [(f.rsplit("/", 1)[1], False, None) for f in remove])
    if len(_files(spark, f"{path}/log")) > 2 * LOG_FILES:
        fold_log(spark, path)


def _write_log(spark, path, rows):
    names = ("folder", "added", "covers")
    types = ("string", "boolean", "string")
    structs = [F.struct(*(F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types, strict=True))) for r in rows]
    spark.range(1).coalesce(1).select(F.inline(F.array(*structs))).write.mode("append").parquet(f"{path}/log")


def _logged(spark, path):
    """(file, folder, added, covers) rows: those of the last folds and of the changes since."""
    try:
        # a file that goes while the log is read is repeated by one that is there
        log = spark.read.schema(_LOG).option("ignoreMissingFiles", "true").parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return log.select(F.col("_metadata.file_name").alias("file"), "*").collect()


def _states(rows) -> dict:
    """Whether each folder that was added is in force."""
    states = {}
    for r in rows:
        if r["folder"] is not None:
            states.setdefault(r["folder"], set()).add(r["added"])
    return {folder: states[folder] == {True} for folder in states if True in states[folder]}


def current(spark: SparkSession, path) -> list:
    """The folders in force, oldest first."""
    return sorted(f"{path}/data/{folder}" for folder, in_force in _states(_logged(spark, path)).items() if in_force)


def is_logged(spark: SparkSession, path, folder) -> bool:
    """Whether a folder was ever put in force, as far back as the log goes."""
    return folder.rsplit("/", 1)[1] in _states(_logged(spark, path))


def fold_log(spark: SparkSession, path):
    """Repeat the state of the log in one file, and delete what the fold before has repeated.

    A folder that has gone is named as long as a file that added it may be read. One fold at a time.
    """
    rows = _logged(spark, path)
    covered = {r["covers"] for r in rows if r["covers"] is not None}
    for name in covered:
        delete(spark, f"{path}/log/{name}")
    rows = [r for r in rows if r["file"] not in covered]
    files = sorted({r["file"] for r in rows})
    _write_log(spark, path, [(f, s, None) for f, s in sorted(_states(rows).items())] + [(None, None, f) for f in files])


def remove_obsolete(spark: SparkSession, path):
    """Delete the folders that were replaced; readers that started before must have ended."""
    for folder, in_force in _states(_logged(spark, path)).items():
        if not in_force:
            delete(spark, f"{path}/data/{folder}")


def _store(spark, folder):
    """The store that holds a folder, and the folder's place there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _files(spark, folder):
    store, place = _store(spark, folder)
    return [f.getPath().getName() for f in store.listStatus(place) if f.getPath().getName().endswith(".parquet")]


def delete(spark: SparkSession, folder):
    """Delete a folder or file in whatever store it lies."""
    store, place = _store(spark, folder)
    store.delete(place, True)


def exists(spark: SparkSession, folder) -> bool:
    store, place = _store(spark, folder)
    return store.exists(place)
