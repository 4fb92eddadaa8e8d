"""Session settings and the shared work folder."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_folder = None


def local_session(cores="*", **conf):
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bookmark_lake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark, label):
    """A fresh folder under the shared ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only on one machine, where neither is named, is a temporary one made.
    """
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="bookmark-lake-")
        root = _own_folder
    return f"{root.rstrip('/')}/bookmark_lake/{label}-{uuid.uuid4().hex}"
