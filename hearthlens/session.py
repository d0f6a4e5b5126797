"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "hearthlens", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings the library is written for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the master then comes from
    spark-submit, and adaptive execution sizes the shuffles from a high initial partition count.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")  # readers and writers of GBK files
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4000")
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def allow_any_charset(spark: SparkSession) -> None:
    """Lets the session read and write character sets outside Spark's short list, as GBK, whoever built it. The setting stays,
    since a scan looks at it again when it runs."""
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, since a machine-local folder would not survive or be seen elsewhere.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"hearthlens-{spark.sparkContext.applicationId}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def working_folders(spark: SparkSession) -> Iterator[None]:
    """Removes what was written to fresh paths within the block, once nothing reads it any more: use the rows of a query
    inside the block."""
    before = len(_MADE)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _MADE[before:]:
            path = hadoop.Path(name)
            path.getFileSystem(conf).delete(path, True)
        del _MADE[before:]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the Python workers once per application, so that they need no checkout."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="hearthlens-"), "hearthlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
