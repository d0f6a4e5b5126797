"""What the operators share: worker code, working tables and free column names."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hearthlens.session import shared_folder, ship  # noqa: F401

_TABLES: dict[tuple[str, str], object] = {}


def worker_table(task: str, name: str, make: Callable[[], object]) -> object:
    """A table that a worker process keeps between the tasks of one kind, made at its first use."""
    if (task, name) not in _TABLES:
        _TABLES[(task, name)] = make()
    return _TABLES[(task, name)]


def _given_back() -> None:
    """Memory that Python and Arrow have freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def worker_task(task: str) -> Callable:
    """For functions of batches: a worker that turns to another kind of task drops the tables of the last one, and
    gives freed memory back after each task. Workers live on from stage to stage, so tables would add up."""

    def wrap(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @functools.wraps(run)
        def tidy(batches: Iterator) -> Iterator:
            for other in [key for key in _TABLES if key[0] != task]:
                del _TABLES[other]
            pa.default_memory_pool().release_unused()
            pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what has been freed
            try:
                for batch in run(batches):
                    yield batch
                    del batch
            finally:
                _given_back()

        return tidy

    return wrap


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder, with a short lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def emptied(spark: SparkSession, path: str) -> None:
    """Removes the files of a working folder that nothing reads any more."""
    spark.range(0).selectExpr("cast(id as string) as value").coalesce(1).write.mode("overwrite").text(path)
