"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _folder_of_this_process() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ratelens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a session within one process (local mode, as in tests) gets a folder of its own; others fail, as
    no machine's folder is seen by all executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _folder_of_this_process()
    return found.rstrip("/")


#: Paths of the tables of written() that are not dropped yet, in the order in which they were made.
_kept: list[str] = []


@contextlib.contextmanager
def _shuffles_go_at_the_end(spark: SparkSession) -> Iterator[None]:
    """Executions in here delete their shuffle files when they are done, instead of when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _kept.append(path)
    with _shuffles_go_at_the_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def located(spark: SparkSession, path: str):
    """A path, and the file system that it is of."""
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _deleted(spark: SparkSession, path: str) -> None:
    where, system = located(spark, path)
    system.delete(where, True)
    _kept.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "shared_path", None)) in _kept:
            _deleted(df.sparkSession, path)


def mark() -> int:
    """A point in time for dropped_since()."""
    return len(_kept)


def dropped_since(spark: SparkSession, point: int, *but: DataFrame) -> None:
    """Deletes the tables that were written since a mark, those given excepted; nothing may read them any more."""
    stay = {getattr(df, "shared_path", None) for df in but}
    for path in _kept[point:]:
        if path not in stay:
            _deleted(spark, path)


@atexit.register
def _clean() -> None:
    """The tables behind results that were handed out go with the process, if its session still runs."""
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may be ending too
        for path in [*_kept]:
            _deleted(spark, path)
