"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables written since each open ``scratch`` began, innermost last.
_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves a session whose executors are all on
    this machine (tests); elsewhere, where executors could not see it, that is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="railspoke-")
    return _OWN[app]


def application_folder(spark: SparkSession) -> str:
    """Where this application's written tables lie."""
    return f"{shared_folder(spark)}/railspoke/{spark.sparkContext.applicationId}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a write's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(rows: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table written once; lost executors cost no recomputation."""
    spark = rows.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    with shuffles_dropped(spark):
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def forget(rows: DataFrame) -> None:
    """Deletes the files of a table made by ``written``, once nothing reads it any more (rounds of an iteration)."""
    for path in {f.rpartition("/")[0] for f in rows.inputFiles()}:
        if "/railspoke/" in path:
            _delete(rows.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Within it, tables written serve a result on its way: they are deleted at its end, but for what the given function writes."""
    _SCRATCH.append([])

    def kept(rows: DataFrame, name: str) -> DataFrame:
        out = written(rows, name)
        _SCRATCH[-1].pop()
        return out

    try:
        yield kept
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables this application has written, when their results have been read."""
    _delete(spark, application_folder(spark))
