"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: The open scratch steps of this thread, innermost last: what each has stored.
_steps: ContextVar[tuple[list[str], ...]] = ContextVar("steps", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that
    would be a folder that other machines don't see, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside go at the end, but for those stored with ``keep``.

    What is lazily read from them must have been stored by then.
    """
    before = _steps.set((*_steps.get(), []))
    try:
        yield
    finally:
        paths = _steps.get()[-1]
        _steps.reset(before)
        for path in paths:
            remove(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read from there.

    A lost executor then costs a re-read and no recomputation. The table stays until the
    shared folder is cleared: what is lazily read from it may run at any later time. Tables
    that a loop replaces go with :func:`forget`, those of one step with :func:`scratch`; keep
    hands a table on to the step around.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    steps = _steps.get()[:-1] if keep else _steps.get()
    if steps:
        steps[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that :func:`stored` wrote and that nothing reads any more."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)
