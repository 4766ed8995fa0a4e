"""Tables kept between the steps of one job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application, where none is set.
_own: dict[str, str] = {}
#: What keep() has written since the innermost kept_until_here() began.
_scope: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; one of our own only where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='wayfold-')}"
    return _own[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again.

    Later steps start from the files, so neither a lost executor nor a second
    use computes it anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.kept_at = path
    if (scope := _scope.get()) is not None:
        scope.append(found)
    return found


def discard(*kept: DataFrame) -> None:
    """Deletes tables that keep() wrote, once nothing that is still to be computed reads them."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def kept_until_here() -> Iterator[None]:
    """Deletes at its end, failed or not, all that keep() wrote inside; for steps that have written their result by then."""
    mark = _scope.set([])
    try:
        yield
    finally:
        found = _scope.get()
        _scope.reset(mark)
        discard(*found)
