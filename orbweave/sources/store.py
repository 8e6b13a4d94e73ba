"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_OWN_DIRS: dict[str, str] = {}
#: Where a table that ``materialise`` wrote lies, and what each open ``scratch`` has to delete.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, for a ``local`` master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        own = tempfile.TemporaryDirectory(prefix="orbweave-")
        atexit.register(own.cleanup)
        _OWN_DIRS[app] = "file://" + own.name
    return _OWN_DIRS[app]


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    ``keep``: the table outlives the innermost ``scratch``.
    """
    path = f"{shared_dir(df.sparkSession)}/orbweave/{name}-{uuid.uuid4().hex}"
    begun = _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    if begun:
        begun[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


class Kept:
    """Things that are built once in the shared folder of an application and opened after that."""

    def __init__(self, kind: str):
        self.kind = kind
        self.paths: dict[tuple[str, str], str] = {}

    def get(self, name: str, spark: SparkSession, build: Callable[[str], T], open_at: Callable[[str], T]) -> T:
        """What ``build`` makes at a path of its own; from the second call on what ``open_at`` finds there."""
        key = (spark.sparkContext.applicationId, name)
        if key in self.paths:
            return open_at(self.paths[key])
        path = f"{shared_dir(spark)}/orbweave/{self.kind}-{uuid.uuid4().hex}"
        made = build(path)
        self.paths[key] = path
        return made


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end.

    What is read later is to be written inside with ``keep``; a table that is whole
    needs nothing of what it was made from, also after the loss of an executor.
    """
    own: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), own))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in own:
            _delete(spark, path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more; others stay."""
    path = _PATHS.pop(table, None)
    if path:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
