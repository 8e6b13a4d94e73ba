"""NumPy files as rows: a batch data source named ``npy``, and a reader over ``binaryFile``.

``register`` makes ``spark.read.format("npy").load(path)`` and ``df.write.format("npy").save(path)``
known. Both use Arrow's file systems, so a path may be local to all machines or in HDFS or an
object store. ``read_npy`` reads by Spark itself, from any store that it knows. The rows are
``path``, ``shape`` and ``values`` (doubles in row order); to write, ``name`` takes the place of ``path``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from orbweave.sources.files import numbered_files

ROWS = "path string, shape array<int>, values array<double>"
#: Where files lie until all of them are there.
UNDER_WAY = "_under_way"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _loaded(content: bytes) -> np.ndarray:
    """An array of numbers; ValueError for pickled objects and files of another kind."""
    return np.asarray(np.load(io.BytesIO(content), allow_pickle=False), np.float64)


@dataclass
class OneFile(InputPartition):
    path: str


class NpyReader(DataSourceReader):
    """A partition a file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[OneFile]:
        files, at = _at(self.path)
        found = files.get_file_info(fs.FileSelector(at, recursive=True)) if files.get_file_info(at).type == fs.FileType.Directory else [files.get_file_info(at)]
        names = sorted(f.path for f in found if f.is_file and f.extension.lower() == "npy" and f"/{UNDER_WAY}" not in f.path)
        return [OneFile(n) for n in names]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        files, _ = _at(self.path)
        with files.open_input_stream(partition.path) as f:
            x = _loaded(f.read())
        yield partition.path, list(x.shape), x.ravel().tolist()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NpyWriter(DataSourceWriter):
    """A file a row, under its ``name``; files get their names when all tasks have ended, and none does otherwise."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite
        missing = {"name", "shape", "values"} - set(names)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        files, at = _at(self.path)
        files.create_dir(f"{at}/{UNDER_WAY}", recursive=True)
        made = []
        for row in rows:
            context = TaskContext.get()
            part = f"{at}/{UNDER_WAY}/{context.partitionId()}-{context.taskAttemptId()}-{len(made)}.npy"
            with files.open_output_stream(part) as f:
                body = io.BytesIO()
                np.save(body, np.array(row["values"], np.float64).reshape(row["shape"]))
                f.write(body.getvalue())
            made.append((part, f"{at}/{row['name']}.npy"))
        return Written(made)

    def commit(self, messages: list) -> None:
        files, at = _at(self.path)
        made = [pair for m in messages if m is not None for pair in m.files]
        if len({to for _, to in made}) < len(made):
            self.abort(messages)
            raise ValueError("two rows have one name")
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(at)):
                if old.is_file and old.extension == "npy":
                    files.delete_file(old.path)
        for part, to in made:
            files.move(part, to)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, at = _at(self.path)
        if files.get_file_info(f"{at}/{UNDER_WAY}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/{UNDER_WAY}")


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def read_npy(spark: SparkSession, root: str) -> DataFrame:
    """The NumPy files below ``root``, read by Spark: ``path``, ``shape``, ``values`` and ``error`` (why a file has none)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(root)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.string()]
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    x = _loaded(content)
                    row = [path, list(x.shape), x.ravel(), None]
                except (ValueError, OSError, EOFError) as e:
                    row = [path, None, None, str(e)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "shape", "values", "error"])

    return found.select("path", "content").mapInArrow(load, f"{ROWS}, error string")


def ranked_npy(spark: SparkSession, root: str, pattern: str = r"_rank(\d+)\.npy$") -> DataFrame:
    """``rank`` (from the name), ``path``, ``shape`` and ``values`` of files named by rank; of a rank the last by path."""
    files = read_npy(spark, root).where(F.col("error").isNull())
    return numbered_files(files.select("path"), pattern).join(files.drop("error"), "path").select("rank", "path", "shape", "values")
