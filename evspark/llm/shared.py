"""The folder all executors share, tables kept in it, and plain files in it.

Files are opened through ``pyarrow.fs``, so the folder may be on a local or mounted disk, HDFS or an
object store. A file on a mounted disk is memory-mapped, any other is read into one buffer.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """One folder per process, for a local master without a setting."""
    return tempfile.mkdtemp(prefix="llm-")


def new_folder(spark: SparkSession, what: str) -> str:
    """New folder name below ``spark.checkpoint.dir``; only a local master may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


BATCH_BYTES = 8 << 20
"""Size of the batches that a stored step hands to Python and gets back; each is held several times over on both sides."""


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH_BYTES`` at most for what runs inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, what)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    files, path = _open(uri)
    files.create_dir(path, recursive=True)


def listed(uri: str) -> list[fs.FileInfo]:
    files, path = _open(uri)
    return files.get_file_info(fs.FileSelector(path))


class AtomicFile:
    """A file that appears under its name only when complete, so retried and twin tasks do no harm."""

    def __init__(self, uri: str):
        self.files, self.path = _open(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.files.open_output_stream(self.part, compression=None)

    def write(self, data) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.part, self.path)


def mapped(uri: str) -> pa.Buffer:
    """Content of a file: memory-mapped where the file system is mounted."""
    files, path = _open(uri)
    if isinstance(files, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with files.open_input_file(path) as source:
        return source.read_buffer()


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of each run with equal values in the first ``keys`` columns; the input is sorted by them."""
    rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
    for _, run in itertools.groupby(rows, lambda r: tuple(itertools.islice(r.values(), keys))):
        yield list(run)
