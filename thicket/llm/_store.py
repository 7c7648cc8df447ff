"""Files that tasks write and read in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 1000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary one where that is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"thicket-llm-{os.getpid()}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Writes rows as Parquet and reads them back: cuts the lineage and keeps columns prunable.

    Texts are long, so Arrow batches are kept to ``BATCH_ROWS`` rows meanwhile, which bounds what a Python
    worker and its task hold at once.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path, compression=compression)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` of a mapInArrow; when its task ends, the Python worker hands freed memory back to the system.

    Workers wait for further tasks while stages without Python run in the same executor.
    """

    @functools.wraps(run)
    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return tidied


def _local(uri: str) -> str | None:
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_bytes(uri: str, *parts: bytes) -> None:
    """Writes a whole file under a temporary name, then renames it: a repeated task replaces it whole."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as out:
            for part in parts:
                out.write(part)
        os.replace(temporary, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    store.move(temporary, path)


_fetched: dict[str, str] = {}


def local_file(uri: str) -> str:
    """A path that this worker can open: the file itself, or one copy of it where the folder is remote."""
    path = _local(uri)
    if path is not None:
        return path
    if uri not in _fetched:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        target = os.path.join(tempfile.mkdtemp(), os.path.basename(path))
        with store.open_input_stream(path) as source, open(target, "wb") as out:
            while block := source.read(8 << 20):
                out.write(block)
        _fetched[uri] = target
    return _fetched[uri]


def read_range(uri: str, start: int, length: int) -> bytes:
    """Bytes of a file from ``start`` (from its end where negative)."""
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as source:
            source.seek(start, 0 if start >= 0 else 2)
            return source.read(length)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        source.seek(start if start >= 0 else source.size() + start)
        return source.read(length)


def mapped(uri: str, kind: type) -> np.ndarray:
    """A file of plain values, memory-mapped."""
    path = local_file(uri)
    return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
