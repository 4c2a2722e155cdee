"""Binary files in the shared folder, written by tasks and memory-mapped by workers.

A file is written under a name of its own and then renamed, so a task that runs twice leaves one whole file. Where the
shared folder is a local path that all machines mount, files are mapped in place; otherwise a worker reads the file.

Paths are qualified on the driver as Spark does it, so workers write where Spark would. Who reads a file knows from what
the writing tasks reported whether there is one; a file that should be there and is not is an error, never empty data.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession

from logtide.session import scratch_path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, with the scheme that Spark takes it to have."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def save(path: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays one after another as one file."""
    store, folder = _open(path)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data)
    try:
        store.move(part, f"{folder}/{name}")
    except OSError:
        # some stores do not replace a file: another run of this task has left the same one
        if store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            raise
        store.delete_file(part)


def load(path: str, name: str, dtype) -> np.ndarray:
    """The file as one array. A file that is not there raises ``FileNotFoundError``."""
    store, folder = _open(path)
    file = f"{folder}/{name}"
    info = store.get_file_info(file)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(f"{name} was written below {path}, but is not there for this worker")
    if not info.size:
        return np.zeros(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(file, dtype, "r")
    with store.open_input_file(file) as f:
        return np.frombuffer(f.read(), dtype)
