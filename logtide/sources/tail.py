"""A streaming source that follows growing files: lines appended to a file that has been read are read, each once.

The offset of the source holds one entry per file that exists: its identity (device and inode), the byte behind the last
whole line taken, and the first bytes of the file. It lives in the checkpoint of the query, which so takes the place of a
position file. What follows from two offsets alone:

* a file grown: the bytes between its two positions;
* a new identity, also under a name known before: the file from its start;
* a file renamed: its identity goes on, wherever a pattern still finds it (``rotated``);
* a file cut short in place, or cut and written again (other first bytes): the file from its start;
* a file gone: nothing, and its entry ends.

A last line without line break waits until it is whole. Files that match only ``rotated`` when the query starts first are
old and are not read. A range of bytes is cut into partitions of ``partitionBytes``; a line belongs to the
partition its first byte lies in, so a large file is read by many tasks. Where a micro-batch would have more than ``MANY``
partitions smaller than ``PIECE`` they are larger, up to ``PIECE``: a task has a fixed cost, and lines are sent as they are
read, so that a large partition takes no more memory. The folder must be mounted on all executors.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

HEAD = 64  # first bytes that tell a file from one written anew under its identity
CHUNK = 1 << 20
PIECE = 64 << 20  # bytes of a partition where no other size is asked for
MANY = 96  # partitions of a micro-batch beyond which small ones grow
SCHEMA = "value string, file string, file_id string, position bigint"


def identity(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def whole_lines(file, size: int) -> int:
    """The byte behind the last line break before ``size``."""
    end = size
    while end > 0:
        start = max(0, end - CHUNK)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


@dataclass
class Piece(InputPartition):
    """A range of bytes of one file; ``head`` is what the file must begin with."""

    path: str
    file_id: str
    head: str
    first: int
    last: int
    opens: bool  # the range begins at the start of a line


def open_piece(piece: Piece):
    """The file of a piece, also if it has been renamed since; none if it is gone or written anew."""
    folder = os.path.dirname(piece.path)
    names = [piece.path, *(e.path for e in os.scandir(folder) if e.is_file())] if os.path.isdir(folder) else [piece.path]
    for name in names:
        try:
            file = open(name, "rb")
        except OSError:
            continue
        if identity(os.fstat(file.fileno())) == piece.file_id:
            if file.read(len(piece.head) // 2).hex() == piece.head:
                return file
        file.close()
    return None


def lines_of(piece: Piece) -> Iterator[pa.RecordBatch]:
    """The lines that begin within the piece, in batches of about a megabyte."""
    file = open_piece(piece)
    if file is None:
        return
    values: list[str] = []
    places: list[int] = []
    held = 0

    def batch() -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array(values, pa.string()), pa.array([piece.path] * n), pa.array([piece.file_id] * n), pa.array(places, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["value", "file", "file_id", "position"])

    with file:
        at = piece.first
        file.seek(at)
        if not piece.opens:
            file.seek(at - 1)
            at += len(file.readline()) - 1
        while at < piece.last:
            line = file.readline()
            if not line.endswith(b"\n"):
                break
            values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            places.append(at)
            at += len(line)
            held += len(line)
            if held >= CHUNK:
                yield batch()
                values, places, held = [], [], 0
    if values:
        yield batch()


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("the tail source needs a path, which may be a pattern")
        self.path, self.rotated = options["path"], options.get("rotated", "")
        self.piece = int(options.get("partitionbytes", PIECE))
        self.most = int(options.get("maxbytespertrigger", 0))
        self.last: dict | None = None

    def _files(self) -> dict[str, tuple[str, bool]]:
        """{identity: (path, whether only ``rotated`` finds it)} of the files that exist."""
        found: dict[str, tuple[str, bool]] = {}
        for pattern, old in ((self.path, False), (self.rotated, True)):
            if os.path.isdir(pattern):
                pattern = os.path.join(glob.escape(pattern), "*")
            for name in sorted(glob.glob(pattern)) if pattern else []:
                try:
                    stat = os.stat(name)
                except OSError:  # gone meanwhile
                    continue
                if os.path.isfile(name):
                    found.setdefault(identity(stat), (name, old))
        return found

    def _entry(self, path: str, file_id: str, before: dict | None, spare: int | None) -> dict | None:
        """Where the whole lines of a file end, at most ``spare`` bytes further than before."""
        try:
            file = open(path, "rb")
        except OSError:
            return None
        with file:
            stat = os.fstat(file.fileno())
            if identity(stat) != file_id:
                return None
            head = file.read(HEAD)
            start = before["at"] if before and follows(before, {"at": stat.st_size, "head": head.hex()}) else 0
            end = stat.st_size if spare is None else min(stat.st_size, start + spare)
            at = whole_lines(file, end)
            if at <= start and spare is not None and end < stat.st_size:
                file.seek(end)  # one line is longer than what is left to take: take it whole
                at = end + len(file.readline())
                at = whole_lines(file, at)
        at = max(at, start)
        return {"path": path, "at": at, "head": head[:at].hex()}

    def initialOffset(self) -> dict:
        """Nothing is read but what only ``rotated`` finds, which is old."""
        self.last = {}
        for file_id, (path, old) in self._files().items():
            entry = self._entry(path, file_id, None, None) if old else None
            if entry is not None:
                self.last[file_id] = entry
        return self.last

    def latestOffset(self) -> dict:
        files, now, spare = self._files(), {}, self.most if self.most and self.last is not None else None
        for file_id, (path, _) in sorted(files.items(), key=lambda f: (f[1][0], f[0])):
            before = (self.last or {}).get(file_id)
            if spare is not None and spare <= 0:
                if before is not None:
                    now[file_id] = {**before, "path": path}
                continue
            entry = self._entry(path, file_id, before, spare)
            if entry is not None:
                now[file_id] = entry
                if spare is not None:
                    spare -= entry["at"] - (before["at"] if before and follows(before, entry) else 0)
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        firsts = {}
        for file_id, entry in end.items():
            before = start.get(file_id)
            firsts[file_id] = before["at"] if before and follows(before, entry) else 0
        due = sum(entry["at"] - firsts[file_id] for file_id, entry in end.items())
        size = max(self.piece, min(PIECE, -(-due // MANY)))
        pieces = []
        for file_id, entry in end.items():
            first = firsts[file_id]
            for at in range(first, entry["at"], size):
                last = min(at + size, entry["at"])
                pieces.append(Piece(entry["path"], file_id, entry["head"], at, last, at == first))
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return lines_of(partition)


def follows(before: dict, after: dict) -> bool:
    """Whether a file has only grown between two entries of its identity."""
    return after["at"] >= before["at"] and after["head"].startswith(before["head"])


class TailSource(DataSource):
    """``spark.readStream.format("tail")`` with path, rotated, partitionBytes, maxBytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail_files(spark: SparkSession, path: str, rotated: str | None = None, **options: int | str) -> DataFrame:
    """A stream of (value, file, file_id, position): the lines of all files that ``path``, a folder or pattern, finds."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("path", path)
    if rotated:
        reader = reader.option("rotated", rotated)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
