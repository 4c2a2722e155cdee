"""The tail source: every line once, whatever happens to the files and the query."""

import os

import pytest

from logtide.session import ship
from logtide.sources import collect, tail


class Tail:
    """One query over a folder, started anew for each batch from the same checkpoint."""

    def __init__(self, spark, folder, **options):
        ship(spark)
        self.spark, self.folder, self.options = spark, folder, options
        (folder / "in").mkdir()
        self.dir = folder / "in"

    def write(self, name, text, mode="a"):
        with open(self.dir / name, mode) as f:
            f.write(text)

    def run(self):
        rows = tail.tail_files(self.spark, f"{self.dir}/*.log", f"{self.dir}/*.log.*", **self.options)
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(self.folder / "cp")).trigger(availableNow=True)
        query.start(str(self.folder / "out")).awaitTermination(120)
        return self.lines()

    def lines(self):
        return sorted(r["value"] for r in self.spark.read.parquet(str(self.folder / "out")).collect())


def test_appended_lines_and_new_files(spark, tmp_path):
    t = Tail(spark, tmp_path)
    t.write("a.log", "1\n2\n")
    assert t.run() == ["1", "2"]
    assert t.run() == ["1", "2"]
    t.write("a.log", "3\r\n\nhalf")
    t.write("b.log", "é\n")
    assert t.run() == ["", "1", "2", "3", "é"]
    t.write("a.log", " line\n")
    assert t.run() == ["", "1", "2", "3", "half line", "é"]


def test_rotation_by_renaming(spark, tmp_path):
    """Lines written before and after the change of name, and the new file of the old name."""
    t = Tail(spark, tmp_path)
    t.write("a.log.9", "old\n")
    t.write("a.log", "1\n")
    assert t.run() == ["1"]
    t.write("a.log", "2\n")
    os.rename(t.dir / "a.log", t.dir / "a.log.1")
    t.write("a.log.1", "3\n")
    t.write("a.log", "4\n")
    assert t.run() == ["1", "2", "3", "4"]
    os.rename(t.dir / "a.log.1", t.dir / "a.log.2")
    os.rename(t.dir / "a.log", t.dir / "a.log.1")
    assert t.run() == ["1", "2", "3", "4"]
    t.write("a.log", "5\n")
    os.remove(t.dir / "a.log.2")
    assert t.run() == ["1", "2", "3", "4", "5"]


def test_truncation(spark, tmp_path):
    t = Tail(spark, tmp_path)
    t.write("a.log", "first one\nfirst two\n")
    assert len(t.run()) == 2
    t.write("a.log", "new\n", "w")  # shorter than what was read
    assert t.run() == ["first one", "first two", "new"]
    t.write("a.log", "and longer than before\nsecond\n", "w")  # longer, but it begins otherwise
    assert t.run() == ["and longer than before", "first one", "first two", "new", "second"]
    t.write("a.log", "", "w")
    assert len(t.run()) == 5
    t.write("a.log", "x\n")
    assert len(t.run()) == 6


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_share_no_line(spark, tmp_path, size):
    t = Tail(spark, tmp_path, partitionBytes=size)
    want = [f"line {i} {'x' * (i % 40)}" for i in range(60)]
    t.write("a.log", "".join(f"{w}\n" for w in want[:30]))
    t.run()
    t.write("a.log", "".join(f"{w}\n" for w in want[30:]))
    assert t.run() == sorted(want)


def test_bytes_per_trigger(spark, tmp_path):
    """Batches stop at the bound, at line ends; a line longer than it comes whole."""
    (tmp_path / "a.log").write_text("".join(f"{i:04d}\n" for i in range(100)) + "y" * 300 + "\n" + "z\n")
    (tmp_path / "b.log").write_text("b\n" * 20)
    reader = tail.TailReader({"path": str(tmp_path), "maxbytespertrigger": "103"})
    at, seen, batches = reader.initialOffset(), [], 0
    while True:
        then = reader.latestOffset()
        pieces = reader.partitions(at, then)
        if not pieces:
            break
        rows = [v for p in pieces for b in reader.read(p) for v in b.column(0).to_pylist()]
        assert sum(len(r) + 1 for r in rows) <= 103 or len(rows) == 1
        seen += rows
        at, batches = then, batches + 1
    assert sorted(seen) == sorted([f"{i:04d}" for i in range(100)] + ["y" * 300, "z"] + ["b"] * 20) and batches > 5


def test_a_batch_read_again_gives_the_same_rows(tmp_path):
    """As after a failure: the offsets are known, the files have moved on."""
    (tmp_path / "a.log").write_text("1\n2\n")
    reader = tail.TailReader({"path": f"{tmp_path}/*.log", "rotated": f"{tmp_path}/*.log.*"})
    start, end = reader.initialOffset(), reader.latestOffset()
    with open(tmp_path / "a.log", "a") as f:
        f.write("3\n")
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    (tmp_path / "a.log").write_text("other\n")
    again = tail.TailReader({"path": f"{tmp_path}/*.log", "rotated": f"{tmp_path}/*.log.*"})
    rows = [v for p in again.partitions(start, end) for b in again.read(p) for v in b.column(0).to_pylist()]
    assert rows == ["1", "2"]
    rows = [v for p in again.partitions(end, again.latestOffset()) for b in again.read(p) for v in b.column(0).to_pylist()]
    assert sorted(rows) == ["3", "other"]


def test_container_stream(spark, tmp_path):
    t = Tail(spark, tmp_path)
    t.write("auth-service-1.log", '{"log": "hello", "level": "WARN"}\n')
    rows = collect.read_container_logs(spark, f"{t.dir}/*.log")
    assert rows.columns == ["value", "container_name"] and rows.isStreaming
    query = rows.writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("tailed").collect()] == [('{"log": "hello", "level": "WARN"}', "auth-service-1")]


def test_small_partitions_grow_with_the_input(tmp_path):
    """A micro-batch of many small partitions has larger ones instead; every byte is in one of them, every line is read."""
    lines = [f"line {i}\n" for i in range(20_000)]
    (tmp_path / "a.log").write_text("".join(lines))
    (tmp_path / "b.log").write_text("one\ntwo\n")
    reader = tail.TailReader({"path": f"{tmp_path}/*.log", "partitionbytes": "100"})
    pieces = reader.partitions({}, reader.latestOffset())
    assert len(pieces) <= tail.MANY + 2
    assert sum(p.last - p.first for p in pieces) == len("".join(lines)) + 8
    read = [v for p in pieces for batch in tail.lines_of(p) for v in batch.column(0).to_pylist()]
    assert sorted(read) == sorted([x.rstrip("\n") for x in lines] + ["one", "two"])
