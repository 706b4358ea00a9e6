"""The log tail: held-back lines, truncation, rotation, recreation, resume, splits, and the seek by time."""

import random

import pytest

from spanforge.sources import tail


@pytest.fixture(scope="module")
def source(spark):
    tail.register(spark)
    return spark


class Follower:
    """A running query over a path, and the lines that it has given so far."""

    def __init__(self, spark, path, checkpoint, **options):
        self.seen = []
        reader = spark.readStream.format("log_tail").option("journal", f"{checkpoint}/journal")
        for k, v in options.items():
            reader = reader.option(k, v)
        self.query = reader.load(str(path)).writeStream.foreachBatch(self.take).option("checkpointLocation", f"{checkpoint}/stream").start()

    def take(self, batch, number):
        self.seen += [(r["generation"], bytes(r["value"]).decode()) for r in batch.orderBy("file", "line_no").collect()]

    def now(self):
        self.query.processAllAvailable()
        out, self.seen = self.seen, []
        return [x for _, x in out]

    def stop(self):
        self.query.stop()


def append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


@pytest.fixture
def log(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path / "logs" / "own.txt"


@pytest.fixture
def follow(source, log, tmp_path):
    running = []

    def start(path=None, checkpoint="checkpoint", **options):
        running.append(Follower(source, path or log, tmp_path / checkpoint, **options))
        return running[-1]

    yield start
    for f in running:
        f.stop()


def test_appended_lines_come_and_partial_ones_wait(follow, log):
    append(log, "one\r\n")
    f = follow()
    assert f.now() == ["one"]
    append(log, "two\nthr")
    assert f.now() == ["two"]
    append(log, "ee")
    assert f.now() == []
    append(log, "!\n\nfive\n")
    assert f.now() == ["three!", "", "five"]


def test_a_truncated_file_starts_again(follow, log):
    append(log, "".join(f"old {i}\n" for i in range(10)))
    f = follow()
    assert len(f.now()) == 10
    log.write_bytes(b"new\n")
    assert f.now() == ["new"]
    append(log, "more\n")
    assert f.now() == ["more"]


def test_a_rotated_file_is_read_to_its_end_first(follow, log):
    append(log, "a\nb\n")
    f = follow()
    assert f.now() == ["a", "b"]
    append(log, "c\nd\n")
    log.rename(log.parent / "own.txt.1")
    append(log, "other\n")
    assert f.now() == ["c", "d", "other"]
    append(log, "end\n")
    assert f.now() == ["end"]


def test_a_deleted_file_is_waited_for(follow, log):
    append(log, "first\n")
    f = follow()
    assert f.now() == ["first"]
    log.unlink()
    assert f.now() == []
    append(log, "again\n")
    assert f.now() == ["again"]


def test_a_longer_file_with_another_start_is_new(follow, log):
    append(log, "short\n")
    f = follow()
    assert f.now() == ["short"]
    log.unlink()
    append(log, "a longer beginning\nand more\n")
    assert f.now() == ["a longer beginning", "and more"]


def test_a_folder_and_its_rotated_file_is_read_once(follow, log):
    append(log, "a\n")
    append(log.parent / "zwei.txt", "z\n")
    f = follow(log.parent)
    assert sorted(f.now()) == ["a", "z"]
    log.rename(log.parent / "Archive.txt")
    append(log, "b\n")
    append(log.parent / "drei.txt", "d\n")
    assert sorted(f.now()) == ["b", "d"]


def test_a_killed_query_resumes_and_doubles_nothing(follow, log):
    append(log, "1\n2\n")
    f = follow()
    assert f.now() == ["1", "2"]
    f.stop()
    append(log, "3\n4")
    f = follow()
    assert f.now() == ["3"]
    f.stop()
    # rotated and cut while nobody looked
    append(log, "\n5\n")
    log.rename(log.parent / "old.txt")
    append(log, "6\n")
    f = follow()
    assert f.now() == ["4", "5", "6"]
    f.stop()
    log.write_bytes(b"")
    append(log, "7\n")
    assert follow().now() == ["7"]


def test_an_offset_that_was_promised_is_read_after_a_crash(log, tmp_path):
    """The journal and the offset log survive; the file was rotated between promise and read."""
    append(log, "1\n2\n3\n")
    options = {"path": str(log), "journal": str(tmp_path / "j")}
    end = tail.Files(options).latest()
    log.rename(log.parent / "moved.txt")
    append(log, "4\n")
    files = tail.Files(options)
    lines = lambda a, b: [x for s in files.splits(a, b) for batch in files.rows(s) for x in batch["value"].to_pylist()]
    assert lines({}, end) == [b"1", b"2", b"3"]
    later = files.latest()
    assert lines(end, later) == [b"4"] and lines(end, end) == []
    (tmp_path / "j" / "999999999999.json.new").write_text("{")  # a torn write isn't seen
    assert tail.Files(options).latest() == later


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_splits_have_each_line_once(source, log, split):
    rng = random.Random(split)
    lines = ["x" * rng.randrange(30) for _ in range(200)]
    append(log, "".join(x + "\n" for x in lines) + "no end")
    rows = source.read.format("log_tail").option("splitBytes", split * 3).load(str(log)).orderBy("line_no").collect()
    assert [bytes(r["value"]).decode() for r in rows] == lines
    at = 0
    for r, line in zip(rows, lines):
        assert r["line_no"] == at
        at += len(line) + 1


def test_a_trigger_takes_so_many_bytes_and_a_long_line_whole(follow, log):
    append(log, "aa\nbb\n" + "c" * 100 + "\ndd\n")
    f = follow(maxBytes=4)
    assert f.now() == ["aa", "bb", "c" * 100, "dd"]
    assert f.query.lastProgress["batchId"] >= 2


def test_seek_by_time(source, log):
    minutes = [m for m in range(60) for _ in range(m % 3)]
    append(log, "".join(f"[Sat Mar 09 20:{m:02d}:00 2024] line {i}\n" + ("no stamp\n" if i % 5 == 0 else "") for i, m in enumerate(minutes)))
    for since in (0, 1, 17, 30, 59):
        rows = source.read.format("log_tail").option("since", f"2024-03-09T20:{since:02d}:00").load(str(log)).orderBy("line_no").collect()
        found = [bytes(r["value"]).decode() for r in rows]
        want = [i for i, m in enumerate(minutes) if m >= since]
        assert [int(x.rpartition(" ")[2]) for x in found if "line" in x] == want
    assert source.read.format("log_tail").option("since", "2025-01-01T00:00:00").load(str(log)).count() == 0
