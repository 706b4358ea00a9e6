"""The record cache: continued readings equal cold ones, and what no longer fits the log is parsed again."""

import json
import os

import pytest

from spanforge.sources.records import RecordCache


def line(second, text):
    return f"[Sat Mar 09 20:{second // 60:02d}:{second % 60:02d} 2024] {text}\n"


def hits(a, b):
    return "".join(line(i, f"Raider01 slashes a gnoll for {i + 1} points of damage.") for i in range(a, b))


@pytest.fixture
def cache(spark, tmp_path):
    log = tmp_path / "own.txt"
    make = lambda **more: RecordCache(spark, str(tmp_path / "cache"), str(log), "own", **more)
    return log, make


def read(c):
    rows = sorted((r["line_no"], r["ts"], r["kind"], r["actor"], r["amount"]) for r in c.events().collect())
    return rows, c.parsed


def cold(spark, log, folder):
    return read(RecordCache(spark, str(folder), str(log), "own"))[0]


def test_a_continued_reading_equals_a_cold_one(spark, cache, tmp_path):
    log, make = cache
    log.write_text(hits(0, 40) + "no stamp at all\n" + line(41, "You assume a defensive stance.") + "[Sat Mar 09 20:10")
    first, parsed = read(make())
    assert len(first) == 41 and parsed == log.stat().st_size - len("[Sat Mar 09 20:10")
    before = log.stat().st_size
    with log.open("a") as f:
        f.write(":00 2024] Raider02 slashes a gnoll for 7 points of damage.\n" + hits(50, 60))
    rows, parsed = read(make())
    assert parsed < log.stat().st_size - before + 40 and len(rows) == 52
    assert rows == cold(spark, log, tmp_path / "other") and rows[:41] == first
    assert read(make()) == (rows, 0)


def test_shrunk_changed_and_other_parsers_are_parsed_again(spark, cache, tmp_path, monkeypatch):
    from spanforge.sources import records

    log, make = cache
    log.write_text(hits(0, 20))
    read(make())
    log.write_text(hits(100, 105))
    rows, parsed = read(make())
    assert len(rows) == 5 and parsed == log.stat().st_size
    # as long as before, with other bytes before the parsed point
    log.write_text(hits(200, 204) + hits(104, 120))
    rows, parsed = read(make())
    assert len(rows) == 20 and parsed == log.stat().st_size
    assert read(make())[1] == 0
    assert read(make(emu=True))[1] == log.stat().st_size
    monkeypatch.setattr(records, "PARSER", 99)
    assert read(make(emu=True))[1] == log.stat().st_size


def test_torn_and_corrupt_caches_fall_back(spark, cache, tmp_path):
    log, make = cache
    log.write_text(hits(0, 20))
    want, _ = read(make())
    folder = tmp_path / "cache"
    # a part that was written, and no manifest; a manifest that isn't whole
    (folder / "part-torn").mkdir()
    (folder / "part-torn" / "x.parquet").write_bytes(b"PAR1")
    (folder / "manifest-000000007.json").write_text('{"path": ')
    assert read(make()) == (want, 0)
    # a part that lost bytes
    part = next(p for p in os.listdir(folder) if p.startswith("part-") and p != "part-torn")
    (file,) = [f for f in os.listdir(folder / part) if f.endswith(".parquet")][:1]
    (folder / part / file).write_bytes(b"")
    assert read(make()) == (want, log.stat().st_size)
    assert read(make()) == (want, 0)
    assert "part-torn" not in os.listdir(folder)
    (manifest,) = [m for m in os.listdir(folder) if m.startswith("manifest")]
    assert json.loads((folder / manifest).read_text())["parsed"] == log.stat().st_size


def test_a_log_that_is_gone_is_an_error(cache):
    with pytest.raises(FileNotFoundError):
        cache[1]().events()
