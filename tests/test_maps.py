"""Map folders: layers by name, sets by preference, labels read once a change."""

import os

import pytest

from spanforge.sources import maps


@pytest.fixture
def folders(tmp_path):
    for name, files in {"own": {"fen.txt": "P 1,2,3,0,0,0,3,to_Keep", "fen_1.txt": "P 4,5,6,0,0,0,3,Bank", "arena2.txt": "L 1,1,1,2,2,2,0,0,0"}, "default": {"fen.txt": "P 9,9,9,0,0,0,3,old", "Keep_4.txt": "P 1,1,1,0,0,0,2,x"}}.items():
        os.makedirs(tmp_path / name)
        for file, text in files.items():
            (tmp_path / name / file).write_text(text + "\n")
    return {"default": f"file://{tmp_path}/default", "own": f"file://{tmp_path}/own"}


def test_catalogue(spark, folders):
    listed = maps.listing(spark, folders)
    assert sorted((r["set"], r["short"], r["layer"]) for r in listed.collect()) == [("default", "fen", 0), ("default", "keep_4", 0), ("own", "arena2", 0), ("own", "fen", 0), ("own", "fen", 1)]
    zones = spark.createDataFrame([("FEN", "The Fen", "old"), ("keep_4", "A Keep", None)], "short string, display string, era string")
    drawn = maps.catalogue(listed, zones, ["own", "default"])
    assert [(r["short"], r["display"], r["sets"]) for r in drawn.orderBy("nth").collect()] == [("keep_4", "A Keep", ["default"]), ("fen", "The Fen", ["own", "default"]), ("arena2", None, ["own"])]
    names = spark.createDataFrame([("the fen 2 (Hard)",), ("Nowhere",)], "zone string")
    assert [(r["zone"], r["maps"]) for r in maps.available(names, drawn).collect()] == [("the fen 2 (Hard)", ["fen"])]


def test_labels_are_read_again_where_files_change(spark, folders, tmp_path):
    cache = maps.LabelCache(spark, f"file://{tmp_path}/labels")
    read = lambda: sorted(r["label"] for r in cache.labels(maps.listing(spark, folders)).collect())
    assert (read(), cache.parsed) == (["Bank", "old", "to Keep", "x"], 5)
    assert (read(), cache.parsed) == (["Bank", "old", "to Keep", "x"], 0)
    file = tmp_path / "own" / "fen_1.txt"
    file.write_text("P 4,5,6,0,0,0,3,Bank\nP 4,5,6,0,0,0,3,Inn\n")
    os.remove(tmp_path / "default" / "Keep_4.txt")
    assert (read(), cache.parsed) == (["Bank", "Inn", "old", "to Keep"], 1)
    os.remove(tmp_path / "own" / "arena2.txt")
    assert (read(), cache.parsed) == (["Bank", "Inn", "old", "to Keep"], 0)
