import json
import os
import time

import pytest

from parchment.sources.changed import write_changed


def rows(spark, *pairs, parts=3):
    return spark.createDataFrame(pairs, "name string, content string").repartition(parts)


def state(root):
    return {os.path.relpath(f"{d}/{n}", root): (open(f"{d}/{n}").read(), os.stat(f"{d}/{n}").st_mtime_ns) for d, _, names in os.walk(root) for n in names}


def test_only_what_changed_is_written(spark, tmp_path):
    root = str(tmp_path / "out")
    write_changed(rows(spark, ("a.md", "A"), ("sub/b.md", "B é"), ("c.md", None)), root)
    first = state(root)
    assert {k: v[0] for k, v in first.items() if k[0] != "_"} == {"a.md": "A", "sub/b.md": "B é", "c.md": ""} and set(first) == {"a.md", "sub/b.md", "c.md", "_manifest.json"}
    write_changed(rows(spark, ("a.md", "A"), ("sub/b.md", "B é"), ("c.md", "")), root)
    assert state(root) == first  # no file is touched, not even the manifest
    write_changed(rows(spark, ("a.md", "A2"), ("sub/b.md", "B é"), ("d.md", "D")), root)
    second = state(root)
    assert second["a.md"][0] == "A2" and second["sub/b.md"] == first["sub/b.md"] and second["c.md"] == first["c.md"] and second["d.md"][0] == "D"
    assert set(json.loads(second["_manifest.json"][0])) == {"a.md", "sub/b.md", "c.md", "d.md"}
    write_changed(rows(spark, ("a.md", "A2")), root, "overwrite")
    assert set(state(root)) == {"a.md", "_manifest.json"} and state(root)["a.md"] == second["a.md"]


def test_a_run_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    write_changed(rows(spark, ("a.md", "A")), root)
    before = state(root)
    for bad in ([("b.md", "B"), ("../x", "X")], [("b.md", "B"), ("_hidden", "X")], [("b.md", "B"), (None, "X")], [("b.md", "B"), ("b.md", "C")], [("b.md", "B"), ("y/../z", "C")]):
        with pytest.raises(Exception, match="names no file|two contents"):
            write_changed(rows(spark, *bad, parts=4), root)
        for _ in range(100):  # other tasks of the run may still be ending
            if len(os.listdir(root)) == 2:
                break
            time.sleep(0.2)
        assert state(root) == before and len(os.listdir(root)) == 2
    assert not os.path.exists(tmp_path / "x")


def test_urls_and_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    write_changed(rows(spark, ("a.md", "A")), root)
    write_changed(rows(spark), root)
    assert state(str(tmp_path / "out"))["a.md"][0] == "A"
