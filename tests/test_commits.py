"""Publications as one commit: all or nothing, left-overs seen, tokens, conflicts, and boards on top of them."""

import pytest
from pyspark.sql import functions as F

from canopygrid.sources import commits


def rows(spark, *data):
    return spark.createDataFrame(list(data), "scene string, block int, v long")


def state(spark, root, at=None):
    return sorted(map(tuple, commits.read_published(spark, root, at).select("scene", "block", "v").collect()), key=str)


def test_partitions_change_together(spark, tmp_path):
    root = str(tmp_path / "t")
    assert commits.read_published(spark, root) is None and commits.latest(spark, root) == 0 and commits.leftovers(spark, root) == []
    assert commits.publish_commit(rows(spark, ("007", 1, 1), ("007", 1, 2), ("b", 1, 3), ("b", 2, 4), (None, 1, 5)), root, ["scene", "block"]) == 1
    first = state(spark, root)
    assert first == sorted([("007", 1, 1), ("007", 1, 2), ("b", 1, 3), ("b", 2, 4), (None, 1, 5)], key=str)
    assert commits.publish_commit(rows(spark, ("007", 1, 10), ("c", 3, 30), (None, 1, 50)), root, ["scene", "block"]) == 2
    assert state(spark, root) == sorted([("007", 1, 10), ("b", 1, 3), ("b", 2, 4), ("c", 3, 30), (None, 1, 50)], key=str)
    assert state(spark, root, at=1) == first
    assert commits.publish_commit(rows(spark, ("z", 0, 0)), root, ["scene", "block"], replace_all=True) == 3
    assert state(spark, root) == [("z", 0, 0)]


def test_a_lost_writer_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    commits.publish_commit(rows(spark, ("a", 1, 1), ("b", 1, 2)), root, ["scene"])
    lost = commits.write_version(rows(spark, ("a", 1, 9), ("d", 1, 9)), root, ["scene"])  # and then it is gone
    assert state(spark, root) == [("a", 1, 1), ("b", 1, 2)] and commits.leftovers(spark, root) == [lost]
    commits.publish_commit(rows(spark, ("b", 1, 3)), root, ["scene"], files=4)
    assert state(spark, root) == [("a", 1, 1), ("b", 1, 3)] and commits.leftovers(spark, root) == [lost]


def test_tokens_and_conflicts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert commits.publish_commit(rows(spark, ("a", 1, 1)), root, ["scene"], token="batch-7") == 1
    assert commits.publish_commit(rows(spark, ("a", 1, 99)), root, ["scene"], token="batch-7") == 1
    assert state(spark, root) == [("a", 1, 1)]
    version = commits.write_version(rows(spark, ("b", 1, 1)), root, ["scene"])
    monkeypatch.setattr(commits, "latest", lambda *_: 0)  # a writer that has not seen commit 1
    monkeypatch.setattr(commits, "_record", lambda *_: None)
    with pytest.raises(commits.ConflictError):
        commits.commit(spark, root, version, ["scene"], rows(spark, ("b", 1, 1)).schema)
    monkeypatch.undo()
    assert state(spark, root) == [("a", 1, 1)]


def test_an_empty_publication(spark, tmp_path):
    root = str(tmp_path / "t")
    none = rows(spark, ("a", 1, 1)).where(F.lit(False))
    assert commits.publish_commit(none, root, ["scene"]) == 1
    commits.publish_commit(rows(spark, ("a", 1, 1)), root, ["scene"])
    assert state(spark, root) == [("a", 1, 1)]
    commits.publish_commit(none, root, ["scene"])
    assert state(spark, root) == [("a", 1, 1)]
    commits.publish_commit(none, root, ["scene"], replace_all=True)
    assert state(spark, root) == []


def test_reading_opens_one_record(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(6):
        commits.publish_commit(rows(spark, ("a", 1, i)), root, ["scene"])
    assert len(commits._record(spark, root).inputFiles()) == 1 and state(spark, root) == [("a", 1, 5)]
