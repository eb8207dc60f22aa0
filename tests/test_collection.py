"""Versioned collections: builds, upserts, concurrent writers, compaction."""

import pytest
from pyspark.sql import functions as F

from sheaf.session import scratch_path
from sheaf.sources import collection as C


def held(spark, path, version=None):
    return sorted((r.id, r.a, r.b) for r in C.open_version(spark, path, version).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, a string, b array<double>")


def test_the_same_build_twice_adds_nothing(spark):
    path = scratch_path(spark, "c")
    rows = frame(spark, [("1", "x", [1.0]), ("2", None, None), ("3", "", []), ("4", "x", [1.0])]).drop("key")
    assert C.save(rows, path) == 1
    first = held(spark, path)
    assert C.save(rows.repartition(7), path, "upsert") == 2
    assert held(spark, path) == first and len(first) == 3      # equal content is one row; null and empty text are two
    assert C.manifest(spark, path)["deltas"][1]["rows"] == 0


def test_append_upsert_delete_compact_and_old_versions(spark):
    path = scratch_path(spark, "c")
    C.save(frame(spark, [("1", "one", None), ("2", "two", None), ("3", "three", None)]), path, id_col="key", buckets=4)
    C.save(frame(spark, [("2", "other", None), ("4", "four", None)]), path, "append", id_col="key")
    C.save(frame(spark, [("1", "ONE", None), ("2", "two", None), ("5", "five", None)]), path, "upsert", id_col="key")
    want = [("1", "ONE", None), ("2", "two", None), ("3", "three", None), ("4", "four", None), ("5", "five", None)]
    assert held(spark, path) == want
    assert C.manifest(spark, path)["deltas"][2]["gone"] == 1   # the row that did not change is not written again
    C.delete(spark, path, spark.createDataFrame([("3",), ("9",), (None,)], "id string"))
    C.save(frame(spark, [("3", "again", None)]), path, "append", id_col="key")
    want[2] = ("3", "again", None)
    assert held(spark, path) == want
    assert C.compact(spark, path) == 6 and held(spark, path) == want
    assert len(C.manifest(spark, path)["deltas"]) == 1
    assert [r[1] for r in held(spark, path, 1)] == ["one", "two", "three"]
    assert [r.a for r in C.lookup(spark, path, ["4", "77"]).collect()] == ["four"]
    C.save(frame(spark, [("8", "all", None)]), path, "replace", id_col="key")
    assert held(spark, path) == [("8", "all", None)] and held(spark, path, 6) == want
    assert len(C.vacuum(spark, path)) == 6 and C.versions(spark, path) == [7]
    assert held(spark, path) == [("8", "all", None)]


def test_one_of_two_writers_fails_and_readers_see_whole_versions(spark, monkeypatch):
    path = scratch_path(spark, "c")
    C.save(frame(spark, [("1", "x", None)]), path, id_col="key")
    publish, raced = C._publish, []

    def late(spark_, where, content):
        if not raced:      # another writer is quicker
            raced.append(1)
            C.save(frame(spark, [("2", "quick", None)]), path, id_col="key")
        return publish(spark_, where, content)

    monkeypatch.setattr(C, "_publish", late)
    with pytest.raises(C.ConcurrentChange):
        C.save(frame(spark, [("3", "slow", None)]), path, id_col="key")
    assert [r[0] for r in held(spark, path)] == ["1", "2"]     # the delta of the loser is not seen
    C.save(frame(spark, [("3", "slow", None)]), path, id_col="key")
    assert [r[0] for r in held(spark, path)] == ["1", "2", "3"]


def test_edges(spark):
    path = scratch_path(spark, "c")
    with pytest.raises(FileNotFoundError):
        C.open_version(spark, path)
    none = frame(spark, [("1", "x", None)]).limit(0)
    assert C.save(none, path, id_col="key") == 1 and held(spark, path) == []
    C.save(frame(spark, [("1", "b", None), ("1", "a", None), ("1", "a", None)]), path, id_col="key")
    assert len(held(spark, path)) == 1
    with pytest.raises(Exception, match="row without id"):
        C.save(frame(spark, [(None, "x", None)]), path, id_col="key")
    with pytest.raises(ValueError, match="columns"):
        C.save(frame(spark, [("1", "x", None)]).withColumn("c", F.lit(1)), path, id_col="key")
    with pytest.raises(FileNotFoundError):
        C.open_version(spark, path, 99)
