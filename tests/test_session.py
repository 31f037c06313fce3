"""Where hand-over tables go."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pytest

from fiscora.session import hand_over, scratch_path, scratch_scope, shared_dir


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, configured=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": configured}


def test_configured_folder_wins():
    session = Session("spark://host:7077", "hdfs://shared/x/")
    assert shared_dir(session) == "hdfs://shared/x"
    assert session.sparkContext.folder == "hdfs://shared/x/"


def test_no_machine_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session("yarn"))
    local = Session("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_hand_over_keeps_schema_and_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "i int, s string")
    again = hand_over(df, "pair")
    assert again.schema == df.schema and sorted(again.collect(), key=str) == sorted(df.collect(), key=str)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scope_removes_only_its_own_tables(spark):
    def there(path):
        return os.path.exists(urlparse(path).path)

    before = scratch_path(spark, "before")
    spark.range(3).write.parquet(before)
    with pytest.raises(ZeroDivisionError):
        with scratch_scope(spark):
            outer = scratch_path(spark, "outer")
            spark.range(3).write.parquet(outer)
            with scratch_scope(spark):
                inner = scratch_path(spark, "inner")
                spark.range(3).write.parquet(inner)
                scratch_path(spark, "never-written")
            assert there(outer) and not there(inner)
            1 / 0
    assert there(before) and not there(outer)
