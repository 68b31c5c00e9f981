import os

import pytest

from tilewright.scratch import materialize, shared_dir, shuffle_width, temporary_tables


def test_tables_go_with_their_block(spark):
    with temporary_tables():
        df = materialize(spark.range(10), "t")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 10 and os.path.exists(path)
    assert not os.path.exists(path)


def test_width_follows_the_files(spark, small):
    df = spark.read.parquet(f"{small}/sam_alignments.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = os.path.getsize(f"{small}/sam_alignments.parquet")
    assert shuffle_width(spark, df) == n
    assert shuffle_width(spark, df.where("pos > 5").groupBy("rname").count(), size // 10) >= 10
    assert shuffle_width(spark, spark.range(5)) == n


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    context = type("C", (), {"master": "spark://x:7077", "getConf": lambda self: {}, "getCheckpointDir": lambda self: None})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(type("S", (), {"conf": type("K", (), {"get": staticmethod(lambda k, d=None: d)})(), "sparkContext": context})())
