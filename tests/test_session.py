from __future__ import annotations

from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from panelcast.plans.catalog import QUERIES
from panelcast.session import scratch_dir, stage


def cluster(root):
    """What ``scratch_dir`` asks of a session on a cluster whose default file system is local."""
    hadoop = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(
        master="spark://host:7077",
        getCheckpointDir=lambda: None,
        _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop),
    )
    conf = SimpleNamespace(get=lambda key, default=None: root if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("root", ["/mnt/shared", "/mnt/shared/", "file:///mnt/shared", "hdfs://n/shared"])
def test_scratch_is_where_the_cluster_says(root):
    assert scratch_dir(cluster(root), "daily").startswith(f"{root.rstrip('/')}/panelcast/daily-")


def test_cluster_without_scratch_is_refused():
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch_dir(cluster(None), "daily")


def test_stage_of_rows_and_of_none(spark):
    rows = spark.range(100).repartition(7)
    assert stage(rows, "some").count() == 100
    assert stage(rows.filter("id < 0"), "none").count() == 0
    assert stage(spark.createDataFrame([], "id long"), "none").count() == 0


def test_stage_that_nobody_sees_is_an_error(spark, monkeypatch):
    """Tasks that write to folders of their own leave only the mark of the driver."""
    write = DataFrameWriter.parquet

    def unseen(self, path, *args, **kw):
        write(self, path, *args, **kw)
        context = spark.sparkContext
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        files = there.getFileSystem(context._jsc.hadoopConfiguration())
        for status in files.listStatus(there):
            if status.getPath().getName().startswith("part-"):
                files.delete(status.getPath(), False)

    monkeypatch.setattr(DataFrameWriter, "parquet", unseen)
    with pytest.raises(RuntimeError, match="shared"):
        stage(spark.range(5), "lost")


@pytest.mark.parametrize("name", ["a1_quantiles", "a7_counts", "a9_any_all"])
def test_queries_take_a_bare_path_on_a_cluster(spark, monkeypatch, tmp_path, name):
    """As ``spark.checkpoint.dir`` stands in a cluster's defaults, with a master other than local."""
    rows = [(k, k, "F", 1000.0 + k, datetime(2024, 1, 1 + k % 9), "1-URGENT") for k in range(20)]
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    columns += "o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/in/orders.parquet")
    get = type(spark.conf).get
    bare = lambda self, key, *a: f"{tmp_path}/shared" if key == "spark.checkpoint.dir" else get(self, key, *a)
    monkeypatch.setattr(type(spark.conf), "get", bare)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    QUERIES[name](spark, f"{tmp_path}/in").collect()
    assert list((tmp_path / "shared" / "panelcast").iterdir())


def test_stage_that_is_seen_in_part_is_an_error(spark, monkeypatch, tmp_path):
    """A local folder of each machine: only the files of tasks on the driver's machine are seen."""
    write, get = DataFrameWriter.parquet, type(spark.conf).get
    own = {"spark.checkpoint.dir": str(tmp_path), "spark.master": "spark://host:7077"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: own.get(key) or get(self, key, *a))
    assert stage(spark.range(100).repartition(4), "whole").count() == 100
    assert stage(spark.range(100).filter("id < 0"), "none").count() == 0

    def in_part(self, path, *args, **kw):
        write(self, path, *args, **kw)
        sorted(Path(path).glob("part-*"))[-1].unlink()

    monkeypatch.setattr(DataFrameWriter, "parquet", in_part)
    with pytest.raises(RuntimeError, match="of 100 rows"):
        stage(spark.range(100).repartition(4), "part")
