"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "panelcast", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A bare path is as good as one with a scheme: a mount that all machines have is a local
    path to each of them.  Only a local session without the setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="panelcast-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_root(spark)}/panelcast/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Reliable checkpoints survive the loss of an executor.
    """
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    For a result that is read more than once: what it took to make it, such as a scan
    of the facts, is not done again.  Every write leaves a file, also of no rows, so a folder
    where none is seen is not the one that the tasks wrote to.  On a cluster, a local path may be
    a folder of each machine's own, where the files of some tasks are seen: rows are counted there.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    written = None if spark.conf.get("spark.master", "local").startswith("local") else Observation()
    out = df if written is None else df.observe(written, F.count(F.lit(1)).alias("n"))
    out.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    files = back.inputFiles()
    if not files:
        raise RuntimeError(f"spark.checkpoint.dir must be shared: no task's file is in {path}")
    if written is not None and files[0].startswith("file:") and (seen := back.count()) != written.get["n"]:
        raise RuntimeError(
            f"spark.checkpoint.dir must be shared: {path} has {seen} of {written.get['n']} rows"
        )
    return back


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage that nothing reads any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    conf = spark._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if "/panelcast/" in name and root.split("://", 1)[-1].removeprefix("file:") in name:
            path.getFileSystem(conf).delete(path, True)
