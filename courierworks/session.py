"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "courierworks", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; `conf` overrides any setting.

    On a cluster `master` stays None and the submit command decides.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on, applied to a session somebody else built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir`.

    Only a session on one machine may leave it unset; it then gets a folder of its own there, which goes when the session ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="courierworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _removed_at_exit(spark, folder)
    return folder


def _removed_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove `path` when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _removed_at_exit(spark, path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write a table that several passes read to the shared folder, and read it back.

    Unlike a cache it survives lost executors, and later passes read only the columns they need.
    """
    path = new_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
