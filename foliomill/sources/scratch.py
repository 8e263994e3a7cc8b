"""A place for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/foliomill-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Shuffle files of a finished query are of no use; Spark can drop them at once rather than with its garbage. Rows that lie together by some of a
#: join's keys need no further exchange.
_WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in _WHILE_SAVING}
    for key, value in _WHILE_SAVING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df to a shared folder and read it back: its lineage ends there, and lost executors cost a stage at most."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """As `saved`, in buckets of the key: windows and groups within the key need no exchange when the table is read.

    The table leaves the catalogue at once; its files stay with the frame.
    """
    spark, table = df.sparkSession, f"foliomill_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").saveAsTable(table)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return held


def dropped(spark: SparkSession, folder: str, name: str) -> None:
    """Remove a table that `saved` has written, once no frame that is still to be computed reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
