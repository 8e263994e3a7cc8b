"""Small helpers that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.sources import scratch
from foliomill.sources.scratch import dropped  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def unit_hash(*parts: Column | str, bits: int = 52) -> Column:
    """A long in [0, 2**bits) from the MD5 of the parts; the same in every engine and partitioning."""
    cols = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *cols)), 1, bits // 4)
    return F.conv(digits, 16, 10).cast("long")


def id_bucket(id_col: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text, modulo buckets; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % buckets


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    On a cluster `spark.checkpoint.dir` names a folder that the driver and all executors see. Only on one
    machine (tests), and if the setting is absent, does /tmp serve.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/foliomill-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    path = f"{folder}/{name}"
    with scratch.frugal(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, folder: str, name: str, key: str) -> DataFrame:
    """As `saved`, in buckets of the key: joins on it need no exchange of this table."""
    with scratch.frugal(df.sparkSession):
        return scratch.saved_by(df, folder, name, key)


def exploded(df: DataFrame) -> DataFrame:
    """df, never to be broadcast: Spark sizes rows of an exploded list as if each list had one element, and
    columns of repeated values by their files; so it may send far more through the driver than it expects."""
    return df.hint("merge")


def at_most(df: DataFrame, rows: int) -> bool:
    """True if df has no more than so many rows; looks at no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows
