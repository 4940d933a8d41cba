"""Small helpers that every operator shares: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from netloom.functions.errors import Failure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a local one is set only in a local session that names none (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local") or not named and sc.master.startswith("local-cluster"):
            raise Failure("DirectoryNotFound", "Executors on several machines need a shared folder: set spark.checkpoint.dir.")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="netloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs nothing but a read."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, for what is read several times and is large; lineage is cut as by `cut`."""
    path = f"{checkpoint_folder(df.sparkSession)}/netloom-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
