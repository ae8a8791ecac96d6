"""Session helpers for local runs and tests (a cluster brings its own session)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pseudoveil") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PSEUDOVEIL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: the cluster's
    ``spark.checkpoint.dir`` if set, else (tests, local runs) a scratch folder
    that is kept for the life of the session.  On a cluster a machine's own folder
    would lose rows, so there the setting is required."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(given)
        return given
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pseudoveil-ckpt-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage
    with one computation (an RDD checkpoint would compute it twice)."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, few: int = 2_000, many: int = 20_000) -> DataFrame:
    """``df`` in tasks of ``few`` to ``many`` rows, all cores busy: for short rows that each take long.

    A scan's tasks go by bytes and by row groups, so a million short rows may come in one."""
    rows = df.count()
    tasks = min(-(-rows // few), max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // many)))
    return df.repartition(max(tasks, 1))


def evened(df: DataFrame, many: int = 100_000) -> DataFrame:
    """``df`` as it comes, unless a task of it has more than ``many`` rows (few large row groups): then spread."""
    most = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    return df if (most or 0) <= many else spread(df)
