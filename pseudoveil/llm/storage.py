"""Written intermediate tables and connected components.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` (the folder a
cluster shares), so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def one_column(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, resolved by position so that extra columns cannot clash."""
    return docs.select(*[docs[c] for c in cols])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component), the
    component being its smallest node.

    Alternating large-star and small-star steps: every step is a grouped
    minimum (combined before the shuffle) and a join, so a node with very many
    neighbours is never gathered in one place.  Nodes without an edge are not
    returned.  Each round is written out; the loop ends when nothing changes.
    """
    def signature(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def links(df):
        return written(df.where("a <> b").distinct(), "links")

    e = links(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    seen = signature(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        e = links(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = links(e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .union(low.select("a", F.col("m").alias("b"))))
        now = signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select("b", "b")).distinct()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that have been
    written and are no longer referenced (it acts on the driver's garbage)."""
    for _ in range(2):          # the second pass finds what the first one made unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
