"""Redaction of a document stream with Structured Streaming.

Each micro-batch is one "run" of the batch job: the mapping table is read,
the batch is redacted, and its rows and only its *new* mapping rows are written
under ``batch_id=N`` of the output and of the mapping table.  New ids continue
above the largest one, so rows written by earlier batches never change and the
same original keeps its fake across batches.  A batch that runs again reads the
mapping of the batches before it and overwrites its own folders, so a replay
leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import MAPPING_SCHEMA
from ..operators.redact import Config, redact_documents


def _read_mapping(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Mapping rows of the batches before ``before``; None if there is none."""
    from ..sources.mapping_io import _path_exists
    if not before or not _path_exists(spark, path):
        return None
    return spark.read.schema(MAPPING_SCHEMA + ", batch_id bigint").parquet(path).where(F.col("batch_id") < before).drop("batch_id")


def redact_batch(batch: DataFrame, batch_id: int, output_path: str, mapping_path: str,
                 config: Config = Config()) -> None:
    spark = batch.sparkSession
    res = redact_documents(batch, mapping=_read_mapping(spark, mapping_path, batch_id), config=config)
    res.output.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")
    res.new_mapping.write.mode("overwrite").parquet(f"{mapping_path}/batch_id={batch_id}")


def start_redaction_stream(stream: DataFrame, output_path: str, mapping_path: str, checkpoint: str,
                           config: Config = Config(), trigger_seconds: int | None = None,
                           available_now: bool = False):
    """Start a query redacting ``stream`` (``doc_id``, ``text``, ...) batch by batch."""
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: redact_batch(df, bid, output_path, mapping_path, config))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
