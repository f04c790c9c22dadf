"""Incremental ingestion: new files are processed once; the stream's checkpoint takes the place of a list of processed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Starts a run over what is new in `folder`; every batch is processed and appended to `out`; ends when nothing is left."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(folder)
    write = lambda batch, _: process(batch).write.mode("append").parquet(out)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
