"""Validation of streams: the batch plan, unchanged, in append mode and without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Result


def failures_of(result: Result, *keys: str) -> DataFrame:
    """Failures of a streaming result; time rules use the time of each micro-batch."""
    return result.failures(*keys)


def run_to_tables(result: Result, valid_path: str, failures_path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Write each micro-batch's valid rows and failures; a replayed batch overwrites its own files, so both sinks hold each row once."""

    def write(batch: DataFrame, number: int) -> None:
        once = Result(batch)
        once.valid.write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        once.failures(*keys).write.mode("overwrite").parquet(f"{failures_path}/batch={number}")

    return result.annotated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
