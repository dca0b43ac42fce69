"""Sorted runs from a stream: every micro-batch becomes one run for each range, to be merged later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators import partitioning


def write_runs(stream: DataFrame, path: str, ends: list[bytes], checkpoint: str, **trigger) -> StreamingQuery:
    """Parquet runs below ``path/batch=<n>``, in files by range and sorted; a repeated batch replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        assigned = batch.withColumn("pid", partitioning.assign(batch["key"], ends))
        ordered = partitioning.exchange(assigned, len(ends)).sortWithinPartitions("key", "value")
        ordered.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
