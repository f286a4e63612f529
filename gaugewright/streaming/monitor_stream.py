"""Monitoring of a stream: each micro-batch is one monitored batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from gaugewright.operators.monitor import MonitoringBaseline, MonitoringResult, monitor_batch


def monitor_stream(stream: DataFrame, baseline: MonitoringBaseline, sink: Callable[[MonitoringResult], None], **how) -> DataStreamWriter:
    """A writer that monitors each micro-batch and hands the result to ``sink``; empty ones are passed over.

    Batch ids are the stream's, so a batch that is tried again has the same id.
    """

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            if held.limit(1).count():
                sink(monitor_batch(baseline, held, batch_id=f"batch-{number}", **how))
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(one)
