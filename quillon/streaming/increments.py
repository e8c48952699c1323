"""Structured Streaming into a rule engine: each micro-batch is inserted and its consequences derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.plans.engine import Engine


def feed(stream: DataFrame, engine: Engine, relation: str, checkpoint: str, after: Callable[[Engine, int], None] | None = None) -> StreamingQuery:
    """Start a query that keeps the engine's relations up to date with the stream. Rows that come again change nothing, so a replayed batch is harmless."""

    def batch(rows: DataFrame, number: int) -> None:
        engine.insert(relation, rows, written=True)
        engine.run_incremental()
        if after:
            after(engine, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
