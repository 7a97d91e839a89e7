"""Squeezing a stream of documents: they don't depend on one another, so each micro-batch is a batch job of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.squeeze import squeeze


def squeeze_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, budget: int, **options: object) -> StreamingQuery:
    """Starts a query that hands each squeezed micro-batch and its number to ``sink``; no state, exact results."""
    work = lambda batch, n: sink(squeeze(batch, budget, **options), n)
    return docs.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
