"""Arriving records, matched as they come: Structured Streaming, a batch of normalized records at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkwright.operators import blocking
from linkwright.operators.normalize import entities_normalized


def match_stream(records: DataFrame, s1: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Exact candidates between a stream of target records and normalized s1; sink gets (pairs, batch id), the same pairs if a batch is repeated."""

    def each(batch: DataFrame, number: int) -> None:
        targets = entities_normalized(batch).persist()
        try:
            sink(blocking.exact_union(s1, targets), number)
        finally:
            targets.unpersist()

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
