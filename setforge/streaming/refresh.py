"""Continuous refresh of the store: scanned rows that arrive as a stream replace what is stored under their root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from setforge.operators.store import Store


def refresh(scans: DataFrame, store: Store, root: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is a complete scan of ``root``; replacing makes a batch that is run again harmless."""

    def put(batch: DataFrame, _: int) -> None:
        store.replace_scanned(batch, root)

    return scans.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
