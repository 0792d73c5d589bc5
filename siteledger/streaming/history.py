"""History kept by a stream: by a look into the whole history for each micro-batch, or by state that expires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from siteledger.sources.versions import append_once


def keep(snapshots: DataFrame, path: str, key: str, order: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each batch's new keys to the history at path. A batch that is run again appends nothing."""
    return snapshots.writeStream.foreachBatch(lambda batch, _: append_once(batch, path, key, order)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_with_state(snapshots: DataFrame, path: str, key: str, time: str, within: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the first row of each key to the files at path; keys that come again within the given time are known by the state store.

    A batch costs its own rows alone: history isn't read. A key's state ends once event time has passed by `within`, so state is as large as that
    span, not as history; rows later than that are dropped, as they could double what has been forgotten. The file sink and the
    checkpoint make a restart go on without loss or doubles. Null times are dropped.
    """
    first = snapshots.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return first.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
