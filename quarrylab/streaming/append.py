"""Streams into a store's table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store

#: The table in which a store keeps the batches that it has taken in.
BATCHES = "_stream_batches"


def append_stream(stream: DataFrame, store: Store, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch to the table in one transaction. A batch that a restart brings again is passed over:
    its number is written in the same transaction as its rows."""
    store.create_table(BATCHES, {"name": "TEXT PRIMARY KEY", "last_batch": "INTEGER"})
    name = f"{table}:{checkpoint}"

    def take(batch: DataFrame, number: int) -> None:
        with store.transaction():
            seen = store.select(BATCHES, ["last_batch"], "name = :name", {"name": name})
            if seen and seen[0]["last_batch"] >= number:
                return
            store.insert_many(table, batch)
            store.replace_many(BATCHES, [{"name": name, "last_batch": number}])

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
