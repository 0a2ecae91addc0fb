"""Keyed saving of posts or comments as they land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from narrata.sinks.keyed import insert_or_ignore


def land(stream: DataFrame, path: str, key: str, order: list[Column], checkpoint: str) -> StreamingQuery:
    """Insert-or-ignore every micro-batch into the table at ``path``; stops when caught up.

    A batch that is run again after a failure adds nothing: its keys are stored.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, _: insert_or_ignore(batch, path, key, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
