"""Facts that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..facts import Fact


def store_stream(engine: Engine, kind: type[Fact], rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Store a streaming table of (subject, object) rows, a micro-batch at a time.

    Storing is idempotent, so a batch that is run again after a failure changes nothing: each fact is stored once.
    """

    def store(batch: DataFrame, _: int) -> None:
        engine.store_rows(kind, batch)

    writer = rows.select("subject", "object").writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
