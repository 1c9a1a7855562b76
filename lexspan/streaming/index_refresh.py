"""Incremental refresh of the chunk index from a stream of finished lectures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexspan.operators.catalog import write_replacing


def refresh_index(
    lectures: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, partition: str = "lecture_id",
    **trigger,
) -> StreamingQuery:
    """Rebuild the index documents of every lecture in each micro-batch.

    ``lectures`` is a stream whose rows name a changed lecture in ``partition``;
    ``build`` turns those keys into the lecture's documents. Each batch replaces
    exactly what is stored under its keys, so a replayed batch after a failure changes nothing,
    and a lecture whose rebuild is empty has no documents left. Read with ``read_stored``.
    """

    def apply(batch: DataFrame, _epoch: int) -> None:
        keys = batch.select(F.col(partition)).distinct()
        write_replacing(build(keys), keys, path, partition)

    return lectures.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()
