"""A stream of rows merged into a column group, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.write import write


def merge_stream(stream: DataFrame, root: str, name: str, group: str = "index", *, checkpoint: str, **trigger):
    """Starts a query that merges each micro-batch by key; merging one again after a failure changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            write(batch, root, name, group, merge=True)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
