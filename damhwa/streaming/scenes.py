"""Hints over a stream of whole scenes.

A scene's hints need all of its lines, so a micro-batch must hold scenes whole: items come as one row a scene with its
lines in an array. Every batch then goes through the same transforms as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def explode_items(stream: DataFrame, lines: str = "lines") -> DataFrame:
    """items(scene_id, item_idx, item) of rows (scene_id, lines array<string>)."""
    return stream.select("scene_id", F.posexplode(lines).alias("item_idx", "item"))


def review(stream: DataFrame, transform: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """transform(items, scenes) on each micro-batch, its result to sink(df, batch id), which must be idempotent by batch id."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        sink(transform(explode_items(batch), batch.drop("lines")), number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
