"""Structured Streaming ingest: micro-batches appended idempotently to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ingest import dense_numbers
from tessera.plans.store import Store


def stream_into(rows: DataFrame, store: Store, checkpoint: str, once: bool = True, order: tuple[str, ...] = ()) -> StreamingQuery:
    """Append a streaming frame (vector, idempotency_key, ...) to ``store``.

    Keys are looked up in the store, not in stream state, so a key is recognised
    however long ago it came and state does not grow.  The number of a batch is
    published with its rows, so a replayed batch adds nothing, with keys or without;
    ``checkpoint`` names the stream.  ``order`` breaks ties inside a batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            by = list(order) or [c for c in ("idempotency_key", "sequence_ts") if c in batch.columns] or ["vector"]
            store.ingest(dense_numbers(batch, by, "ord"), (checkpoint, number))

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recent_duplicates_dropped(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Streaming rows without those whose key came within ``delay``: bounded state, for sources that resend soon."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of ``value`` by tumbling or sliding windows; rows later than ``late`` are dropped by the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(window, *by).agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


def chunk_numbers(rows: DataFrame, order: str, size: str, most_rows: int = 4096, most_bytes: int = 64 << 20, split: str | None = None) -> DataFrame:
    """``rows`` with the chunk that each goes to: at most ``most_rows`` rows, and as many halvings as its bytes need.

    Rows are chunked inside ``split`` (say, a source file), so no window spans a table.
    """
    inside = Window.partitionBy(split) if split else Window.partitionBy(F.floor(F.col(order) / (1 << 20)))
    placed = rows.withColumn("_n", F.row_number().over(inside.orderBy(order)) - 1).withColumn("_chunk", F.floor(F.col("_n") / most_rows))
    own = Window.partitionBy(*([split] if split else [F.floor(F.col(order) / (1 << 20))]), "_chunk")
    halvings = F.greatest(F.lit(0), F.ceil(F.log2(F.sum(size).over(own) / most_bytes)))
    return placed.withColumn("chunk", F.concat_ws(".", "_chunk", F.floor(F.pmod(F.col("_n"), F.lit(most_rows)) * F.pow(F.lit(2.0), halvings) / most_rows))).drop("_n", "_chunk")
