"""Keeping a chunk table up to date from a stream of chunk rows.

The data model has no event-time operators; what it has is incremental sync. Here that sync runs as a
stream: rows arrive, each micro-batch is merged by key, and a running count per project is kept with a
watermark on the time a row was sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloam.operators.incremental import upsert
from codeloam.sources.store import Store


def newest_rows(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one with the largest ``order`` (a null is smallest)."""
    rest = [c for c in batch.columns if c not in keys]
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(order), F.lit(-1))).alias("x"))
    return newest.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest)).select(*batch.columns)


def sync_chunks(stream: DataFrame, store: Store, checkpoint: str, table: str = "chunks", keys: tuple[str, ...] = ("project", "id"), order: str = "chunk_row") -> StreamingQuery:
    """Merges a stream of chunk rows into a table, newest row of each key, batch by batch. A batch that
    is replayed after a failure gives the same table."""

    def merge(batch: DataFrame, _: int) -> None:
        new = newest_rows(batch, list(keys), order)
        if (stored := store.read_or_none(table)) is not None:
            newer = stored.select(*keys, F.col(order).alias("__had"))
            new = new.join(newer, list(keys), "left").where(F.col("__had").isNull() | (F.col(order) >= F.col("__had"))).drop("__had")
            new = upsert(stored, new, list(keys))
        store.write(table, new)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(stream: DataFrame, lateness: str = "30 days", window: str = "7 days") -> DataFrame:
    """Chunk rows per project and window of ``synced_at``; rows later than the watermark are left out."""
    timed = stream.withColumn("synced_at", F.col("synced_at").cast("timestamp")).withWatermark("synced_at", lateness)
    return timed.groupBy("project", F.window("synced_at", window).alias("w")).agg(F.count("*").alias("rows")).select("project", F.col("w.start").alias("start"), "rows")
