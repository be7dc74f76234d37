"""Orders with explicit ties, first rows per key, and the greedy size budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; a rank limit, so at most ``n`` a key leave each task."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def greedy_budget(results: DataFrame, key: str, size: str, order: str, budget: int = 12_000) -> DataFrame:
    """Walks all results of each key in order and keeps each that still fits into ``budget``; one that
    does not fit is skipped and the walk goes on. Adds ``used``, the size so far.

    One sorted pass over keys, orders and sizes: a walk's state is its running total, so a key may
    have any number of results. Null sizes count as 0; ties in order are broken by size.
    """
    kind = dict(results.dtypes)[key]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = object(), 0
        for batch in batches:
            kept, used = [], []
            for i, (k, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if k != at:
                    at, total = k, 0
                if total + s <= budget:
                    total += s
                    kept.append(i)
                    used.append(total)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(used, pa.int64())], names=[key, order, "used"])

    listed = results.select(key, F.col(order).cast("long").alias(order), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    return listed.repartition(key).sortWithinPartitions(key, order, "__size").mapInArrow(walk, f"`{key}` {kind}, `{order}` bigint, used bigint")
