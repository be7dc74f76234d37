"""Which symbols a change touches: interval overlap within a file, and pruning of parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines per bucket of the overlap join, and buckets up to which an interval is cut.
BUCKET, MOST_BUCKETS = 64, 1024


def touched_symbols(ranges: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``ranges(keys, start_line, end_line, ...)`` that a row of ``hunks(keys, start, end)``
    overlaps (closed intervals), each once. Rows with a null or reversed interval overlap nothing.

    Both sides are cut into line buckets and joined on (keys, place), so a long file does not meet
    all of its hunks in one place. An interval of more than ``MOST_BUCKETS`` buckets is not cut (a range
    to line 10^9 is one row); it meets all intervals of the other side, by ways of their own: 0 cut with
    cut, 1 long range with any hunk, 2 cut range with long hunk. So cut intervals never meet each other
    on such a way. The semi join returns a range at most once a bucket.
    """

    def cut(d: DataFrame, a: str, b: str, long_ways: tuple[int, ...], cut_way: int) -> DataFrame:
        first, last = F.floor(F.col(a) / BUCKET).cast("long"), F.floor(F.col(b) / BUCKET).cast("long")
        way = lambda n: F.lit((1 << 60) + n)  # a place that no bucket has
        places = F.when(last - first >= MOST_BUCKETS, F.array(*map(way, long_ways))).otherwise(F.concat(F.sequence(first, last), F.array(way(cut_way))))
        return d.where(F.col(a) <= F.col(b)).withColumn("__at", F.explode(places))

    h = cut(hunks.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("start").alias("__start"), F.col("end").alias("__end")), "__start", "__end", (1, 2), 1)
    h = h.withColumnRenamed("__at", "__there")
    r = cut(ranges.withColumn("__row", F.monotonically_increasing_id()), "start_line", "end_line", (1,), 2)
    on = (F.col("__at") == F.col("__there")) & (F.col("start_line") <= F.col("__end")) & (F.col("__start") <= F.col("end_line"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return r.join(h, on, "left_semi").dropDuplicates([*keys, "__row"]).drop("__row", "__at")


def prune_parents(symbols: Column) -> Column:
    """Of an array of touched symbols those that are no prefix, up to ``.`` or ``::``, of another."""
    return F.filter(symbols, lambda s: ~F.exists(symbols, lambda o: F.startswith(o, F.concat(s, F.lit("."))) | F.startswith(o, F.concat(s, F.lit("::")))))


def revision(sha: Column, parents: Column, path: Column, old_path: Column, old_side: Column) -> Column:
    """(revision, path) to read: the first parent's old file if the old side is wanted and there is a
    parent, else the commit's own."""
    old = old_side & (F.size(F.coalesce(parents, F.array().cast("array<string>"))) > 0)
    return F.struct(F.when(old, F.get(parents, 0)).otherwise(sha).alias("revision"), F.when(old, F.coalesce(old_path, path)).otherwise(path).alias("path"))
