"""Snapshot differences: what is stale, orphaned, not yet embedded, reused or new.

All are semi and anti joins on ids. Null ids are no ids: they are dropped before a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build_manifest(chunks: DataFrame) -> DataFrame:
    """``project``, ``file``, ``mtime_ms`` (of the file's first row), sorted distinct ``chunk_ids``."""
    return chunks.where("file IS NOT NULL AND id IS NOT NULL").groupBy("project", "file").agg(F.min_by("mtime_ms", F.when(F.col("mtime_ms").isNotNull(), F.col("chunk_row"))).alias("mtime_ms"), F.array_sort(F.collect_set("id")).alias("chunk_ids"))


def stale_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk ids of files that are gone or whose mtime differs: ``project``, ``file``, ``chunk_id``, ``reason``.

    An old row without mtime is stale only if its file is gone.
    """
    o, n = old.where("file IS NOT NULL"), new.select("project", "file", F.col("mtime_ms").alias("new_mtime"), F.lit(True).alias("there")).dropDuplicates(["project", "file"])
    j = o.join(n, ["project", "file"], "left")
    reason = F.when(F.col("there").isNull(), "gone").when(F.col("mtime_ms").isNotNull() & ~F.col("mtime_ms").eqNullSafe(F.col("new_mtime")), "changed")
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select("project", "file", F.explode("chunk_ids").alias("chunk_id"), "reason").where("chunk_id IS NOT NULL").distinct()


def orphan_ids(stored: DataFrame, known: DataFrame, stored_id: str = "id", known_id: str = "id") -> DataFrame:
    """Distinct stored ids that nothing knows."""
    return stored.select("project", F.col(stored_id).alias("id")).where("id IS NOT NULL").join(known.select("project", F.col(known_id).alias("id")), ["project", "id"], "left_anti").distinct()


def uncached(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector; of equal ids the last row (largest ``chunk_row``) stands."""
    newest = chunks.where("id IS NOT NULL").groupBy("project", "id").agg(F.max("chunk_row").alias("chunk_row"))
    return newest.join(vectors.select("project", "id"), ["project", "id"], "left_anti")


def reuse_or_build(commits: DataFrame, previous: DataFrame) -> DataFrame:
    """Commits with ``action``: reuse where an entry of the same sha exists, else build."""
    seen = previous.select("project", "sha").distinct().withColumn("__seen", F.lit(True))
    return commits.join(seen, ["project", "sha"], "left").withColumn("action", F.when(F.col("__seen"), "reuse").otherwise("build")).drop("__seen")


def entry_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """``project``, ``id``, ``change``: stale ids of ``old`` only, added ids of ``new`` only."""
    keys = ["project", "id"]
    o, n = (d.select(*keys).where("id IS NOT NULL").distinct() for d in (old, new))
    return o.join(n, keys, "left_anti").withColumn("change", F.lit("stale")).unionByName(n.join(o, keys, "left_anti").withColumn("change", F.lit("added")))


def history_window(changes: DataFrame, depth: int | str = 150) -> DataFrame:
    """The newest ``depth`` changes of each project (or as many as a column of that name says). A row
    limit by rank, so each task passes on at most that many a project."""
    w = Window.partitionBy("project").orderBy(F.col("at").desc(), "id")
    return changes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (F.col(depth) if isinstance(depth, str) else F.lit(depth)))


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with ``rows`` put in place of rows of the same keys."""
    return stored.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(stored: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(ids.select(*keys), keys, "left_anti")
