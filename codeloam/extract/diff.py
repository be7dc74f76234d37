"""Unified diffs and commit logs as tables, parsed with SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloam.functions.text import HUNK, diff_path, hunk

FIELD, RECORD = "\x1f", "\x1e"


def parse_commits(log: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Commits of a log text whose fields end with 0x1f and records with 0x1e: ``log_pos``, ``sha``,
    ``parents``, ``author_name``, ``author_email``, ``timestamp``, ``title``, ``body``. Records without
    a sha are none; a missing body is empty."""
    records = log.select(*keys, F.posexplode(F.split(F.col(text), RECORD)).alias("log_pos", "r"))
    f = F.split(F.regexp_replace("r", r"^\s+", ""), FIELD)
    field = lambda i: F.coalesce(F.get(f, i), F.lit(""))
    parents = F.filter(F.split(F.trim(field(1)), " "), lambda p: p != "")
    return records.select(*keys, "log_pos", F.trim(field(0)).alias("sha"), parents.alias("parents"), field(2).alias("author_name"), field(3).alias("author_email"), field(4).alias("timestamp"), field(5).alias("title"), F.regexp_replace(field(6), r"(?U)^\s+|\s+$", "").alias("body")).where("sha <> ''")


def parse_patches(diffs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """File patches of unified diffs: ``file_no``, ``path``, ``old_path``, ``status`` (A, M, D, R) and
    ``hunks``. Header lines count only before a file's first hunk, so a removed line that begins
    with ``-- `` is no header. Null and empty diffs give no rows."""
    w = Window.partitionBy(*keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = diffs.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("__pos", "__line"))
    numbered = lines.withColumn("file_no", F.sum(F.col("__line").startswith("diff --git ").cast("int")).over(w)).where("file_no > 0")
    fw = Window.partitionBy(*keys, "file_no").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = numbered.withColumn("__is_hunk", F.col("__line").rlike(HUNK)).withColumn("__hunks_so_far", F.sum(F.col("__is_hunk").cast("int")).over(fw))
    head = F.col("__hunks_so_far") == 0
    last = lambda cond, value: F.max_by(value, F.when(head & cond, F.col("__pos")))
    line = F.col("__line")
    old = last(line.startswith("--- ") & ~line.startswith("--- /dev/null"), diff_path(F.substring(line, 5, 1_000_000)))
    new = last(line.startswith("+++ ") & ~line.startswith("+++ /dev/null"), diff_path(F.substring(line, 5, 1_000_000)))
    rename_from = last(line.startswith("rename from "), F.substring(line, 13, 1_000_000))
    rename_to = last(line.startswith("rename to "), F.substring(line, 11, 1_000_000))
    named = last(line.startswith("diff --git "), diff_path(F.regexp_extract(line, r'^diff --git .* ("?b/.*)$', 1)))
    grouped = marked.groupBy(*keys, "file_no").agg(
        old.alias("__old"), new.alias("__new"), rename_from.alias("__from"), rename_to.alias("__to"), named.alias("__named"),
        F.max(head & line.startswith("new file mode")).alias("__added"), F.max(head & line.startswith("deleted file mode")).alias("__deleted"),
        F.array_sort(F.collect_list(F.when(F.col("__is_hunk"), F.struct("__pos", hunk(line).alias("h"))))).alias("__hunks"),
    )
    status = F.when(F.col("__added"), "A").when(F.col("__deleted"), "D").when(F.col("__from").isNotNull(), "R").otherwise("M")
    path = F.when(F.col("__deleted"), F.coalesce("__old", "__named")).otherwise(F.coalesce("__to", "__new", "__named", "__old"))
    return grouped.select(*keys, "file_no", path.alias("path"), F.coalesce("__from", F.when(F.col("__old") != path, F.col("__old"))).alias("old_path"), status.alias("status"), F.transform("__hunks", lambda x: x["h"]).alias("hunks"))


def parse_status(lines: DataFrame, text: str) -> DataFrame:
    """Working-tree rows of a short status listing: ``path`` and ``status`` (``??`` where blank); of a
    rename the new path."""
    mark = F.trim(F.substring(text, 1, 2))
    return lines.where(F.length(text) > 3).select(F.substring_index(F.substring(text, 4, 1_000_000), " -> ", -1).alias("path"), F.when(mark == "", "??").otherwise(mark).alias("status"))
