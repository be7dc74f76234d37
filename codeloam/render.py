"""Results as text: one ``line`` a row, built from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloam.functions import text as T


def _day(timestamp: Column) -> Column:
    return F.substring(T.text(timestamp), 1, 10)


def change_lines(changes: DataFrame) -> DataFrame:
    """``pos``, ``line``: short sha, day, type, title, and what it touches."""
    impact = T.render_impact(F.col("symbols"), F.col("impacts"), F.col("files"))
    return changes.select("pos", F.concat(F.substring("sha", 1, 8), F.lit("  "), _day(F.col("timestamp")), F.lit("  ["), F.col("change_type"), F.lit("] "), T.text("title"), F.when(impact != "", F.concat(F.lit(" - "), impact)).otherwise("")).alias("line"))


def result_lines(results: DataFrame) -> DataFrame:
    """``pos``, ``line``: label, symbol, type and file of a question's results."""
    return results.select("pos", F.concat(F.lit("["), T.score_label(F.col("score")), F.lit("] "), T.text("symbol"), F.lit(" ("), T.text("type"), F.lit(") "), T.text("file")).alias("line"))


def memory_lines(hits: DataFrame) -> DataFrame:
    """``line``, best first: score, source, type, title and summary of a memory question's results."""
    col = F.col
    source = T.entry_source(col("kind"), col("sha"), col("path"), col("section"))
    kind = T.entry_type(col("kind"), col("change_type"), col("doc_type"))
    return hits.select(F.concat(F.format_string("%.3f", "score"), F.lit("  "), T.text(source), F.lit("  ["), T.text(kind), F.lit("]"), F.lit("  "), T.text("title"), F.lit(": "), T.text("summary")).alias("line"))


def status_lines(status: dict[str, DataFrame]) -> DataFrame:
    """``part``, ``line`` of every section of a project's status."""
    lines = {
        "latest_change": lambda d: T.text("title"), "recent_fixes": lambda d: T.text("title"), "feature_docs": lambda d: T.text("title"), "dirty_files": lambda d: F.concat_ws(" ", "status", "path"),
        "active_topics": lambda d: F.concat_ws(" x", "topic", "n"), "change_kinds": lambda d: F.concat_ws(" x", "change_type", "n"),
    }
    out: DataFrame | None = None
    for part, rows in status.items():
        one = rows.select(F.lit(part).alias("part"), lines[part](rows).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def feature_lines(features: DataFrame) -> DataFrame:
    """``part``, ``pos``, ``line`` of a feature map."""
    return features.select("part", "pos", F.concat(T.text("title"), F.lit(": "), T.text("summary")).alias("line"))


def progress_bar(done: int, total: int, width: int = 30) -> str:
    """``[####----]  40/100``; an empty task is complete."""
    filled = width if total <= 0 else min(width, width * done // total)
    return f"[{'#' * filled}{'-' * (width - filled)}] {str(done).rjust(len(str(total)))}/{total}"
