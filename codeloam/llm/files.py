"""Which rows of a chunk table hold a whole file, and what its name tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ending(file: Column) -> Column:
    """Lower-cased part after the last dot of the last path segment; either separator."""
    return F.lower(F.regexp_extract(file, r"\.([^./\\]+)$", 1))


def whole_files(chunks: DataFrame) -> DataFrame:
    """Rows of whole files: ``type`` is file in any case, or the symbol or the id is that of a file.

    Only ``project``, ``file``, ``type``, ``symbol``, ``id`` and ``code`` are looked at; rows sent
    twice are all kept.
    """
    by_id = F.col("id") == F.substring(F.sha2(F.concat("file", F.lit("::<file>")), 256), 1, 32)
    untyped = F.col("type").isNull() & ((F.col("symbol") == F.col("file")) | by_id)
    return chunks.where(F.col("file").isNotNull() & F.coalesce((F.lower("type") == "file") | untyped, F.lit(False)))
