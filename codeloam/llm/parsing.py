"""Source files that do not parse, per file and as rates (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.llm.files import ending, whole_files
from codeloam.llm.syntax import LANGUAGES, fault

_RESULT = "project string, file string, language string, reason string, line int"


def parse_files(chunks: DataFrame) -> DataFrame:
    """``project``, ``file``, ``language``, ``reason`` and ``line``: one row for each file of a known
    ending with code; ``reason`` is null where it parses.

    Files of other endings, null and empty code have no row. Of copies of a file's row the faulty
    one counts. Each text is read whole, where it lies; only verdicts are shuffled.
    """
    names = ["project", "file", "language", "reason", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            endings = batch.column(2).to_pylist()
            found = [fault(e, s) for e, s in zip(endings, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([LANGUAGES[e][0] for e in endings], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.int32())], names=names)

    kept = whole_files(chunks).withColumn("__ending", ending(F.col("file"))).where(F.col("__ending").isin(*LANGUAGES) & (F.length("code") > 0))
    verdicts = kept.select("project", "file", "__ending", "code").mapInArrow(run, _RESULT)
    worst = F.max(F.when(F.col("reason").isNotNull(), F.struct("reason", "line")))
    return verdicts.groupBy("project", "file", "language").agg(worst.alias("x")).select("project", "file", "language", F.col("x.reason").alias("reason"), F.col("x.line").alias("line"))


def parse_rates(chunks: DataFrame) -> DataFrame:
    """``project``, ``language``, ``files``, ``invalid`` and ``rate`` of files that do not parse."""
    grouped = parse_files(chunks).groupBy("project", "language").agg(F.count("*").alias("files"), F.count("reason").alias("invalid"))
    return grouped.withColumn("rate", F.col("invalid") / F.col("files"))
