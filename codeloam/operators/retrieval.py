"""Answering a question over chunks: symbols, related chunks, file names, and the size budget."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloam.functions.text import question_tokens, utf16_length, uuid_form
from codeloam.operators.graph import retrieval_expand
from codeloam.operators.ordering import first_per_key, greedy_budget
from codeloam.session import materialise


def with_point(chunks: DataFrame) -> DataFrame:
    """Adds ``point_id``, the order in which stored chunks are read."""
    return chunks.withColumn("point_id", uuid_form(F.col("id")))


def get_symbols(chunks: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """First ``most`` chunks of each project whose symbol is wanted ``(project, symbol)``."""
    hit = with_point(chunks).join(wanted.select("project", "symbol").distinct(), ["project", "symbol"], "left_semi")
    return first_per_key(hit, ["project"], "point_id", "chunk_row", n=most)


def missing_symbols(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("project", "symbol").distinct().join(chunks.select("project", "symbol"), ["project", "symbol"], "left_anti")


def symbol_files(definitions: DataFrame) -> DataFrame:
    """``project``, ``symbol``, ``file``: where each symbol is defined; the last definition wins, PHP files
    being read after the others, each kind in order of path."""
    visited = F.struct(F.lower("file").endswith(".php"), "file", "def_ord")
    return definitions.where("symbol IS NOT NULL AND file IS NOT NULL").groupBy("project", "symbol").agg(F.max_by("file", visited).alias("file"))


def first_chunk_per_symbol(chunks: DataFrame, symbols: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """One row for each symbol: its first chunk; where there is none, type ``unknown`` and the file of
    ``defined`` (``symbol_files``), else ``?``."""
    first = with_point(chunks).where("symbol IS NOT NULL").groupBy("project", "symbol").agg(F.min_by(F.struct("file", "type", "chunk_row"), F.struct("point_id", "chunk_row")).alias("c"))
    joined = symbols.select("project", "symbol").distinct().join(first, ["project", "symbol"], "left")
    known = F.lit(None).cast("string")
    if defined is not None:
        joined = joined.join(defined.select("project", "symbol", F.col("file").alias("defined_in")), ["project", "symbol"], "left")
        known = F.col("defined_in")
    return joined.select("project", "symbol", F.coalesce("c.file", known, F.lit("?")).alias("file"), F.coalesce("c.type", F.lit("unknown")).alias("type"), F.col("c.chunk_row").alias("chunk_row"))


def related_chunks(chunks: DataFrame, related: DataFrame, results: DataFrame, most: int = 20) -> DataFrame:
    """Chunks of related symbols: the first ``most`` points of each project are taken before repeats
    are dropped, then the first chunk of each symbol that is not among the results yet."""
    taken = get_symbols(chunks, related, most)
    return first_per_key(taken, ["project", "symbol"], "point_id", "chunk_row").join(results.select("project", "symbol").distinct(), ["project", "symbol"], "left_anti")


def file_token_matches(chunks: DataFrame, question: str, most: int = 200) -> DataFrame:
    """Whole-file chunks whose path holds a token of the question, as first results: ``pos`` is
    negative, the last one read first. A question without tokens gives no rows."""
    tokens = question_tokens(question)
    if not tokens:
        return with_point(chunks).where(F.lit(False)).withColumn("pos", F.lit(0))
    hit = with_point(chunks).where((F.col("type") == "file") & reduce(or_, (F.contains(F.col("file"), F.lit(t)) for t in tokens)))
    w = Window.partitionBy("project").orderBy("point_id", "chunk_row")
    return hit.withColumn("pos", -F.row_number().over(w)).where(F.col("pos") >= -most)


def query_project(chunks: DataFrame, edges: DataFrame, hits: DataFrame, question: str) -> DataFrame:
    """Results for a question, in order (``pos``): file-name matches first, then the ``hits``
    ``(project, chunk_row, score)`` by score, then related chunks; cut to the size budget."""
    direct = with_point(chunks).join(hits, ["project", "chunk_row"])
    w = Window.partitionBy("project").orderBy(F.col("score").desc(), "chunk_row")
    direct = materialise(direct.withColumn("pos", F.row_number().over(w).cast("long")))  # a few rows a project, read five times
    related = related_chunks(chunks, retrieval_expand(edges, direct), direct)
    rw = Window.partitionBy("project").orderBy("point_id", "chunk_row")
    related = related.withColumn("score", F.lit(0.0)).withColumn("pos", F.row_number().over(rw) + F.lit(1000).cast("long"))
    found = direct.unionByName(related, allowMissingColumns=True)
    names = file_token_matches(chunks, question).join(found.select("project", "symbol").distinct(), ["project", "symbol"], "left_anti")
    names = first_per_key(names, ["project", "symbol"], F.col("pos").desc()).withColumn("score", F.lit(0.0)).withColumn("pos", F.col("pos").cast("long"))
    every = materialise(found.unionByName(names, allowMissingColumns=True).withColumn("size", utf16_length(F.col("code"))))
    kept = greedy_budget(every, "project", "size", "pos")
    return every.join(kept, ["project", "pos"])
