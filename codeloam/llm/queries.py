"""Queries of the eight problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.llm.neighbours import similar_pairs, similar_vectors
from codeloam.llm.packing import pack_documents
from codeloam.llm.parsing import parse_files, parse_rates
from codeloam.llm.provenance import judge_files
from codeloam.llm.secrets import find_credentials, redact_credentials
from codeloam.llm.spam_pages import spam_shares
from codeloam.llm.splitting import split_oversized
from codeloam.llm.tokenizer import encode_corpus
from codeloam.session import load

Query = Callable[[SparkSession, str], DataFrame]


def _limit(spark: SparkSession, sf_dir: str, kind: str) -> tuple[int, int]:
    """(max_size, overlap) of one kind of item; the aggregate is a single row."""
    row = load(spark, sf_dir, "size_limits").where(F.col("item_kind") == kind).agg(F.min("max_size"), F.max("overlap")).first()
    if row[0] is None:
        raise ValueError(f"size_limits has no row for {kind}")
    return int(row[0]), int(row[1] or 0)


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(load(spark, sf_dir, "chunk_vectors"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(load(spark, sf_dir, "chunk_vectors"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(load(spark, sf_dir, "code_chunks")).select("chunk_row", "line_no").distinct()


def p2_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(load(spark, sf_dir, "code_chunks"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_credentials(load(spark, sf_dir, "code_chunks"))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_files(load(spark, sf_dir, "code_chunks"), load(spark, sf_dir, "library_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_files(spark, sf_dir).where(F.col("class").isNotNull()).select("project", "file")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = split_oversized(load(spark, sf_dir, "code_chunks"), "chunk_row", "code", "code", *_limit(spark, sf_dir, "code"))
    body = split_oversized(load(spark, sf_dir, "document_entries"), "entry_row", "body", "body", *_limit(spark, sf_dir, "body"))
    return code.unionByName(body)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where("piece_no = 0 AND n_pieces > 1").select("item_kind", "item_row")


P4_FOUND_SQL = """
SELECT 'code' AS item_kind, chunk_row AS item_row FROM code_chunks
WHERE length(code) > (SELECT max_size FROM size_limits WHERE item_kind = 'code')
UNION ALL
SELECT 'body', entry_row FROM document_entries
WHERE length(body) > (SELECT max_size FROM size_limits WHERE item_kind = 'body')
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(load(spark, sf_dir, "code_chunks")).where(F.col("reason").isNotNull()).select("project", "file")


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(load(spark, sf_dir, "code_chunks"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rates(load(spark, sf_dir, "code_chunks"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), _limit(spark, sf_dir, "container")[0])


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers used, the least possible number, tokens, and the share of space used."""
    capacity = _limit(spark, sf_dir, "container")[0]
    packed = pack_documents(load(spark, sf_dir, "documents"), capacity)
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.select("containers", F.ceil(F.col("tokens") / capacity).alias("least"), "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_shares(load(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).where(F.col("spam") > 0.5).select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_credentials, p2_redacted, p3_found, p3_files, p4_found, p4_pieces, p5_found, p5_files, p5_rates, p6_ids, p7_containers, p7_fill, p8_found, p8_shares)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND_SQL}
