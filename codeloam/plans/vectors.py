"""Vector queries, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.functions import constants as K
from codeloam.functions import text as T
from codeloam.operators import memory, vectors
from codeloam.operators.ordering import greedy_budget
from codeloam.plans.history import AS_OF, IS_FEATURE
from codeloam.plans.registry import query
from codeloam.session import load

QUESTION = "what does the fix for the vector index change"


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, cosine FROM (SELECT query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank
FROM q, embeddings v) WHERE rank <= 5"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return vectors.exact_search(e.where("vec_id % 50 = 0"), e, 5, 64).withColumn("cosine", F.round("cosine", 6))


@query(
    """WITH u AS (SELECT vec_id, vector::DOUBLE[] AS e FROM chunk_vectors WHERE len(vector) = 384 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, cosine FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 12) DESC, v.vec_id) AS rank
FROM u q, u v WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""
)
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest chunks of every fiftieth chunk vector, exactly."""
    v = load(spark, sf_dir, "chunk_vectors")
    return vectors.exact_search(v.where("vec_id % 50 = 0"), v, 5, K.VECTOR_DIMS, vector="vector").withColumn("cosine", F.round("cosine", 6))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the similarity of their vector to the first one's. Memory vectors are no test
    table, so an entry's vector is the embedding whose id is the entry's row."""
    docs = load(spark, sf_dir, "document_entries").withColumn("vec_id", F.col("entry_row"))
    e = load(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    wanted = first.withColumn("one", F.lit(1))
    scored = e.withColumn("one", F.lit(1)).join(F.broadcast(wanted), "one").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 9).alias("cosine"))
    return docs.join(scored, "vec_id").withColumn("at", memory.instant(F.col("timestamp"))).withColumn("hit_pos", F.col("entry_row"))


RERANK = f"""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 1),
h AS (SELECT d.*, round(list_cosine_similarity(q.e, v.embedding::DOUBLE[]), 9) AS cosine, try_cast(timestamp AS TIMESTAMPTZ) AS moment FROM document_entries d JOIN embeddings v ON v.vec_id = d.entry_row, q),
s AS (SELECT entry_row, project, length(body) AS size, {K.COSINE_WEIGHT} * cosine + {K.FRESHNESS_WEIGHT} * greatest({K.DOCUMENT_FLOOR}, 1 - greatest(0, (epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(moment)) / 86400e6) / {K.DOCUMENT_DAYS})
 + {K.DOCUMENT_BONUS} + CASE WHEN {IS_FEATURE} THEN {K.FACT_BONUS} ELSE 0 END AS score FROM h)"""


@query(f"{RERANK} SELECT entry_row, project, round(score, 6) AS score FROM s ORDER BY s.score DESC, entry_row LIMIT 10")
def memory_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = memory.rerank(_hits(spark, sf_dir), QUESTION, AS_OF, 10)
    return ranked.select("entry_row", "project", F.round("score", 6).alias("score"))


@query(
    f"""{RERANK.replace("WITH q", "WITH RECURSIVE q")}, r AS (SELECT entry_row, coalesce(size, 0) AS size, row_number() OVER (ORDER BY score DESC, entry_row) AS n FROM s QUALIFY n <= 50),
w AS (SELECT n, entry_row, CASE WHEN size <= 12000 THEN size ELSE 0 END AS used, size <= 12000 AS kept FROM r WHERE n = 1
 UNION ALL SELECT r.n, r.entry_row, CASE WHEN w.used + r.size <= 12000 THEN w.used + r.size ELSE w.used END, w.used + r.size <= 12000 FROM w JOIN r ON r.n = w.n + 1)
SELECT n AS pos, entry_row, CAST(used AS BIGINT) AS used FROM w WHERE kept"""
)
def memory_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question's fifty best entries, cut to the size budget."""
    from pyspark.sql.window import Window

    ranked = memory.rerank(_hits(spark, sf_dir), QUESTION, AS_OF, 50).withColumn("all", F.lit(1))
    placed = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("all").orderBy(F.col("score").desc(), "hit_pos")).cast("long")).withColumn("size", F.length("body"))
    kept = greedy_budget(placed, "all", "size", "pos")
    return placed.join(kept, ["all", "pos"]).select("pos", "entry_row", "used")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic vector for every chunk that has none yet."""
    from codeloam.operators.incremental import uncached

    chunks = load(spark, sf_dir, "code_chunks")
    todo = uncached(chunks, load(spark, sf_dir, "chunk_vectors"))
    rows = chunks.join(todo, ["project", "id", "chunk_row"], "left_semi").withColumn("text", T.chunk_embedding_text(F.col("file"), F.col("symbol"), F.col("code")))
    return vectors.embed_column(rows, ["project", "id"], "text")


query()(embedded_chunks)
