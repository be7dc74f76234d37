"""Exact vector search, and a deterministic embedder for texts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloam.functions.constants import VECTOR_DIMS
from codeloam.operators.ordering import first_per_key

#: Queries in a block, and blocks that one scan of all rows serves: what a task holds at once is at most
#: so many vectors (about 100 MB at 384 dimensions).
QUERY_BLOCK, BLOCKS_A_SCAN = 4096, 8


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if a length differs or one is zero. JVM-side."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def _rows(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable rows."""
    lists = batch.column(1)
    offsets = np.asarray(lists.offsets)
    at = np.flatnonzero((np.diff(offsets) == dims) & np.asarray(lists.is_valid()))
    x = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[at][:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[good]
    return at[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_search(queries: DataFrame, vectors: DataFrame, k: int, dims: int, id: str = "vec_id", vector: str = "embedding", include_self: bool = True) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest cosine for each row of ``queries``:
    ``query_id``, ``rank``, ``id``, ``cosine``; ties by smaller id. Unusable vectors (null, of another
    length, zero, not finite) are no queries and no results; no rows give no rows.

    Queries go in blocks of ``QUERY_BLOCK`` against all rows, ``BLOCKS_A_SCAN`` of them in one scan: they
    are sent to each task (a bounded size), and each batch of rows returns its best ``k`` a query, so
    few rows are shuffled. The cost is that of an exact search: queries times rows, and one scan of
    the rows for every 32,768 queries.
    """
    spark = vectors.sparkSession
    wanted = queries.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    n = wanted.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK * 1.1))
    table = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    found: list[DataFrame] = []
    held: list = []

    def scan(shared: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = _rows(batch, dims)
                if not len(at):
                    continue
                own = np.asarray(batch.column(0))[at]
                for block in shared:
                    ids, q = block.value
                    for a in range(0, len(q), 512):
                        s = np.round(q[a : a + 512] @ x.T, 12)
                        if not include_self:
                            s[ids[a : a + 512, None] == own[None, :]] = -np.inf
                        m = min(k, s.shape[1])
                        # everything at least as good as the k-th best: ties are cut later, by id
                        least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                        r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 512][r]), pa.array(own[c]), pa.array(s[r, c])], names=["query_id", "id", "cosine"])

        return table.mapInArrow(run, "query_id bigint, id bigint, cosine double")

    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = part.toArrow().combine_chunks()
        batches = got.to_batches()
        if not batches:
            continue
        pieces = [(np.asarray(x.column(0))[r], v) for x in batches for r, v in [_rows(x, dims)]]
        ids, q = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        if not len(ids):
            continue
        held.append(spark.sparkContext.broadcast((ids, q)))
        if len(held) == BLOCKS_A_SCAN:
            found.append(scan(held))
            held = []
    if held:
        found.append(scan(held))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, cosine double")
    every = reduce(DataFrame.unionByName, found)
    best = first_per_key(every, ["query_id"], F.col("cosine").desc(), "id", n=k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))).select("query_id", "rank", "id", "cosine")


_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def embed(texts: list[str | None], dims: int = VECTOR_DIMS) -> np.ndarray:
    """Deterministic hashed bag of words, bigrams and name parts, of unit length; a text without words
    gives a zero vector. Words are numbered once a batch; all counting is done on arrays."""
    words: dict[str, int] = {}
    codes = [[words.setdefault(w.lower(), len(words)) for w in _PART.findall(t)] if t else [] for t in texts]
    out = np.zeros((len(texts), dims), np.float32)
    if not words:
        return out
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    flat = np.fromiter((c for row in codes for c in row), np.int64)
    row = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    pair = row[1:] == row[:-1]
    h = hashes[flat]
    both = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:])[pair] * np.uint64(0xC2B2AE3D27D4EB4F)
    both ^= both >> np.uint64(29)
    h, row = np.concatenate([h, both]), np.concatenate([row, row[1:][pair]])
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    out += np.bincount(row * dims + (h % np.uint64(dims)).astype(np.int64), sign, len(texts) * dims).reshape(len(texts), dims).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed_column(df: DataFrame, keys: list[str], text: str, dims: int = VECTOR_DIMS) -> DataFrame:
    """``keys`` and ``vector`` of each row's text, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = embed(batch.column(len(keys)).to_pylist(), dims)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dims, pa.int32()), pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), lists], names=[*keys, "vector"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*keys).dtypes) + ", vector array<float>"
    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)
