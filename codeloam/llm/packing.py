"""Filling fixed-capacity containers along a space-filling curve (problem 7)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloam.llm.tokenizer import Encoder, vocabulary
from codeloam.session import materialise

#: Dimensions of the curve, bits per dimension, and buckets of the hashed document vectors.
DIMS, BITS, BUCKETS = 4, 10, 4096
#: Items along the curve that a container is filled from: its neighbours first, and when less than this
#: part of it is free, whatever of the window fits best.
WINDOW, REST = 192, 4
#: Items per range partition aimed at.
PER_PARTITION = 50_000


def _projection(ids: int) -> np.ndarray:
    """For each token id its row of the hashed vector space, already projected to ``DIMS``."""
    rng = np.random.default_rng(7)
    onto = rng.standard_normal((BUCKETS, DIMS)).astype(np.float32)
    sign = rng.choice(np.array([-1, 1], np.float32), ids)
    return onto[rng.integers(0, BUCKETS, ids)] * sign[:, None]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer points (rows, each coordinate below ``2**bits``) on the Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


class CurvePacker:
    """Fills containers from items that come in the order of the curve.

    The last ``WINDOW`` unplaced items are at hand. A container takes the items nearest to its first one
    that fit, until less than a part in ``REST`` is free, then the largest that fit. The first item
    of the window is always taken, so none is left behind.
    """

    def __init__(self, capacity: int, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.near: list[tuple[int, int, tuple]] = []  # (number, size, item), in order of the curve
        self.sizes: list[tuple[int, int]] = []  # (size, number), in order of size
        self.count = 0

    def add(self, size: int, item: tuple) -> Iterator[list[tuple]]:
        """Takes an item; gives the containers that are complete."""
        self.near.append((self.count, size, item))
        insort(self.sizes, (size, self.count))
        self.count += 1
        if len(self.near) >= self.window:
            yield self._filled()

    def rest(self) -> Iterator[list[tuple]]:
        while self.near:
            yield self._filled()

    def _take(self, at: int) -> tuple[int, int, tuple]:
        entry = self.near.pop(at)
        self.sizes.pop(bisect_left(self.sizes, (entry[1], entry[0])))
        return entry

    def _filled(self) -> list[tuple]:
        room, box, at = self.capacity, [], 0
        while at < len(self.near) and room * REST > self.capacity:
            if self.near[at][1] <= room:
                box.append(self._take(at))
                room -= box[-1][1]
            else:
                at += 1
        while room and (i := bisect_right(self.sizes, (room, self.count))):
            box.append(self._take(bisect_left(self.near, (self.sizes[i - 1][1],))))
            room -= box[-1][1]
        return [item for _, _, item in sorted(box, key=lambda x: x[0])]


def document_sizes(documents: DataFrame, item_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``item_id``, ``n_tokens`` and the projected hashed vector ``x0..`` of each non-empty text."""
    shared = documents.sparkSession.sparkContext.broadcast(Encoder.from_file(vocabulary(name, folder)))
    names = [item_id, "n_tokens", *(f"x{i}" for i in range(DIMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        onto = _projection(max(encoder.ranks.values) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                sizes = np.diff(offsets)
                kept = np.flatnonzero(sizes)
                if not len(kept):
                    continue
                sums = np.add.reduceat(onto[ids], offsets[kept], axis=0) / sizes[kept, None]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(sizes[kept]), *(pa.array(sums[:, i].astype(np.float64)) for i in range(DIMS))], names=names)

    kind = dict(documents.dtypes)[item_id]
    return documents.select(item_id, F.col(text).alias("__text")).mapInArrow(run, f"`{item_id}` {kind}, n_tokens bigint, " + ", ".join(f"x{i} double" for i in range(DIMS)))


def _curve_key(sized: DataFrame) -> tuple[Column, int]:
    """The Hilbert key over all documents' coordinates, and the number of documents."""
    dims = [f"x{i}" for i in range(DIMS)]
    row = sized.agg(F.count("*").alias("n"), *(F.avg(d).alias(f"m_{d}") for d in dims), *(F.stddev_pop(d).alias(f"s_{d}") for d in dims)).first()
    middle = np.array([row[f"m_{d}"] or 0.0 for d in dims])
    spread = np.array([row[f"s_{d}"] or 1.0 for d in dims])

    @F.pandas_udf("bigint")
    def key(*columns):
        import pandas as pd

        z = (np.stack([c.to_numpy() for c in columns], axis=1) - middle) / spread
        return pd.Series(hilbert_key(np.clip(1 / (1 + np.exp(-1.7 * z)) * 2**BITS, 0, 2**BITS - 1)))

    return key(*dims), row["n"]


def pack_documents(documents: DataFrame, capacity: int, item_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Assigns every non-empty text to containers of ``capacity`` tokens.

    Gives ``container``, ``position`` (order in it), ``offset`` (first token place in it),
    ``item_id``, ``part``, ``start_token`` and ``n_tokens``. A text is cut, into parts of
    ``capacity`` and a rest, only if it alone exceeds the capacity. Null and empty texts take no
    place and have no row; repeated rows are each packed; an empty table gives no containers.

    Documents are range-partitioned by (Hilbert key, id, part), so that copies, which share a key,
    are spread over as many partitions as they need; each partition is packed as it streams by.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = materialise(document_sizes(documents, item_id, text, name, folder))
    key, n = _curve_key(sized)
    parts = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    items = (
        sized.select(item_id, "n_tokens", key.alias("key"))
        .select(item_id, "n_tokens", "key", F.explode(F.sequence(F.lit(0), parts)).alias("part"))
        .select(item_id, "key", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("size"))
    )
    ordered = items.repartitionByRange(max(1, -(-n // PER_PARTITION)), "key", item_id, "part").sortWithinPartitions("key", item_id, "part")
    names = ["container", "position", "offset", item_id, "part", "start_token", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        packer = CurvePacker(capacity)
        types = [pa.int64(), pa.int32(), pa.int32(), None, pa.int32(), pa.int64(), pa.int32()]

        def rows(boxes: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal first
            out: list[tuple] = []
            for box in boxes:
                at = 0
                for position, (item, part, size) in enumerate(box):
                    out.append((first, position, at, item, part, part * capacity, size))
                    at += size
                first += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names=names)

        for batch in batches:
            types[3] = batch.schema.field(0).type
            yield rows([box for x in zip(*(c.to_pylist() for c in batch.columns)) for box in packer.add(x[2], x)])
        if packer.near:
            yield rows([*packer.rest()])

    kind = dict(documents.dtypes)[item_id]
    return ordered.select(item_id, "part", "size").mapInArrow(run, f"container bigint, position int, offset int, `{item_id}` {kind}, part int, start_token bigint, n_tokens int")
