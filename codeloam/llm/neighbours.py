"""The k most similar vectors of every vector: one HNSW graph per shard, results merged (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloam.session import materialise

#: Links per node (twice as many on the ground layer), candidates a node's links are chosen from,
#: and the beam of a search.
LINKS, CANDIDATES, BEAM = 16, 32, 48
#: Dimensions of the random projection that a search walks on; results are ranked on all of them.
WALK_DIMS = 320
#: Vectors per shard aimed at. A cell with more than twice as many is split by centroids of its own.
SHARD = 6000
#: The centroids are fitted on a sample of so many vectors a shard (least, most in all). The most sample
#: vectors and the least of a shard bound the number of shards, 8,192: a table of more than 49 million
#: rows has larger shards, in which a vector costs the same but for a logarithm.
SAMPLE_PER_SHARD, SAMPLE_LEAST, SAMPLE_MOST, LEAST_PER_SHARD = 128, 4096, 131_072, 16
#: Parts that one cell is split into at a time, and vectors inserted into a graph at a time.
FANOUT, BATCH = 64, 512
#: A query visits its own shard and those whose centroid is at most ``REACH`` less similar to it
#: than its nearest centroid, ``PROBES`` in all.
PROBES, REACH = 3, 0.25


class Hnsw:
    """A hierarchical navigable small-world graph over unit vectors, kept as flat arrays.

    Layer ``l`` holds the nodes ``members[l]`` (the first ones of a random order) and an int32 array
    ``links[l]`` of their neighbours (places within the layer, padded with -1). Layers are built from
    the top down; each takes its nodes in batches that search the graph built so far, from where the
    search of the layers above ends. Links are chosen by the diversity rule (a candidate nearer to a
    chosen one than to the node is left for last) and go both ways.
    """

    def __init__(self, vectors: np.ndarray, walk: np.ndarray, seed: int = 1):
        n = len(walk)
        #: place of a vector in the random order in which nodes are inserted, and back
        self.order = np.random.default_rng(seed).permutation(n)
        self.place = np.argsort(self.order)
        self.vectors, self.walk = vectors, np.ascontiguousarray(walk[self.order])
        self.sizes = [n]
        while self.sizes[-1] > 4 * LINKS:
            self.sizes.append(-(-self.sizes[-1] // LINKS))
        self.links: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(self.sizes)
        for layer in range(len(self.sizes) - 1, -1, -1):
            self._build(layer, LINKS * 2 if layer == 0 else LINKS)

    def _build(self, layer: int, degree: int) -> None:
        n, x = self.sizes[layer], self.walk
        self.links[layer] = links = np.full((n, degree), -1, np.int32)
        score = np.full((n, degree), -np.inf, np.float32)
        done = 0
        while done < n:
            b = min(n, done + min(BATCH, max(done, 4 * LINKS)))
            new = np.arange(done, b)
            q = x[done:b]
            s = q @ q.T  # a batch's nodes are candidates of each other
            np.fill_diagonal(s, -np.inf)
            near = min(CANDIDATES if not done else LINKS, b - done - 1)
            own = np.argpartition(-s, near - 1, axis=1)[:, :near] if near > 0 else np.zeros((b - done, 0), np.int64)
            cand, cs = done + own, np.take_along_axis(s, own, 1)
            if done:
                ids, sims = self._beam(layer, q, self._entry(layer, q, done), min(CANDIDATES, done))
                cand, cs = np.concatenate([cand, ids], 1), np.concatenate([cs, np.where(ids >= 0, sims, -np.inf)], 1)
            rank = np.argsort(-cs, axis=1, kind="stable")
            cand, cs = np.take_along_axis(cand, rank, 1), np.take_along_axis(cs, rank, 1)
            void = np.isneginf(cs)
            between = np.matmul(x[cand], x[cand].transpose(0, 2, 1))
            kept = np.zeros(cand.shape, bool)
            for c in range(cand.shape[1]):
                kept[:, c] = ~void[:, c] & ~(kept[:, :c] & (between[:, c, :c] > cs[:, c, None])).any(1)
            worth = np.where(void, -np.inf, cs + 4 * kept)  # the diverse ones first
            best = np.argsort(-worth, axis=1, kind="stable")[:, :degree]
            cand, worth = np.take_along_axis(cand, best, 1), np.take_along_axis(worth, best, 1)
            r, c = np.nonzero(~np.isneginf(worth))
            self._connect(links, score, np.concatenate([new[r], cand[r, c]]), np.concatenate([cand[r, c], new[r]]), np.concatenate([worth[r, c]] * 2))
            done = b

    @staticmethod
    def _connect(links: np.ndarray, score: np.ndarray, src: np.ndarray, dst: np.ndarray, worth: np.ndarray) -> None:
        """Adds links; each node keeps its best."""
        degree = links.shape[1]
        nodes = np.unique(src)
        old = links[nodes]
        r, c = np.nonzero(old >= 0)
        src, dst, worth = np.concatenate([nodes[r], src]), np.concatenate([old[r, c], dst]), np.concatenate([score[nodes][r, c], worth])
        order = np.lexsort((dst, -worth, src))
        src, dst, worth = src[order], dst[order], worth[order]
        _, first = np.unique(src * len(links) + dst, return_index=True)  # a pair met from both ends counts once
        keep = np.zeros(len(src), bool)
        keep[first] = True
        src, dst, worth = src[keep], dst[keep], worth[keep]
        at = np.arange(len(src)) - np.searchsorted(src, src)
        take = at < degree
        links[nodes], score[nodes] = -1, -np.inf
        links[src[take], at[take]], score[src[take], at[take]] = dst[take], worth[take]

    def _entry(self, layer: int, q: np.ndarray, done: int) -> np.ndarray:
        """Nodes of a layer, among its first ``done``, from which each query is searched there: what the
        layers above give, and the first nodes of all."""
        top = len(self.sizes) - 1
        entry = np.tile(np.arange(min(self.sizes[top], 4 * LINKS if layer == top else 8 * LINKS, done), dtype=np.int32), (len(q), 1))
        for above in range(top, layer, -1):
            found, _ = self._beam(above, q, entry, min(8, self.sizes[above]))
            entry = np.concatenate([np.where(found < done, found, -1), entry[:, :2]], 1)
            entry.sort(axis=1)
            entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        return entry

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``ef`` nodes of a layer for each query, walked from ``entry`` (padded with -1)."""
        x, links = self.walk, self.links[layer]
        n, m = self.sizes[layer], len(q)
        seen = np.zeros((m, n + 1), bool)
        ids = np.full((m, ef), -1, np.int32)
        sims = np.full((m, ef), -np.inf, np.float32)
        done = np.ones((m, ef), bool)

        def add(rows: np.ndarray, new: np.ndarray) -> None:
            fresh = (new >= 0) & ~np.take_along_axis(seen[rows], new, 1)
            r, c = np.nonzero(fresh)
            if not len(r):
                return
            node = new[r, c]
            seen[rows[r], node] = True
            s = np.full(new.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[rows[r]], x[node])
            all_s = np.concatenate([sims[rows], s], 1)
            best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef] if all_s.shape[1] > ef else np.tile(np.arange(ef), (len(rows), 1))
            sims[rows] = np.take_along_axis(all_s, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new], 1), best, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], 1), best, 1)

        active = np.arange(m)
        for c in range(0, entry.shape[1], ef):
            add(active, entry[:, c : c + ef].astype(np.int32))
        while len(active):
            open_s = np.where(done[active], -np.inf, sims[active])
            # two nodes at a time: half as many rounds
            top = np.argpartition(-open_s, 1, axis=1)[:, :2] if ef > 2 else np.argmax(open_s, 1)[:, None]
            some = ~np.isneginf(np.take_along_axis(open_s, top, 1))
            go = some.any(1)
            active, top, some = active[go], top[go], some[go]
            if not len(active):
                break
            node = np.where(some, np.take_along_axis(ids[active], top, 1), -1)
            done[active[:, None], top] = True
            new = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1)
            order = np.sort(new, axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            add(active, order)
        return ids, sims

    def search(self, q: np.ndarray, q_walk: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ``k`` best for each query, padded with -1; ``own`` gives the
        queries' own nodes, where the walk starts and which are no results."""
        ef = min(max(BEAM, 2 * k), len(self.walk))
        at = None if own is None else self.place[own].astype(np.int32)
        found, _ = self._beam(0, q_walk, self._entry(0, q_walk, len(self.walk)) if at is None else at[:, None], ef)
        ids = np.where(found >= 0, self.order[found], -1)
        if own is not None:
            ids = np.where(ids == own[:, None], -1, ids)
        cos = np.where(ids >= 0, np.matmul(self.vectors[ids], q[:, :, None])[:, :, 0], -np.inf)
        best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, best, 1), np.take_along_axis(cos, best, 1)


def _usable(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their vectors) without null, short, long, zero, infinite or NaN ones."""
    lists = batch.column(1)
    offsets = np.asarray(lists.offsets)
    rows = np.flatnonzero((np.diff(offsets) == dims) & np.asarray(lists.is_valid()))
    if not len(rows):
        return rows, np.zeros((0, dims), np.float32)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = values[offsets[rows][:, None] + np.arange(dims)] if len(rows) < len(lists) or lists.null_count else values[offsets[0] : offsets[0] + len(rows) * dims].reshape(-1, dims)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(np.float32)


def _digests(x: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(x + np.float32(0))  # -0.0 is 0.0
    return [xxhash.xxh3_128_digest(row) for row in flat]


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        s = np.concatenate([sample[a : a + 8192] @ centres.T for a in range(0, len(sample), 8192)])
        near = s.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(s.max(1))[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def fit_shards(sample: np.ndarray, rows: int, target: int) -> np.ndarray:
    """Centroids of shards of about ``target`` rows: a cell with more than twice as many by its part of
    the sample is split by centroids of its own, at most ``FANOUT`` at a time, until none is left that
    is crowded or has too few sample vectors to split."""
    share = rows / max(1, len(sample))
    cells, out = [np.arange(len(sample))], []
    while cells:
        cell = cells.pop()
        x = sample[cell]
        k = min(FANOUT, round(len(cell) * share / target), len(cell) // LEAST_PER_SHARD)
        if k > 1 and len(cell) * share > 2 * target:
            centres = fit_centroids(x, k)
            near = (x @ centres.T).argmax(1)
            parts = [cell[near == i] for i in range(k)]
            if sum(len(p) > 0 for p in parts) > 1:
                cells += [p for p in parts if len(p)]
                continue
        centre = x.sum(0)
        out.append(centre / max(1e-9, float(np.linalg.norm(centre))))
    return np.array(out, np.float32).reshape(-1, sample.shape[1])


def class_neighbours(vectors: DataFrame, vec_id: str, vector: str, dims: int, k: int, rows: int) -> DataFrame:
    """``rep`` and ``near`` (array of (-cosine, rep), best first): the ``k`` best among the distinct
    vectors for each distinct vector, known by one ``vec_id`` of its copies (``rep``). A vector is sent
    to its own shard and to at most ``PROBES - 1`` others, in dense regions too."""
    spark = vectors.sparkSession
    table = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    onto = np.random.default_rng(5).standard_normal((dims, min(WALK_DIMS, dims))).astype(np.float32)
    onto = np.linalg.qr(onto)[0] if dims > WALK_DIMS else np.eye(dims, dtype=np.float32)
    centres = np.zeros((1, onto.shape[1]), np.float32)
    if rows > 2 * SHARD:
        want = min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_PER_SHARD * round(rows / SHARD)))
        share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, want / rows) * (1 << 20))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, x = _usable(batch, dims)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in _unit(x) @ onto] if len(x) else [], pa.binary())], names=["walk"])

        kept = table.where(share).mapInArrow(project, "walk binary").limit(2 * want).toArrow().column(0).to_pylist()
        sample = np.frombuffer(b"".join(kept), np.float32).reshape(-1, onto.shape[1])
        if len(sample):
            centres = fit_shards(sample / np.maximum(1e-9, np.linalg.norm(sample, axis=1, keepdims=True)), rows, SHARD)
    shared = spark.sparkContext.broadcast((centres, onto))

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("query", T.BooleanType()), T.StructField("vec_id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("unit", T.BinaryType())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, onto = shared.value
        sent: set[bytes] = set()
        for batch in batches:
            at, x = _usable(batch, dims)
            if not len(at):
                continue
            digests = _digests(x)
            fresh = []  # copies within this task are sent once
            for i, d in enumerate(digests):
                if d not in sent:
                    sent.add(d)
                    fresh.append(i)
            if not fresh:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at][fresh]
            u, digests = _unit(x[fresh]), [digests[i] for i in fresh]
            s = (u @ onto) @ centres.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :PROBES]
            close = np.take_along_axis(s, near, 1)
            visit = close >= close[:, :1] - REACH
            shard, query, row = [near[:, 0]], [np.zeros(len(u), bool)], [np.arange(len(u))]
            for p in range(1, near.shape[1]):
                there = np.flatnonzero(visit[:, p])
                shard.append(near[there, p]), query.append(np.ones(len(there), bool)), row.append(there)
            r = np.concatenate(row)
            packed = [v.tobytes() for v in u]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard), pa.int32()), pa.array(np.concatenate(query)), pa.array(ids[r], pa.int64()), pa.array([digests[i] for i in r], pa.binary()), pa.array([packed[i] for i in r], pa.binary())], names=schema.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto = shared.value[1]
        now, held, held_ids, graph, reps = None, [], [], None, None
        segment = last = None

        def result(ids: np.ndarray, nodes: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
            good = nodes >= 0
            ends = np.concatenate([[0], np.cumsum(good.sum(1))])
            near = pa.StructArray.from_arrays([pa.array(-cos[good].astype(np.float64)), pa.array(reps[nodes[good]], pa.int64())], ["far", "rep"])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)], names=["rep", "near"])

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal graph, reps, held
            if held:
                x = np.concatenate(held)
                reps = np.array(held_ids, np.int64)
                walk = x @ onto
                graph, held = Hnsw(x, walk), []
                for a in range(0, len(x), 512):
                    own = np.arange(a, min(len(x), a + 512), dtype=np.int32)
                    yield result(reps[own], *graph.search(x[own], walk[own], own, k))

        for batch in batches:
            shards = batch.column(0).to_numpy()
            queries = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy()
            digests = batch.column(3).to_pylist()
            units = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(-1, dims)
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (queries[1:] != queries[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != now:
                    yield from built()
                    now, held, held_ids, graph = shards[a], [], [], None
                if segment != (segment := (shards[a], queries[a])):
                    last = None
                new = []  # rows come sorted: of copies that several tasks sent, the first counts
                for i in range(a, b):
                    if digests[i] != last:
                        last = digests[i]
                        new.append(i)
                if not queries[a]:
                    held.append(units[new])
                    held_ids.extend(ids[new].tolist())
                    continue
                if held:
                    yield from built()
                if graph is None:
                    continue  # nothing is kept in this shard
                for c in range(0, len(new), 512):
                    part = new[c : c + 512]
                    q = units[part]
                    yield result(ids[part], *graph.search(q, q @ onto, None, k))
        yield from built()

    n_shards = len(centres)
    routed = table.mapInArrow(route, schema)
    found = routed.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "query", "digest", "vec_id").mapInArrow(search, "rep bigint, near array<struct<far: double, rep: bigint>>")
    return found.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def similar_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "vector", dims: int = 384, k: int = 5) -> DataFrame:
    """``vec_id``, ``rank`` (1..k), ``neighbour``, ``cosine``: the ``k`` most similar other rows.

    Equal cosines rank by smaller id. Null vectors and those of another length, all zero, or
    holding null, NaN or infinity are no rows and no neighbours. Rows of equal vectors are each
    other's neighbours at cosine 1; of such a class only its ``k + 1`` smallest ids can be anyone's
    neighbours, so classes of any size need no more than those and are searched once. A repeated
    ``vec_id`` counts once. Fewer than ``k + 1`` usable rows give fewer ranks, none gives no rows.
    """
    rows = vectors.count()
    light = materialise(_digest_rows(vectors, vec_id, vector, dims)).dropDuplicates(["vec_id"])
    base = materialise(class_neighbours(vectors, vec_id, vector, dims, k, rows))
    order = Window.partitionBy("digest").orderBy("vec_id")
    heads = light.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    classes = materialise(heads.groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).where(F.size("ids") > 1))
    small = classes.where(F.size("ids") <= k).select(F.explode("ids").alias("vec_id"), "ids")
    salts = 16
    full = classes.where(F.size("ids") > k).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    large = light.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).join(full, ["digest", "salt"]).select("vec_id", "ids")
    members = materialise(small.unionByName(large))

    each = base.select("rep", F.explode("near").alias("x")).select("rep", F.col("x.far").alias("far"), F.col("x.rep").alias("vec_id"))
    spread = each.join(members, "vec_id", "left").select("rep", F.transform(F.coalesce("ids", F.array("vec_id")), lambda i: F.struct(F.col("far").alias("far"), i.alias("id"))).alias("some"))
    found = spread.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k).alias("found"))
    # every distinct vector, those without any neighbour outside their class too
    known = base.select("rep").join(found, "rep", "left").join(members.withColumnRenamed("vec_id", "rep"), "rep", "left")
    at_one = lambda ids, own: F.transform(F.filter(ids, lambda i: i != own), lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id")))
    none = F.array().cast("array<struct<far: double, id: bigint>>")
    singles = known.where("ids IS NULL OR size(ids) <= " + str(k)).select(F.explode(F.coalesce("ids", F.array("rep"))).alias("vec_id"), F.coalesce("ids", F.array("rep")).alias("ids"), F.coalesce("found", none).alias("found"))
    own = singles.select("vec_id", F.slice(F.concat(at_one(F.col("ids"), F.col("vec_id")), "found"), 1, k).alias("found"))
    copies = members.where(F.size("ids") > k).select("vec_id", F.slice(at_one(F.col("ids"), F.col("vec_id")), 1, k).alias("found"))
    return own.unionByName(copies).select("vec_id", F.posexplode("found").alias("pos", "x")).select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.least(F.lit(1.0), -F.col("x.far")).alias("cosine"))


def similar_pairs(vectors: DataFrame, at_least: float = 0.75, **options) -> DataFrame:
    """``vec_a`` < ``vec_b``: pairs of which at least one is among the most similar of the other,
    with a cosine of ``at_least`` or more."""
    near = similar_vectors(vectors, **options).where(F.col("cosine") >= at_least)
    return near.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()


def _digest_rows(vectors: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _usable(batch, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(pa.int64()), pa.array(_digests(x), pa.binary())], names=["vec_id", "digest"])

    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).mapInArrow(run, "vec_id bigint, digest binary")
