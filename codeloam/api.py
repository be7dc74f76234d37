"""One method for each tool: indexing a project and asking about it. All give DataFrames."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codeloam.extract import source
from codeloam.functions import constants as K
from codeloam.functions import text as T
from codeloam.operators import graph, incremental, memory, retrieval, vectors
from codeloam.operators.ordering import first_per_key
from codeloam.sources import files as FS
from codeloam.sources import git
from codeloam.sources.store import NotIndexedError, Store
from codeloam.session import materialise

__all__ = ["Engine", "NotIndexedError"]


@dataclass
class Counters:
    files: int
    chunks: int
    edges: int
    embedded: int
    deleted: int
    orphans: int
    entries_added: int
    entries_deleted: int


def _between(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} is {low} to {high}")
    return value


class Engine:
    """Indexes the tree at ``root`` into ``store`` (a folder that all executors share) and answers;
    directories named in ``skip`` are left out.

    Reading tools raise ``NotIndexedError`` before the first ``index_project``; an unknown symbol or
    file gives an empty result.
    """

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, skip: tuple[str, ...] = ()):
        self.spark, self.root, self.skip = spark, os.path.abspath(root), skip
        self.repository = git.git_root(self.root)
        self.branch = git.branch_name(self.repository) if self.repository else None
        self.project = hashlib.sha256(f"{self.root}\n{self.branch}".encode() if self.branch else self.root.encode()).hexdigest()[:8]
        self.store = Store(spark, f"{store or self.root + '/.codeloam'}/{self.project}")

    # ---- indexing

    def _sources(self) -> DataFrame:
        code = FS.scan(self.spark, self.root, "source", self.skip)
        return code.select(F.lit(self.project).alias("project"), F.col("rel").alias("file"), F.decode("content", "UTF-8").alias("text"), "mtime_ms")

    def _chunks(self, sources: DataFrame) -> DataFrame:
        symbols = source.extract_chunks(sources, ["project"]).join(sources.select("file", "mtime_ms"), "file")
        plain = FS.plain_chunks(FS.scan(self.spark, self.root, "plain", self.skip)).withColumn("project", F.lit(self.project))
        every = symbols.unionByName(plain, allowMissingColumns=True)
        # two symbols of one name in a file share an id: the last one stands
        last = every.withColumn("chunk_row", F.xxhash64("id", F.coalesce("start_line", F.lit(0))))
        return first_per_key(last, ["id"], F.col("start_line").desc_nulls_last())

    def index_project(self, progress: Callable[[str, int, int], None] | None = None) -> Counters:
        """Extracts, compares with the last index, deletes what is stale or orphaned, embeds what has no
        vector, and refreshes the project memory; the manifest is written last. ``progress`` is called
        with (phase, done, total) as vectors are embedded and stored."""
        sources = materialise(self._sources())  # read once for chunks, calls and definitions
        chunks = self.store.write("chunks", self._chunks(sources))
        edges = self.store.write("edges", source.call_edges(sources, ["project"]))
        self.store.write("symbol_files", retrieval.symbol_files(source.symbol_definitions(sources, ["project"])))
        manifest = incremental.build_manifest(chunks)
        old, kept, deleted, orphans = self.store.read_or_none("manifest"), self.store.read_or_none("chunk_vectors"), 0, 0
        if kept is not None:  # vectors of another length, say of an older embedder, are made again
            kept = kept.where(F.size("vector") == K.VECTOR_DIMS)
        if old is not None and kept is not None:
            stale = incremental.stale_chunks(old, manifest).withColumnRenamed("chunk_id", "id")
            deleted = stale.count()
            kept = incremental.delete(kept, stale, ["project", "id"])
            lost = incremental.orphan_ids(kept, chunks)
            orphans = lost.count()
            kept = incremental.delete(kept, lost, ["project", "id"])
        todo = chunks if kept is None else chunks.join(kept.select("project", "id"), ["project", "id"], "left_anti")
        fresh = vectors.embed_column(todo.withColumn("t", T.chunk_embedding_text(F.col("file"), F.col("symbol"), F.col("code"))), ["project", "id"], "t")
        embedded = todo.count()
        tell = progress or (lambda *_: None)
        tell("embedding", 0, embedded)
        watch = Observation()
        fresh = fresh.observe(watch, F.count("*").alias("stored"))
        self.store.write("chunk_vectors", fresh if kept is None else kept.unionByName(fresh))
        tell("storing", watch.get["stored"] if embedded else 0, embedded)
        added, gone = self.sync_memory()
        self.store.write("manifest", manifest)
        return Counters(manifest.count(), chunks.count(), edges.count(), embedded, deleted, orphans, added, gone)

    def sync_memory(self) -> tuple[int, int]:
        """Rebuilds documents, builds entries of new commits only, keeps the newest 150; gives the
        numbers of added and deleted entries."""
        docs = FS.document_files(FS.scan(self.spark, self.root, "doc", self.skip)).withColumn("project", F.lit(self.project))
        entries = memory.document_entries(docs)
        previous = self.store.read_or_none("entries")
        known = materialise(previous.select("project", "id")) if previous is not None else None  # outlives the old table
        if self.repository:
            log = materialise(git.history(self.spark, self.repository).withColumn("project", F.lit(self.project)))
            had = previous.where("kind = 'change'") if previous is not None else None
            new = log if had is None else log.join(had.select("sha"), "sha", "left_anti")
            built = memory.change_entries(new.drop("patch"), git.change_touches(new, self.repository))
            if had is not None:
                built = had.drop("log_pos").join(log.select("sha", "log_pos"), "sha").unionByName(built, allowMissingColumns=True)
            entries = built.unionByName(entries, allowMissingColumns=True)
        if "sha" not in entries.columns:
            none = "array<struct<file:string,status:string,symbols:array<string>,hints:array<string>>>"
            entries = entries.select("*", F.lit(None).cast("string").alias("sha"), F.lit(None).cast(none).alias("impacts"), *(F.lit(None).cast("string").alias(c) for c in ("author_name", "author_email")))
        text = F.when(F.col("kind") == "change", T.change_embedding_text()).otherwise(T.document_embedding_text())
        stored = self.store.write("entries", entries.withColumn("embedding_text", text))
        difference = incremental.entry_difference(known, stored) if known is not None else stored.select("project", "id", F.lit("added").alias("change")).distinct()
        counts = {r["change"]: r["n"] for r in difference.groupBy("change").agg(F.count("*").alias("n")).collect()}
        wanted = stored.dropDuplicates(["id"])
        had = self.store.read_or_none("memory_vectors")
        if had is not None:  # an entry's id stands for its text: only new ones are embedded
            had = had.where(F.size("vector") == K.VECTOR_DIMS).join(wanted.select("project", "id"), ["project", "id"], "left_semi")
            wanted = wanted.join(had.select("project", "id"), ["project", "id"], "left_anti")
        made = vectors.embed_column(wanted, ["project", "id"], "embedding_text")
        self.store.write("memory_vectors", made if had is None else had.unionByName(made))
        return counts.get("added", 0), counts.get("stale", 0)

    def _entries(self, sync: bool) -> DataFrame:
        if sync:
            self.sync_memory()
        e = self.store.read("entries").dropDuplicates(["project", "id"])
        return memory.dated(e.withColumn("kind_ord", F.when(F.col("kind") == "change", 0).otherwise(1)))

    def latest_sha(self) -> str | None:
        """The newest commit in log order, which need not be the newest in time."""
        row = memory.log_newest(self.store.read("entries")).first() if self.repository else None
        return row["latest_sha"] if row else None

    # ---- code tools

    def query_project(self, question: str) -> DataFrame:
        """Results in order with score, callees and callers."""
        chunks, edges = self.store.read("chunks"), self.store.read("edges")
        hits = self._search(question, "chunk_vectors", 5).join(chunks.select("id", "chunk_row"), "id").select(F.lit(self.project).alias("project"), "chunk_row", F.col("cosine").alias("score"))
        found = retrieval.query_project(chunks, edges, hits, question)
        return graph.with_neighbours(found, edges).withColumn("label", T.score_label(F.col("score"))).orderBy("pos")

    def _search(self, question: str, table: str, k: int) -> DataFrame:
        q = [float(x) for x in vectors.embed([question])[0]]
        v = self.store.read(table)
        scored = v.select("id", vectors.cosine(F.col("vector"), F.array(*map(F.lit, q))).alias("cosine")).where("cosine IS NOT NULL")
        return scored.orderBy(F.col("cosine").desc(), "id").limit(k)

    def index_status(self) -> DataFrame:
        """One row: files, chunks, symbols, edges, vectors, entries."""
        read = self.store.read
        count = lambda t, c: read(t).agg(F.count("*").alias(c))
        parts = [read("chunks").agg(F.count("*").alias("chunks"), F.countDistinct("symbol").alias("symbols")), *(count(t, c) for t, c in (("manifest", "files"), ("edges", "edges"), ("chunk_vectors", "vectors"), ("entries", "entries")))]
        one = parts[0]
        for p in parts[1:]:  # rows of one: no more than a line of counters
            one = one.join(F.broadcast(p))
        return one.select(F.lit(self.project).alias("project"), F.lit(self.branch).cast("string").alias("branch"), "files", "chunks", "symbols", "edges", "vectors", "entries")

    def get_symbol(self, symbol: str) -> DataFrame:
        """Up to ten chunks of a symbol, with callees and callers."""
        return self._named([symbol], 10)

    def get_symbols(self, symbols: list[str]) -> DataFrame:
        """Up to three chunks a symbol; a symbol without any has one row with a null ``chunk_row``."""
        _between("symbols", len(symbols), 1, 50)
        return self._named(symbols, 3 * len(symbols), missing=True)

    def _named(self, symbols: list[str], most: int, missing: bool = False) -> DataFrame:
        wanted = self.spark.createDataFrame([(self.project, s) for s in dict.fromkeys(symbols)], "project string, symbol string")
        found = retrieval.get_symbols(self.store.read("chunks"), wanted, most)
        if missing:
            found = found.unionByName(retrieval.missing_symbols(self.store.read("chunks"), wanted), allowMissingColumns=True)
        return graph.with_neighbours(found, self.store.read("edges"))

    def expand_graph(self, seeds: list[str], hops: int = 2, direction: str = "both") -> DataFrame:
        """Up to 60 symbols around the seeds, in order of discovery, each with its first chunk."""
        _between("seeds", len(seeds), 1, 20)
        _between("hops", hops, 1, 3)
        start = self.spark.createDataFrame([(self.project, s, i) for i, s in enumerate(seeds)], "project string, symbol string, ord int")
        found = graph.expand_graph(self.store.read("edges"), start, hops, direction)
        return found.join(retrieval.first_chunk_per_symbol(self.store.read("chunks"), found, self.store.read_or_none("symbol_files")), ["project", "symbol"]).orderBy("pos")

    def list_symbols(self, file_filter: str | None = None) -> DataFrame:
        chunks = self.store.read("chunks")
        if file_filter:
            chunks = chunks.where(F.contains(F.col("file"), F.lit(file_filter)))
        return graph.symbols_by_file(chunks, self.store.read("edges")).orderBy("file")

    def get_file_chunks(self, file: str) -> DataFrame:
        found = retrieval.with_point(self.store.read("chunks").where(F.col("file") == file)).orderBy("point_id").limit(100)
        return graph.with_neighbours(found, self.store.read("edges"))

    # ---- memory tools; they refresh the memory first

    def recent_changes(self, limit: int = 10, change_type: str | None = None, topic: str | None = None, sync: bool = True) -> DataFrame:
        return memory.recent_changes(self._entries(sync), _between("limit", limit, 1, 25), change_type, topic).orderBy("pos")

    def feature_map(self, sync: bool = True) -> DataFrame:
        return memory.feature_map(self._entries(sync)).orderBy("part", "pos")

    def project_status(self, sync: bool = True) -> dict[str, DataFrame]:
        e = self._entries(sync)
        dirty = git.working_tree(self.spark, self.repository) if self.repository else self.spark.createDataFrame([], "path string, status string")
        return {"latest_change": memory.newest(e.where("kind = 'change'"), 1), "dirty_files": dirty, "recent_fixes": memory.recent_fixes(e), "active_topics": memory.topic_histogram(e), "change_kinds": memory.kind_histogram(e), "feature_docs": memory.feature_documents(e)}

    def query_project_memory(self, question: str, limit: int = 5, as_of: dt.datetime | None = None, sync: bool = True) -> DataFrame:
        _between("limit", limit, 1, 10)
        entries = self._entries(sync)
        hits = self._search(question, "memory_vectors", max(2 * limit, 10))
        joined = entries.join(hits, "id").withColumn("hit_pos", -F.col("cosine"))
        return memory.rerank(joined, question, as_of or dt.datetime.now(dt.UTC).replace(tzinfo=None), limit)
