"""JSON snapshots of an index: read into tables, and written from them.

Four whole-document files are known: the manifest (``mtimes``, ``fileChunks``), the graph (``symbols``,
``files``, ``symbolFile``), the project memory (``branch``, ``headSha``, ``syncedAt``, ``maxCommits``,
``entries``) and vector caches (id to numbers). A file that does not exist gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRINGS = "array<string>"
#: Fields of an entry in a snapshot, their type, and the column they become.
ENTRY_FIELDS = [
    ("id", "string", "id"), ("kind", "string", "kind"), ("sha", "string", "sha"), ("parents", _STRINGS, "parents"), ("authorName", "string", "author_name"), ("authorEmail", "string", "author_email"),
    ("timestamp", "string", "timestamp"), ("title", "string", "title"), ("body", "string", "body"), ("changeType", "string", "change_type"), ("summary", "string", "summary"), ("topics", _STRINGS, "topics"),
    ("files", _STRINGS, "files"), ("symbols", _STRINGS, "symbols"), ("impacts", "array<struct<file:string,status:string,symbols:array<string>,hints:array<string>>>", "impacts"),
    ("path", "string", "path"), ("docType", "string", "doc_type"), ("section", "string", "section"), ("sourceMtimeMs", "double", "source_mtime_ms"),
]
_ENTRY = "struct<" + ",".join(f"{a}:{t}" for a, t, _ in ENTRY_FIELDS) + ">"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value``: a document's text; no row if there is no such file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, wholetext=True)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _text(spark, path).select(F.from_json("value", schema).alias("d"))


def parse_manifest(documents: DataFrame, json: str) -> DataFrame:
    """``file``, ``mtime_ms``, ``chunk_ids`` of manifest texts; a file in one of a text's two maps only has
    null for the other."""
    d = documents.select(F.from_json(json, "mtimes map<string,double>, fileChunks map<string,array<string>>").alias("d"))
    both = F.array_union(F.map_keys("d.mtimes"), F.map_keys("d.fileChunks"))
    return d.select("d", F.explode(both).alias("file")).select("file", F.try_element_at("d.mtimes", "file").alias("mtime_ms"), F.try_element_at("d.fileChunks", "file").alias("chunk_ids"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(_text(spark, path), "value")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``edges`` (src, dst, edge_ord), ``imports`` (file, import) and ``symbol_files`` (symbol, file). The
    file's callers are its edges turned round, so they are not read."""
    d = _document(spark, path, "symbols map<string,array<string>>, files map<string,array<string>>, symbolFile map<string,string>")
    edges = d.select(F.explode("d.symbols").alias("src", "calls")).select("src", F.posexplode("calls").alias("edge_ord", "dst")).select("src", "dst", "edge_ord")
    imports = d.select(F.explode("d.files").alias("file", "i")).select("file", F.explode("i").alias("import"))
    return {"edges": edges, "imports": imports, "symbol_files": d.select(F.explode("d.symbolFile").alias("symbol", "file"))}


def read_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(one row of ``branch``, ``head_sha``, ``synced_at``, ``max_commits``; the entries, in order ``pos``)."""
    d = _document(spark, path, f"branch string, headSha string, syncedAt string, maxCommits int, entries array<{_ENTRY}>")
    meta = d.select(F.col("d.branch").alias("branch"), F.col("d.headSha").alias("head_sha"), F.col("d.syncedAt").alias("synced_at"), F.col("d.maxCommits").alias("max_commits"))
    return meta, d.select(F.posexplode("d.entries").alias("pos", "e")).select("pos", *(F.col(f"e.{a}").alias(c) for a, _, c in ENTRY_FIELDS))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``id``, ``vector``."""
    return _document(spark, path, "map<string,array<float>>").select(F.explode("d").alias("id", "vector"))


def manifest_json(manifest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` and ``json``: one document of ``manifest(file, mtime_ms, chunk_ids)`` for each key. A document
    holds a whole project, as its format demands."""
    pairs = F.array_sort(F.collect_list(F.struct("file", "mtime_ms", "chunk_ids")))
    made = manifest.where("file IS NOT NULL").groupBy(*(keys or [])).agg(pairs.alias("p"))
    times = F.map_from_entries(F.transform(F.filter("p", lambda x: x["mtime_ms"].isNotNull()), lambda x: F.struct(x["file"], x["mtime_ms"])))
    chunks = F.map_from_entries(F.transform("p", lambda x: F.struct(x["file"], F.coalesce(x["chunk_ids"], F.array().cast(_STRINGS)))))
    return made.select(*(keys or []), F.to_json(F.struct(times.alias("mtimes"), chunks.alias("fileChunks"))).alias("json"))


def memory_json(entries: DataFrame, branch: str | None, head_sha: str | None, synced_at: str, max_commits: int) -> DataFrame:
    """One row ``json`` of the entries of one project in order of ``pos``; columns an entry has not are
    left out, and so are nulls."""
    have = set(entries.columns)
    entry = F.struct(*(F.col(c).cast(t).alias(a) for a, t, c in ENTRY_FIELDS if c in have))
    listed = entries.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    meta = (F.lit(branch).cast("string").alias("branch"), F.lit(head_sha).cast("string").alias("headSha"), F.lit(synced_at).alias("syncedAt"), F.lit(max_commits).alias("maxCommits"))
    return listed.select(F.to_json(F.struct(*meta, "entries")).alias("json"))
