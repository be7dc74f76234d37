"""Queries over code memory, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.functions import text as T
from codeloam.operators import graph, incremental, intervals, retrieval
from codeloam.operators.ordering import first_per_key, greedy_budget
from codeloam.plans.registry import query
from codeloam.session import load
from codeloam.sources.files import is_doc_file, is_plain_file

SPLIT_FILE = "regexp_extract(file, '([^/\\\\]*)$', 1)"
EDGES = "SELECT project, src, dst, min(edge_ord) AS edge_ord FROM call_edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL"
SEEDS = """seeds AS (SELECT project, src AS symbol, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, src) AS ord FROM e GROUP BY project, src QUALIFY ord <= 3)"""
POINT = r"regexp_replace(id, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
QUESTION = "Where does the orchard vector kernel load its config?"


@query(
    rf"""
SELECT chunk_row, substr(sha256(concat(file, '::', CASE WHEN lower(type) = 'file' THEN '<file>' ELSE coalesce(symbol, '<file>') END)), 1, 32) AS chunk_id,
       {POINT} AS point_id, concat('code-', substr(sha256(project || coalesce(chr(10) || branch, '')), 1, 8)) AS collection
FROM code_chunks"""
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "code_chunks")
    symbol = F.when(F.lower("type") == "file", F.lit(None)).otherwise(F.col("symbol"))
    return c.select("chunk_row", T.chunk_id(F.col("file"), symbol).alias("chunk_id"), T.uuid_form(F.col("id")).alias("point_id"), T.collection_name("code", F.col("project"), F.col("branch")).alias("collection"))


@query(
    r"""
WITH f AS (SELECT DISTINCT project, file, regexp_extract(file, '([^/\\]*)$', 1) AS base, octet_length(encode(code)) AS bytes FROM code_chunks WHERE lower(type) = 'file' AND code IS NOT NULL)
SELECT project, file, bytes FROM f
WHERE bytes <= 32000 AND NOT starts_with(base, '.env')
  AND (base IN ('Makefile','Dockerfile','docker-compose.yml','docker-compose.yaml','.dockerignore','.gitignore','.npmrc','.nvmrc','.editorconfig')
       OR lower(regexp_extract(base, '\.([^.]+)$', 1)) IN ('json','yaml','yml','toml','sh','bash','dockerfile','conf','ini','xml','md','mdx'))"""
)
def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "code_chunks").where((F.lower("type") == "file") & F.col("code").isNotNull())
    f = f.select("project", "file", F.octet_length("code").cast("long").alias("bytes")).distinct()
    return f.where(is_plain_file(F.col("file"), F.col("bytes")))


@query(
    r"""
WITH f AS (SELECT DISTINCT source, path, regexp_extract(path, '([^/\\]*)$', 1) AS base, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL AND path IS NOT NULL)
SELECT source, path, bytes FROM f WHERE bytes <= 96000 AND NOT starts_with(base, '.env')
  AND (base IN ('README','README.md','README.mdx','CHANGELOG','CHANGELOG.md','CHANGELOG.txt','HISTORY','HISTORY.md','ROADMAP.md','NOTES.md','RUNBOOK.md') OR lower(regexp_extract(base, '\.([^.]+)$', 1)) IN ('md','mdx','txt'))"""
)
def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "documents").where("text IS NOT NULL AND path IS NOT NULL").select("source", "path", F.octet_length("text").cast("long").alias("bytes")).distinct()
    return f.where(is_doc_file(F.col("path"), F.col("bytes")))


@query(
    r"""
SELECT DISTINCT project, file FROM code_chunks
WHERE NOT regexp_matches(replace(file, '\', '/'), '(^|/)tests($|/)') AND NOT regexp_matches(replace(file, '\', '/'), '(^|/)[^/]*[.]lock[.]json($|/)') AND NOT regexp_matches(replace(file, '\', '/'), '^packages/[^/]*/vendor($|/)')"""
)
def ignore_rule_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloam.sources.files import drop_ignored

    files = load(spark, sf_dir, "code_chunks").select("project", "file").distinct().withColumn("rel", F.replace(F.col("file"), F.lit("\\"), F.lit("/")))
    rules = spark.createDataFrame([("", "tests"), ("", "*.lock.json"), ("", "/packages/*/vendor")], "dir string, rule string")
    return drop_ignored(files, rules, "rel").select("project", "file")


@query(
    """
SELECT project, file, arg_min(mtime_ms, CASE WHEN mtime_ms IS NOT NULL THEN chunk_row END) AS mtime_ms, array_to_string(list_sort(list(DISTINCT id)), ',') AS chunk_ids
FROM code_chunks WHERE file IS NOT NULL AND id IS NOT NULL GROUP BY ALL"""
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = incremental.build_manifest(load(spark, sf_dir, "code_chunks"))
    return m.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


STALE = """
WITH new AS (SELECT project, file, arg_min(mtime_ms, CASE WHEN mtime_ms IS NOT NULL THEN chunk_row END) AS new_mtime FROM code_chunks WHERE file IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
j AS (SELECT o.project, o.file, unnest(o.chunk_ids) AS chunk_id, CASE WHEN n.file IS NULL THEN 'gone' ELSE 'changed' END AS reason
      FROM file_manifest o LEFT JOIN new n ON o.project = n.project AND o.file = n.file
      WHERE o.file IS NOT NULL AND (n.file IS NULL OR (o.mtime_ms IS NOT NULL AND o.mtime_ms IS DISTINCT FROM n.new_mtime)))
SELECT DISTINCT * FROM j WHERE chunk_id IS NOT NULL"""


@query(STALE)
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = incremental.build_manifest(load(spark, sf_dir, "code_chunks"))
    return incremental.stale_chunks(load(spark, sf_dir, "file_manifest"), new)


@query(
    """
WITH known AS (SELECT DISTINCT project, unnest(chunk_ids) AS id FROM file_manifest WHERE NOT ends_with(file, '.ts'))
SELECT DISTINCT c.project, c.id FROM code_chunks c WHERE c.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known k WHERE k.project = c.project AND k.id = c.id)"""
)
def orphan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ids that the manifest does not know once its TypeScript files are gone."""
    known = load(spark, sf_dir, "file_manifest").where("NOT endswith(file, '.ts')").select("project", F.explode("chunk_ids").alias("id"))
    return incremental.orphan_ids(load(spark, sf_dir, "code_chunks"), known)


@query(
    """
WITH known AS (SELECT DISTINCT project, unnest(chunk_ids) AS id FROM file_manifest)
SELECT project, id FROM known k WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM code_chunks c WHERE c.project = k.project AND c.id = k.id)"""
)
def unstored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that the manifest knows but the store lost: the same difference the other way round."""
    known = load(spark, sf_dir, "file_manifest").select("project", F.explode("chunk_ids").alias("id"))
    return incremental.orphan_ids(known, load(spark, sf_dir, "code_chunks"))


@query(
    """
SELECT project, id, max(chunk_row) AS chunk_row FROM code_chunks c WHERE id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.project = c.project AND v.id = c.id) GROUP BY ALL"""
)
def uncached_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.uncached(load(spark, sf_dir, "code_chunks"), load(spark, sf_dir, "chunk_vectors"))


@query(
    """
WITH s AS (SELECT project, count(DISTINCT file) AS files, count(DISTINCT id) AS chunks, count(DISTINCT symbol) AS symbols FROM code_chunks GROUP BY ALL),
e AS (SELECT project, count(*) AS edges FROM (SELECT DISTINCT project, src, dst FROM call_edges WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY ALL)
SELECT s.*, coalesce(e.edges, 0) AS edges FROM s LEFT JOIN e USING (project)"""
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "code_chunks").groupBy("project").agg(F.countDistinct("file").alias("files"), F.countDistinct("id").alias("chunks"), F.countDistinct("symbol").alias("symbols"))
    e = graph.distinct_edges(load(spark, sf_dir, "call_edges")).groupBy("project").agg(F.count("*").alias("edges"))
    return s.join(e, "project", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@query(f"WITH e AS ({EDGES}) SELECT project, src AS symbol, dst AS callee, edge_ord FROM e")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callees(load(spark, sf_dir, "call_edges"))


@query(
    f"""WITH e AS ({EDGES}), {SEEDS}, o AS (SELECT project, src AS symbol, string_agg(dst, ',' ORDER BY edge_ord, dst) AS callees FROM e GROUP BY ALL), i AS (SELECT project, dst AS symbol, string_agg(src, ',' ORDER BY edge_ord, src) AS callers FROM e GROUP BY ALL)
SELECT project, symbol, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers FROM seeds LEFT JOIN o USING (project, symbol) LEFT JOIN i USING (project, symbol)"""
)
def neighbours_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees and callers of the listed symbols."""
    edges = load(spark, sf_dir, "call_edges")
    found = graph.with_neighbours(_seeds(edges).select("project", "symbol"), edges)
    return found.select("project", "symbol", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


@query(f"WITH e AS ({EDGES}) SELECT project, dst AS symbol, src AS caller, edge_ord FROM e")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inverse(load(spark, sf_dir, "call_edges"))


DEGREES = f"""e AS ({EDGES}), d AS (
SELECT project, symbol, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT project, src AS symbol, 1 AS o, 0 AS i FROM e UNION ALL SELECT project, dst, 0, 1 FROM e) GROUP BY ALL)"""


@query(f"WITH {DEGREES} SELECT * FROM d")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(load(spark, sf_dir, "call_edges"))


@query(
    f"""WITH {DEGREES}, s AS (SELECT DISTINCT project, file, symbol FROM code_chunks WHERE symbol IS NOT NULL)
SELECT s.project, s.file, string_agg(s.symbol || ' ' || coalesce(out_degree, 0) || ' ' || coalesce(in_degree, 0), ',' ORDER BY s.symbol) AS symbols
FROM s LEFT JOIN d USING (project, symbol) GROUP BY ALL"""
)
def symbols_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.symbols_by_file(load(spark, sf_dir, "code_chunks"), load(spark, sf_dir, "call_edges"))
    return s.withColumn("symbols", F.array_join(F.transform("symbols", lambda x: F.concat_ws(" ", x["symbol"], x["out_degree"], x["in_degree"])), ","))



def _seeds(edges: DataFrame) -> DataFrame:
    """The three symbols of each project that call most others."""
    counted = graph.distinct_edges(edges).groupBy("project", F.col("src").alias("symbol")).agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("project").orderBy(F.col("n").desc(), "symbol")
    return counted.withColumn("ord", F.row_number().over(w)).where("ord <= 3").select("project", "symbol", "ord")


def _bfs_sql(direction: str, hops: int = 2) -> str:
    arcs = {"out": "SELECT project, src AS a, dst AS b, 0 AS way, edge_ord FROM e", "in": "SELECT project, dst AS a, src AS b, 1 AS way, edge_ord FROM e"}
    arc = " UNION ALL ".join(arcs[d] for d in (("out", "in") if direction == "both" else (direction,)))
    parts, seen = [], "SELECT project, symbol, 0 AS hop, ord AS pos FROM seeds"
    for h in range(1, hops + 1):
        parts.append(f"v{h} AS ({seen})")
        parts.append(
            f"""h{h} AS (SELECT f.project, f.symbol, {h} AS hop, f.n + (SELECT count(*) FROM v{h} v WHERE v.project = f.project) AS pos FROM (
            SELECT project, symbol, row_number() OVER (PARTITION BY project ORDER BY k, symbol) AS n FROM (
              SELECT l.project, x.b AS symbol, min(row(l.pos, x.way, x.edge_ord)) AS k FROM v{h} l JOIN arcs x ON x.project = l.project AND x.a = l.symbol WHERE l.hop = {h - 1}
              AND NOT EXISTS (SELECT 1 FROM v{h} v WHERE v.project = l.project AND v.symbol = x.b) GROUP BY ALL)) f)"""
        )
        seen = f"SELECT * FROM v{h} UNION ALL SELECT * FROM h{h} WHERE pos <= 60"
    return f"WITH e AS ({EDGES}), {SEEDS}, arcs AS ({arc}), {', '.join(parts)} SELECT project, symbol, CAST(hop AS INTEGER) AS hop, CAST(pos AS INTEGER) AS pos FROM ({seen})"


def _bfs(direction: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = load(spark, sf_dir, "call_edges")
        return graph.expand_graph(edges, _seeds(edges), 2, direction)

    return run


for _d in ("out", "in", "both"):
    query(_bfs_sql(_d), name=f"bfs_{_d}")(_bfs(_d))


@query(
    f"""WITH e AS ({EDGES}), {SEEDS}, one AS (SELECT DISTINCT e.project, dst AS symbol FROM seeds s JOIN e ON e.project = s.project AND e.src = s.symbol),
two AS (SELECT DISTINCT e.project, dst AS symbol FROM one s JOIN e ON e.project = s.project AND e.src = s.symbol),
back AS (SELECT DISTINCT e.project, src AS symbol FROM seeds s JOIN e ON e.project = s.project AND e.dst = s.symbol)
SELECT * FROM (FROM one UNION FROM two UNION FROM back) x WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.project = x.project AND s.symbol = x.symbol)"""
)
def retrieval_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "call_edges")
    return graph.retrieval_expand(edges, _seeds(edges))


@query(
    f"""WITH e AS ({EDGES}), w AS (SELECT DISTINCT project, dst AS symbol FROM e),
f AS (SELECT project, symbol, file, type, chunk_row FROM (SELECT *, {POINT} AS point_id FROM code_chunks WHERE symbol IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY project, symbol ORDER BY point_id, chunk_row) = 1)
SELECT w.project, w.symbol, coalesce(f.file, '?') AS file, coalesce(f.type, 'unknown') AS type, f.chunk_row FROM w LEFT JOIN f USING (project, symbol)"""
)
def first_chunk_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = graph.distinct_edges(load(spark, sf_dir, "call_edges")).select("project", F.col("dst").alias("symbol"))
    return retrieval.first_chunk_per_symbol(load(spark, sf_dir, "code_chunks"), wanted)


@query(
    f"""WITH e AS ({EDGES}), {SEEDS} SELECT c.project, c.symbol, c.chunk_row FROM (SELECT *, {POINT} AS point_id FROM code_chunks) c SEMI JOIN seeds USING (project, symbol)
QUALIFY row_number() OVER (PARTITION BY c.project ORDER BY point_id, chunk_row) <= 9"""
)
def symbol_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _seeds(load(spark, sf_dir, "call_edges"))
    return retrieval.get_symbols(load(spark, sf_dir, "code_chunks"), wanted, 9).select("project", "symbol", "chunk_row")


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT project, dst AS symbol FROM e WHERE NOT EXISTS (SELECT 1 FROM code_chunks c WHERE c.project = e.project AND c.symbol = e.dst)")
def missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = graph.distinct_edges(load(spark, sf_dir, "call_edges")).select("project", F.col("dst").alias("symbol"))
    return retrieval.missing_symbols(load(spark, sf_dir, "code_chunks"), wanted)


@query(
    f"""WITH e AS ({EDGES}), {SEEDS}, w AS (SELECT DISTINCT e.project, dst AS symbol FROM seeds s JOIN e ON e.project = s.project AND e.src = s.symbol),
t AS (SELECT c.*, {POINT} AS point_id FROM code_chunks c SEMI JOIN w USING (project, symbol) QUALIFY row_number() OVER (PARTITION BY project ORDER BY point_id, chunk_row) <= 20),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY project, symbol ORDER BY point_id, chunk_row) = 1)
SELECT project, symbol, chunk_row FROM f WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.project = f.project AND s.symbol = f.symbol)"""
)
def related_cap20(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "call_edges")
    seeds = _seeds(edges)
    calls = graph.distinct_edges(edges).select("project", F.col("src").alias("symbol"), F.col("dst").alias("to"))
    wanted = seeds.join(calls, ["project", "symbol"]).select("project", F.col("to").alias("symbol"))
    return retrieval.related_chunks(load(spark, sf_dir, "code_chunks"), wanted, seeds).select("project", "symbol", "chunk_row")


@query(
    f"""SELECT project, file, chunk_row, -row_number() OVER (PARTITION BY project ORDER BY point_id, chunk_row) AS pos FROM (SELECT *, {POINT} AS point_id FROM code_chunks)
WHERE type = 'file' AND (contains(file, 'orchard') OR contains(file, 'vector') OR contains(file, 'kernel') OR contains(file, 'load') OR contains(file, 'its') OR contains(file, 'config?')) QUALIFY pos >= -200"""
)
def file_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.file_token_matches(load(spark, sf_dir, "code_chunks"), QUESTION).select("project", "file", "chunk_row", F.col("pos").cast("long").alias("pos"))


@query(
    f"""SELECT project, file, symbol, type, chunk_row FROM (SELECT *, {POINT} AS point_id, first_value(file) OVER (PARTITION BY project ORDER BY file) AS wanted FROM code_chunks)
WHERE file = wanted QUALIFY row_number() OVER (PARTITION BY project ORDER BY point_id, chunk_row) <= 100"""
)
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "code_chunks")
    wanted = c.groupBy("project").agg(F.min("file").alias("file"))
    hit = retrieval.with_point(c).join(wanted, ["project", "file"], "left_semi")
    return first_per_key(hit, ["project"], "point_id", "chunk_row", n=100).select("project", "file", "symbol", "type", "chunk_row")


@query(
    r"""WITH RECURSIVE r AS (SELECT project, chunk_row, coalesce(length(code) + length(regexp_replace(code, '[^\x{10000}-\x{10FFFF}]', '', 'g')), 0) AS s, row_number() OVER (PARTITION BY project ORDER BY chunk_row) AS n FROM code_chunks),
w AS (SELECT project, chunk_row, n, CASE WHEN s <= 12000 THEN s ELSE 0 END AS used, s <= 12000 AS kept FROM r WHERE n = 1
      UNION ALL SELECT r.project, r.chunk_row, r.n, CASE WHEN w.used + r.s <= 12000 THEN w.used + r.s ELSE w.used END, w.used + r.s <= 12000 FROM w JOIN r ON r.project = w.project AND r.n = w.n + 1)
SELECT project, chunk_row, CAST(used AS BIGINT) AS used FROM w WHERE kept"""
)
def greedy_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of a project in order, cut to the size budget in UTF-16 units."""
    sized = load(spark, sf_dir, "code_chunks").withColumn("size", T.utf16_length(F.col("code")))
    return greedy_budget(sized, "project", "size", "chunk_row")


@query(
    """WITH r AS (SELECT row_number() OVER () AS n, l_orderkey, l_linenumber, l_linenumber AS a, l_linenumber + CAST(l_quantity AS BIGINT) % 3 AS b FROM lineitem),
h AS (SELECT l_orderkey, l_linenumber + CAST(l_quantity AS BIGINT) % 2 AS a, l_linenumber + 1 AS b FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM r WHERE EXISTS (SELECT 1 FROM h WHERE h.l_orderkey = r.l_orderkey AND r.a <= h.b AND h.a <= r.b AND h.a <= h.b)"""
)
def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    ranges = li.select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("start_line"), (F.col("l_linenumber") + q % 3).alias("end_line"))
    hunks = li.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_linenumber") + q % 2).alias("start"), (F.col("l_linenumber") + 1).cast("long").alias("end"))
    return intervals.touched_symbols(ranges, hunks, ["l_orderkey"])


@query(
    """WITH s AS (SELECT DISTINCT project, file, symbol FROM code_chunks WHERE symbol IS NOT NULL)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.project = s.project AND o.file = s.file AND (starts_with(o.symbol, s.symbol || '.') OR starts_with(o.symbol, s.symbol || '::')))"""
)
def prune_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "code_chunks").where("symbol IS NOT NULL").groupBy("project", "file").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return per.select("project", "file", F.explode(intervals.prune_parents(F.col("symbols"))).alias("symbol"))


@query(
    """SELECT project, imports.unnest AS import, count(DISTINCT file) AS files FROM code_chunks, unnest(imports) AS imports GROUP BY ALL"""
)
def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "code_chunks")
    return c.select("project", "file", F.explode("imports").alias("import")).groupBy("project", "import").agg(F.countDistinct("file").alias("files"))


@query("SELECT chunk_row, sha256(concat('file: ', coalesce(file, ''), chr(10), coalesce(symbol, ''), chr(10), chr(10), coalesce(code, ''))) AS text_hash FROM code_chunks")
def chunk_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "code_chunks")
    return c.select("chunk_row", F.sha2(T.chunk_embedding_text(F.col("file"), F.col("symbol"), F.col("code")), 256).alias("text_hash"))


def _whole_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "code_chunks").where((F.lower("type") == "file") & F.lower("file").rlike(r"\.(ts|tsx|js|jsx|php)$"))
    return c.select("project", "file", F.col("code").alias("text")).distinct()


def extracted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol chunks cut from every whole source file."""
    from codeloam.extract.source import extract_chunks

    return extract_chunks(_whole_sources(spark, sf_dir), ["project"]).select("project", "id", "file", "symbol", "type", "start_line", "end_line", F.sha2("code", 256).alias("code_hash"))


def extracted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codeloam.extract.source import symbol_ranges

    return symbol_ranges(_whole_sources(spark, sf_dir), ["project"])


def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges of every whole source file."""
    from codeloam.extract.source import call_edges

    return call_edges(_whole_sources(spark, sf_dir), ["project"])


for _f in (extracted_chunks, extracted_ranges, extracted_edges):
    query()(_f)
