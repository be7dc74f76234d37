"""Queries over parsers and the composed question path. Inputs that no table has are literal rows; their
SQL gives the expected rows, worked out by hand, or the same computation where SQL has one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloam.extract import diff, source
from codeloam.functions import constants as K
from codeloam.functions import text as T
from codeloam.operators import graph, intervals, memory, retrieval, vectors
from codeloam.plans.code import EDGES, POINT, QUESTION
from codeloam.plans.history import AS_OF, CHANGES, IS_FEATURE
from codeloam.plans.registry import query
from codeloam.session import load
from codeloam.sources import snapshots


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """The rows as a SQL statement."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = ["INTEGER" if c.endswith(" int") else "VARCHAR" for c in columns.split(", ")]
    picked = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(zip(names, types)))
    return f"SELECT {picked} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({', '.join(f'c{i}' for i in range(len(names)))})"


TS = """import { a, b } from './util';
import fs from 'node:fs';
export class AuthService {
  private limit = 3;
  constructor(private db: Db) { super(); }
  login(user: string): { ok: boolean } {
    const re = /[{(]+$/.test(user); // } not a brace
    const s = `text ${this.check(user)} } ${require('x')('y')}`;
    return this.db.find({ user, s: "}" });
  }
  check = (u: string) => validate(u) && new Foo(u);
  get size() { return 1; }
}
export default function () { return init(); }
async function outer<T>(x: T): Promise<T> {
  function inner() { return deep(); }
  await import('./lazy');
  return inner?.() ?? x;
}
const run = async (n: number) => { other(n); };
const api = { start: function () { boot(); }, stop() { halt(); } };
"""
PHP = r"""<?php
namespace App\Auth;
use App\Db\Pool as P;
use App\Log\{Writer, Reader};
function boot(int $n) { return helper($n); }
final class Login extends Base implements Gate {
    public function run($x) {
        self::check($x); parent::run($x); Other::make(); $this->check($x); $x->send();
        $s = "a } $x"; // }
        new Foo(bar());
        return check($s);
    }
    abstract protected function check($y);
}
interface Gate { public function run($x); }
trait Loud { function shout() {} }
"""
TOUCHED = "class AuthService {\n  login() {\n    validate();\n    return true;\n  }\n\n  logout() {\n    return false;\n  }\n}\n\nfunction validate() {\n  return true;\n}"


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src/a.ts", TS), ("src/a.php", PHP), ("src/plain.php", "no tag"), ("src/empty.js", ""), ("src/none.ts", None)], "file string, text string")


@query(
    _values(
        "file string, symbol string, type string, start_line int, end_line int, imports string",
        [
            ("src/a.ts", "<anonymous>", "function", 14, 14, "./util,node:fs"), ("src/a.ts", "outer", "function", 15, 19, "./util,node:fs"), ("src/a.ts", "AuthService", "class", 3, 13, "./util,node:fs"), ("src/a.ts", "AuthService.login", "method", 6, 10, "./util,node:fs"),
            *(("src/a.php", f"App\\Auth\\{s}", t, a, b, "App\\Db\\Pool,App\\Log\\Writer,App\\Log\\Reader") for s, t, a, b in [("boot", "function", 5, 5), ("Login", "class", 6, 14), ("Login::run", "method", 7, 12), ("Login::check", "method", 13, 13), ("Gate", "class", 15, 15), ("Gate::run", "method", 15, 15), ("Loud", "class", 16, 16), ("Loud::shout", "method", 16, 16)]),
            ("src/plain.php", "src/plain.php", "file", 1, 1, ""),
        ],
    )
)
def parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a TypeScript and a PHP source."""
    c = source.extract_chunks(_sources(spark))
    return c.select("file", "symbol", "type", "start_line", "end_line", F.array_join("imports", ",").alias("imports"))


_LOGIN = "App\\Auth\\Login"


@query(
    _values(
        "src string, dst string, edge_ord int",
        [
            ("outer", "deep", 0), ("outer", "import", 1), ("outer", "inner", 2), ("AuthService.check", "validate", 3), ("run", "other", 4), ("start", "boot", 5), ("AuthService.login", "test", 6), ("AuthService.login", "AuthService.check", 7), ("AuthService.login", "require", 8), ("AuthService.login", "find", 9),
            ("App\\Auth\\boot", "helper", 0), (f"{_LOGIN}::run", f"{_LOGIN}::check", 1), (f"{_LOGIN}::run", f"{_LOGIN}::run", 2), (f"{_LOGIN}::run", "Other::make", 3), (f"{_LOGIN}::run", "send", 4), (f"{_LOGIN}::run", "bar", 5),
        ],
    )
)
def parsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the same sources."""
    return source.call_edges(_sources(spark)).select("src", "dst", "edge_ord")


@query(
    _values(
        "file string, symbol string, kind string, start_line int, end_line int",
        [
            ("src/a.ts", "outer", "function", 15, 19), ("src/a.ts", "AuthService", "class", 3, 13), ("src/a.ts", "AuthService.login", "method", 6, 10), ("src/a.ts", "AuthService.check", "method", 11, 11), ("src/a.ts", "run", "function", 20, 20), ("src/a.ts", "start", "function", 21, 21),
            *(("src/a.php", f"App\\Auth\\{s}", t, a, b) for s, t, a, b in [("boot", "function", 5, 5), ("Login", "class", 6, 14), ("Login::run", "method", 7, 12), ("Login::check", "method", 13, 13), ("Gate", "class", 15, 15), ("Gate::run", "method", 15, 15), ("Loud", "class", 16, 16), ("Loud::shout", "method", 16, 16)]),
        ],
    )
)
def parsed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of the same sources."""
    return source.symbol_ranges(_sources(spark)).select("file", "symbol", "kind", "start_line", "end_line")


@query(_values("case_no int, symbols string, hints string", [(1, "AuthService.login", "login flow"), (2, "validate", "validate helper"), (3, "AuthService", "fields"), (4, "", "removed")]))
def semantic_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose lines a patch meets, parents pruned."""
    hunk = "old_start int, old_count int, new_start int, new_count int, header string"
    cases = spark.createDataFrame(
        [(1, TOUCHED, [(2, 4, 2, 4, "login flow")]), (2, TOUCHED, [(12, 3, 12, 3, "validate helper"), (12, 1, 12, 1, "  validate helper ")]), (3, TOUCHED, [(1, 0, 1, 1, "fields"), (10, 1, 10, 1, "ok")]), (4, TOUCHED, [(0, 0, 0, 0, "removed")])],
        f"case_no int, text string, hunks array<struct<{hunk.replace(' int', ':int').replace(' string', ':string')}>>",
    )
    ranges = source.symbol_ranges(cases.select("case_no", F.lit("src/auth.ts").alias("file"), "text"), ["case_no"])
    hunks = cases.select("case_no", F.explode(T.hunk_ranges(F.col("hunks"), "new")).alias("h")).select("case_no", "h.start", "h.end")
    touched = intervals.touched_symbols(ranges, hunks, ["case_no"]).groupBy("case_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "symbol"))), lambda x: x["symbol"]).alias("s"))
    joined = cases.join(touched, "case_no", "left")
    return joined.select("case_no", F.array_join(intervals.prune_parents(F.array_distinct(T.items("s"))), ",").alias("symbols"), F.array_join(T.hunk_hints(F.col("hunks")), ",").alias("hints"))


HEADERS = ["@@ -3,0 +4,2 @@ class A {", "@@ -10 +12,0 @@ run()", "@@ -1,3 +0,0 @@", "@@ -7 +7 @@", "-- no header", "@@ broken @@"]


@query(
    f"""WITH v AS (SELECT unnest([{', '.join(map(_literal, HEADERS))}]) AS line), r AS (SELECT line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@ ?(.*)$' AS p FROM v)
SELECT line, try_cast(regexp_extract(line, p, 1) AS INTEGER) AS old_start, CAST(coalesce(nullif(regexp_extract(line, p, 2), ''), '1') AS INTEGER) AS old_count, try_cast(regexp_extract(line, p, 3) AS INTEGER) AS new_start,
CAST(coalesce(nullif(regexp_extract(line, p, 4), ''), '1') AS INTEGER) AS new_count, trim(regexp_extract(line, p, 5)) AS header FROM r WHERE regexp_matches(line, p)"""
)
def hunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunk header lines."""
    lines = spark.createDataFrame([(x,) for x in HEADERS], "line string").where(F.col("line").rlike(T.HUNK))
    return lines.select("line", T.hunk(F.col("line")).alias("h")).select("line", "h.*")


PATHS = ["a/src/x.ts", "b/y.php", '"a/with space.ts"', "src/a/z", '"b/q"', ""]


@query(f"SELECT p, regexp_replace(regexp_replace(p, '^\"|\"$', '', 'g'), '^[ab]/', '') AS path FROM (SELECT unnest([{', '.join(map(_literal, PATHS))}]) AS p)")
def diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of diff lines without quotes and sides."""
    return spark.createDataFrame([(x,) for x in PATHS], "p string").select("p", T.diff_path(F.col("p")).alias("path"))


DIFF = """diff --git a/src/a.ts b/src/a.ts
index 1..2 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -3,0 +4,2 @@ class A {
+x
+y
@@ -10 +12,0 @@ run()
--- looks like a header
diff --git a/new.md b/new.md
new file mode 100644
--- /dev/null
+++ b/new.md
@@ -0,0 +1 @@
+hello
diff --git "a/old name.ts" "b/old name.ts"
deleted file mode 100644
--- "a/old name.ts"
+++ /dev/null
@@ -1,3 +0,0 @@
-a
diff --git a/from.ts b/to.ts
similarity index 90%
rename from from.ts
rename to to.ts
"""


@query(_values("file_no int, path string, old_path string, status string, hunks string", [(1, "src/a.ts", None, "M", "3,0,4,2;10,1,12,0"), (2, "new.md", None, "A", "0,0,1,1"), (3, "old name.ts", None, "D", "1,3,0,0"), (4, "to.ts", "from.ts", "R", "")]))
def diff_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File patches of a unified diff."""
    p = diff.parse_patches(spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "n int, d string"), ["n"], "d")
    return p.select(F.col("file_no").cast("int").alias("file_no"), "path", "old_path", "status", F.array_join(F.transform("hunks", lambda h: F.concat_ws(",", h["old_start"], h["old_count"], h["new_start"], h["new_count"])), ";").alias("hunks"))


LOG = "s1\x1fp1 p2\x1fAnn\x1fa@x\x1f2024-01-01T00:00:00+05:30\x1ffix it\x1fline 1\nline 2\n\x1e\ns2\x1f\x1fBob\x1fb@x\x1f2023-01-01T00:00:00Z\x1froot\x1f\x1e\n"


@query(_values("log_pos int, sha string, parents string, author_name string, timestamp string, title string, body string", [(0, "s1", "p1,p2", "Ann", "2024-01-01T00:00:00+05:30", "fix it", "line 1\nline 2"), (1, "s2", "", "Bob", "2023-01-01T00:00:00Z", "root", "")]))
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of a log text."""
    c = diff.parse_commits(spark.createDataFrame([(1, LOG)], "k int, t string"), ["k"], "t")
    return c.select(F.col("log_pos").cast("int").alias("log_pos"), "sha", F.array_join("parents", ",").alias("parents"), "author_name", "timestamp", "title", "body")


STATUS = [" M a.ts", "?? b.md", "R  old.ts -> new.ts", "D  gone.ts", "   odd.ts", "x"]


@query(f"SELECT regexp_replace(substr(l, 4), '^.* -> ', '') AS path, CASE WHEN trim(substr(l, 1, 2)) = '' THEN '??' ELSE trim(substr(l, 1, 2)) END AS status FROM (SELECT unnest([{', '.join(map(_literal, STATUS))}]) AS l) WHERE length(l) > 3")
def working_tree_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files of a status listing."""
    return diff.parse_status(spark.createDataFrame([(x,) for x in STATUS], "l string"), "l")


@query("SELECT chunk_row, sha256(coalesce(array_to_string(list_slice(string_split(code, chr(10)), 2, 4), chr(10)), '')) AS lines_hash FROM code_chunks WHERE code IS NOT NULL")
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every chunk."""
    c = load(spark, sf_dir, "code_chunks").where("code IS NOT NULL")
    return c.select("chunk_row", F.sha2(T.line_slice(F.col("code"), F.lit(2), F.lit(4)), 256).alias("lines_hash"))


@query(_values("n int, old_side int", [(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]))
def old_side_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a patch is read on its old side."""
    hunk = "array<struct<old_start:int,old_count:int,new_start:int,new_count:int,header:string>>"
    rows = [(1, "D", []), (2, "M", [(3, 2, 2, 0, ""), (9, 1, 7, 0, "")]), (3, "M", [(3, 2, 2, 0, ""), (9, 1, 7, 1, "")]), (4, "M", []), (5, "M", [(3, 0, 2, 0, "")])]
    return spark.createDataFrame(rows, f"n int, status string, hunks {hunk}").select("n", T.prefers_old_revision(F.col("status"), F.col("hunks")).cast("int").alias("old_side"))


@query(
    f"""WITH {CHANGES}, a AS (SELECT project, id, change_type AS shown, sha AS source FROM changes),
d AS (SELECT DISTINCT project, id, doc_type || ' doc' AS shown, CASE WHEN coalesce(section, '') <> '' AND section <> regexp_extract(path, '([^/\\\\]*)$', 1) THEN path || ' > ' || section ELSE path END AS source FROM document_entries)
SELECT * FROM a UNION ALL SELECT * FROM d"""
)
def entry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and source of each entry as they are shown."""
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"])
    d = load(spark, sf_dir, "document_entries")
    every = c.select("project", "id", "kind", "sha", "change_type").unionByName(d.select("project", "id", "kind", "path", "section", "doc_type").distinct(), allowMissingColumns=True)
    col = F.col
    return every.select("project", "id", T.entry_type(col("kind"), col("change_type"), col("doc_type")).alias("shown"), T.entry_source(col("kind"), col("sha"), col("path"), col("section")).alias("source"))


@query("SELECT project, entry_row, row_number() OVER (PARTITION BY project ORDER BY source_mtime_ms DESC NULLS LAST, path, entry_row) AS pos FROM document_entries")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the time their file was changed (O2)."""
    d = load(spark, sf_dir, "document_entries").withColumn("section_no", F.col("entry_row"))
    return memory.by_change_of_file(d).select("project", "entry_row", F.col("pos").cast("long").alias("pos"))


@query(_values("project string, latest_sha string", [("p", "b"), ("q", "z")]))
def newest_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commit in log order, whatever its time (O3)."""
    rows = [("p", "change", "a", 1, "2025-01-01"), ("p", "change", "b", 0, "2020-01-01"), ("p", "document", None, None, "2026-01-01"), ("q", "change", "z", 5, "2020-01-01")]
    return memory.log_newest(spark.createDataFrame(rows, "project string, kind string, sha string, log_pos int, timestamp string"))


@query("SELECT file, arg_max(mtime_ms, mtime_ms) AS mtime_ms, array_to_string(list_sort(list(DISTINCT id)), ',') AS chunk_ids FROM (SELECT project || '/' || file AS file, mtime_ms, unnest(chunk_ids) AS id FROM file_manifest) WHERE file IS NOT NULL AND id IS NOT NULL GROUP BY file")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of all projects written as JSON, one document a project, and read again."""
    m = load(spark, sf_dir, "file_manifest").select("project", F.concat_ws("/", "project", "file").alias("file"), "mtime_ms", F.explode("chunk_ids").alias("id")).where("file IS NOT NULL AND id IS NOT NULL")
    whole = m.groupBy("project", "file").agg(F.max("mtime_ms").alias("mtime_ms"), F.array_sort(F.collect_set("id")).alias("chunk_ids"))
    read = snapshots.parse_manifest(snapshots.manifest_json(whole, ["project"]).select("json"), "json")
    return read.select("file", "mtime_ms", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("SELECT project, symbol, arg_max(file, row(ends_with(lower(file), '.php'), file, chunk_row)) AS file FROM code_chunks WHERE symbol IS NOT NULL AND lower(type) IN ('function', 'method') GROUP BY ALL")
def symbol_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each symbol is defined, last definition first."""
    c = load(spark, sf_dir, "code_chunks").where(F.lower("type").isin("function", "method"))
    return retrieval.symbol_files(c.withColumn("def_ord", F.col("chunk_row")))


@query(
    f"""WITH e AS ({EDGES}), w AS (SELECT DISTINCT project, dst AS symbol FROM e),
d AS (SELECT project, symbol, arg_max(file, row(ends_with(lower(file), '.php'), file, chunk_row)) AS file FROM code_chunks WHERE symbol IS NOT NULL GROUP BY ALL),
f AS (SELECT project, symbol, file, type, chunk_row FROM (SELECT *, {POINT} AS point_id FROM code_chunks WHERE symbol IS NOT NULL AND type = 'method') QUALIFY row_number() OVER (PARTITION BY project, symbol ORDER BY point_id, chunk_row) = 1)
SELECT w.project, w.symbol, coalesce(f.file, d.file, '?') AS file, coalesce(f.type, 'unknown') AS type, f.chunk_row FROM w LEFT JOIN f USING (project, symbol) LEFT JOIN d USING (project, symbol)"""
)
def expanded_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of an expansion over an index of methods only: others fall back to their definition."""
    c = load(spark, sf_dir, "code_chunks")
    wanted = graph.distinct_edges(load(spark, sf_dir, "call_edges")).select("project", F.col("dst").alias("symbol"))
    return retrieval.first_chunk_per_symbol(c.where("type = 'method'"), wanted, retrieval.symbol_files(c.withColumn("def_ord", F.col("chunk_row"))))


@query("SELECT project, file, count(DISTINCT symbol) AS symbols FROM code_chunks WHERE symbol IS NOT NULL AND contains(file, 'src') GROUP BY ALL")
def listed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of files whose path holds a text."""
    c = load(spark, sf_dir, "code_chunks").where(F.contains(F.col("file"), F.lit("src")))
    return graph.symbols_by_file(c, load(spark, sf_dir, "call_edges")).select("project", "file", F.size("symbols").cast("long").alias("symbols"))


@query(
    f"""WITH {CHANGES}, h AS (SELECT project, id, kind, title, NULL AS doc_type, change_type, (length(title) % 50) / 50.0 AS cosine, try_cast(timestamp AS TIMESTAMPTZ) AS moment FROM changes),
s AS (SELECT project, id, {K.COSINE_WEIGHT} * cosine + {K.FRESHNESS_WEIGHT} * coalesce(greatest(0, 1 - greatest(0, (epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(moment)) / 86400e6) / {K.CHANGE_DAYS}), 0)
 + CASE WHEN {IS_FEATURE} THEN {K.FACT_BONUS} ELSE 0 END + CASE WHEN change_type = 'fix' THEN {K.FIX_BONUS} ELSE 0 END AS score FROM h)
SELECT project, id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id, project LIMIT 20"""
)
def fix_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about a broken thing prefers fixes (V6 to V8)."""
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"])
    hits = c.withColumn("doc_type", F.lit(None).cast("string")).withColumn("at", memory.instant(F.col("timestamp"))).withColumn("cosine", (F.length("title") % 50) / F.lit(50.0)).withColumn("hit_pos", F.struct("id", "project"))
    ranked = memory.rerank(hits, "which fix repaired the broken build", AS_OF, 20)
    return ranked.select("project", "id", F.round("score", 6).alias("score"))


_UTF16 = "coalesce(length(code) + length(regexp_replace(code, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')), 0)"
TOKENS = " OR ".join(f"contains(file, '{t}')" for t in T.question_tokens(QUESTION))


@query(
    f"""WITH RECURSIVE e AS ({EDGES}), c AS (SELECT *, {POINT} AS point_id, {_UTF16} AS size FROM code_chunks),
u AS (SELECT vec_id, project, id, vector::DOUBLE[] AS v FROM chunk_vectors WHERE len(vector) = 384 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
q AS (SELECT v FROM u ORDER BY vec_id LIMIT 1), sim AS (SELECT project, id, max(round(list_cosine_similarity(u.v, q.v), 9)) AS score FROM u, q WHERE id IS NOT NULL GROUP BY ALL),
newest AS (SELECT project, id, max(chunk_row) AS chunk_row FROM code_chunks WHERE id IS NOT NULL GROUP BY ALL),
h AS (SELECT project, chunk_row, score FROM sim JOIN newest USING (project, id) QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, id) <= 5),
d AS (SELECT c.project, c.symbol, c.chunk_row, c.size, h.score, row_number() OVER (PARTITION BY c.project ORDER BY h.score DESC, c.chunk_row) AS pos FROM c JOIN h ON c.project = h.project AND c.chunk_row = h.chunk_row),
hits AS (SELECT DISTINCT project, symbol FROM d WHERE symbol IS NOT NULL),
one AS (SELECT DISTINCT e.project, dst AS symbol FROM hits s JOIN e ON e.project = s.project AND e.src = s.symbol),
two AS (SELECT DISTINCT e.project, dst AS symbol FROM one s JOIN e ON e.project = s.project AND e.src = s.symbol),
back AS (SELECT DISTINCT e.project, src AS symbol FROM hits s JOIN e ON e.project = s.project AND e.dst = s.symbol),
near AS (SELECT * FROM (FROM one UNION FROM two UNION FROM back) x WHERE NOT EXISTS (SELECT 1 FROM hits s WHERE s.project = x.project AND s.symbol = x.symbol)),
t AS (SELECT c.* FROM c SEMI JOIN near USING (project, symbol) QUALIFY row_number() OVER (PARTITION BY project ORDER BY point_id, chunk_row) <= 20),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY project, symbol ORDER BY point_id, chunk_row) = 1),
r AS (SELECT project, symbol, chunk_row, size, 0.0 AS score, 1000 + row_number() OVER (PARTITION BY project ORDER BY point_id, chunk_row) AS pos FROM f WHERE NOT EXISTS (SELECT 1 FROM hits s WHERE s.project = f.project AND s.symbol = f.symbol)),
found AS (FROM d UNION ALL FROM r),
n AS (SELECT project, symbol, chunk_row, size, 0.0 AS score, -row_number() OVER (PARTITION BY project ORDER BY point_id, chunk_row) AS pos FROM c WHERE type = 'file' AND ({TOKENS}) QUALIFY pos >= -200),
n1 AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.project = n.project AND x.symbol = n.symbol) QUALIFY row_number() OVER (PARTITION BY project, symbol ORDER BY pos DESC) = 1),
every AS (FROM found UNION ALL FROM n1), o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY pos) AS k FROM every),
w AS (SELECT project, k, CASE WHEN size <= 12000 THEN size ELSE 0 END AS used, size <= 12000 AS kept FROM o WHERE k = 1
 UNION ALL SELECT o.project, o.k, CASE WHEN w.used + o.size <= 12000 THEN w.used + o.size ELSE w.used END, w.used + o.size <= 12000 FROM w JOIN o ON o.project = w.project AND o.k = w.k + 1),
calls AS (SELECT project, src AS symbol, string_agg(dst, ',' ORDER BY edge_ord, dst) AS callees FROM e GROUP BY ALL), called AS (SELECT project, dst AS symbol, string_agg(src, ',' ORDER BY edge_ord, src) AS callers FROM e GROUP BY ALL)
SELECT o.project, CAST(o.pos AS BIGINT) AS pos, o.chunk_row, CAST(w.used AS BIGINT) AS used, round(o.score, 6) AS score, coalesce(callees, '') AS callees, coalesce(callers, '') AS callers
FROM w JOIN o USING (project, k) LEFT JOIN calls USING (project, symbol) LEFT JOIN called USING (project, symbol) WHERE w.kept"""
)
def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path of a code question in every project: vector hits, two calls out and one in, related
    chunks, file names, the size budget, callees and callers (C8, J4, J6, G4, O8, O9)."""
    chunks, edges, v = load(spark, sf_dir, "code_chunks"), load(spark, sf_dir, "call_edges"), load(spark, sf_dir, "chunk_vectors")
    usable = (F.size("vector") == K.VECTOR_DIMS) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    u = v.where(usable)
    first = u.orderBy("vec_id").limit(1).select(F.col("vector").alias("q"))  # one row
    sim = u.where("id IS NOT NULL").join(F.broadcast(first)).groupBy("project", "id").agg(F.max(F.round(vectors.cosine(F.col("vector"), F.col("q")), 9)).alias("score"))
    newest = chunks.where("id IS NOT NULL").groupBy("project", "id").agg(F.max("chunk_row").alias("chunk_row"))
    w = Window.partitionBy("project").orderBy(F.col("score").desc(), "id")
    hits = sim.join(newest, ["project", "id"]).withColumn("n", F.row_number().over(w)).where("n <= 5").select("project", "chunk_row", "score")
    found = graph.with_neighbours(retrieval.query_project(chunks, edges, hits, QUESTION), edges)
    return found.select("project", "pos", "chunk_row", "used", F.round("score", 6).alias("score"), F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


DOCS = [
    ("README.md", "intro line that is long enough\n# What It Does\nThe `login` service is the feature of it all\n```\n# not a heading\n```\n", 3000.0),
    ("docs/ARCHITECTURE.md", "# Architecture\nThe storage layout has three parts, see `src/store.ts` first", 2000.0), ("CHANGELOG.md", "## 1.2.0\nAdded the newest export of all reports", 1000.0), ("notes/empty.md", "# Nothing\n---\nshort", 500.0),
]


@query(
    _values(
        "path string, title string, doc_type string, symbols string, timestamp string",
        [("README.md", "README.md", "overview", "", "1970-01-01T00:00:03.000Z"), ("README.md", "What It Does", "feature", "login", "1970-01-01T00:00:03.000Z"), ("docs/ARCHITECTURE.md", "Architecture", "architecture", "src/store.ts", "1970-01-01T00:00:02.000Z"), ("CHANGELOG.md", "1.2.0", "changelog", "", "1970-01-01T00:00:01.000Z")],
    )
)
def built_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document entries of a few files."""
    files = spark.createDataFrame([("p", *d) for d in DOCS], "project string, path string, text string, mtime_ms double")
    return memory.document_entries(files).select("path", "title", "doc_type", F.array_join("symbols", ",").alias("symbols"), "timestamp")
