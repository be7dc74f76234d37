"""Queries over project memory and documents, each with the SQL of the same result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.extract.markdown import split_sections
from codeloam.functions import constants as K
from codeloam.functions import text as T
from codeloam.operators import incremental, intervals, memory
from codeloam.plans.registry import query
from codeloam.session import load

AS_OF = dt.datetime(2025, 1, 1)

# The same expressions in SQL.
CHANGES = "changes AS (SELECT DISTINCT ON (project, id) * FROM change_entries)"
DOCS = "docs AS (SELECT DISTINCT ON (project, id) * FROM document_entries ORDER BY project, id, entry_row)"
ENTRIES = f"""{CHANGES}, {DOCS}, entries AS (
SELECT project, id, kind, timestamp, try_cast(timestamp AS TIMESTAMPTZ) AS moment, title, change_type, topics, files, symbols, NULL AS doc_type, 0 AS kind_ord FROM changes
UNION ALL SELECT project, id, kind, timestamp, try_cast(timestamp AS TIMESTAMPTZ), title, change_type, topics, files, symbols, doc_type, 1 FROM docs)"""
ORDER = "ORDER BY moment DESC NULLS LAST, kind_ord, id"
POS = f"row_number() OVER (PARTITION BY project {ORDER})"
IS_FEATURE = f"""(kind = 'document' AND NOT regexp_matches(lower(coalesce(title, '')), '{K.FEATURE_DENY}')
AND (doc_type IN ('feature', 'architecture') OR (doc_type = 'overview' AND regexp_matches(lower(coalesce(title, '')), '{K.FEATURE_ALLOW}'))))"""


def _tokens(c: str, stop: list[str]) -> str:
    words = ", ".join(f"'{w}'" for w in sorted(set(stop)))
    return f"list_filter(string_split_regex(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) BETWEEN 3 AND 24 AND t NOT IN ({words}))"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.unify(load(spark, sf_dir, "change_entries"), load(spark, sf_dir, "document_entries"))


@query(f"WITH {ENTRIES} SELECT project, id, kind, {POS} AS pos FROM entries")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).select("project", "id", "kind", "at", "kind_ord", "log_pos")
    return memory.timeline(e).select("project", "id", "kind", "pos")


@query(f"WITH {ENTRIES} SELECT project, id, pos FROM (SELECT project, id, {POS} AS pos FROM entries WHERE kind = 'change' AND change_type = 'fix' AND len(list_filter(coalesce(topics, []), lambda t: contains(t, 'er'))) > 0) WHERE pos <= 10")
def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.recent_changes(_entries(spark, sf_dir), 10, "fix", "er").select("project", "id", F.col("pos").cast("long").alias("pos"))


@query(
    f"""WITH {ENTRIES}, listed AS (SELECT project, unnest(topics) AS topic FROM (SELECT *, {POS} AS pos FROM entries) WHERE pos <= 20)
SELECT project, topic, count(*) AS n FROM listed GROUP BY project, topic QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, topic) <= 5"""
)
def topic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.topic_histogram(_entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT project, change_type, count(*) AS n, min(pos) AS first_pos FROM (SELECT *, {POS} AS pos FROM entries WHERE kind = 'change') WHERE pos <= 20 GROUP BY ALL")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.kind_histogram(_entries(spark, sf_dir)).withColumn("first_pos", F.col("first_pos").cast("long"))


@query(f"WITH {ENTRIES} SELECT project, id, pos FROM (SELECT *, {POS} AS pos FROM entries WHERE kind = 'change' AND change_type = 'fix') WHERE pos <= 3")
def recent_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.recent_fixes(_entries(spark, sf_dir)).select("project", "id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {ENTRIES} SELECT project, id, pos FROM (SELECT *, {POS} AS pos FROM entries WHERE {IS_FEATURE}) WHERE pos <= 3")
def feature_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.feature_documents(_entries(spark, sf_dir)).select("project", "id", F.col("pos").cast("long").alias("pos"))


@query(
    f"""WITH {ENTRIES}, f AS (SELECT project, id, pos FROM (SELECT *, {POS} AS pos FROM entries WHERE {IS_FEATURE}) WHERE pos <= 8),
o AS (SELECT project, id, pos FROM (SELECT *, {POS} AS pos FROM entries WHERE kind = 'document') d WHERE pos <= 5 AND NOT EXISTS (SELECT 1 FROM f WHERE f.project = d.project)),
r AS (SELECT project, id, pos FROM (SELECT *, {POS} AS pos FROM entries WHERE kind = 'change' AND change_type = 'feature') WHERE pos <= 5)
SELECT *, 'documented' AS part FROM f UNION ALL SELECT *, 'documented' FROM o UNION ALL SELECT *, 'recent' FROM r"""
)
def feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.feature_map(_entries(spark, sf_dir)).select("project", "id", F.col("pos").cast("long").alias("pos"), "part")


@query(f"WITH {ENTRIES} SELECT project, kind, count(*) AS n, max(epoch_us(moment)) AS latest_us FROM entries GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).groupBy("project", "kind").agg(F.count("*").alias("n"), F.unix_micros(F.max("at")).alias("latest_us"))


def _change_case() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in K.CHANGE_TYPES) + " ELSE 'chore' END"


@query(
    f"""WITH {CHANGES}, x AS (SELECT project, id, lower(coalesce(title, '') || chr(10) || coalesce(body, '') || chr(10) || array_to_string(coalesce(files, []), chr(10))) AS t FROM changes)
SELECT project, id, {_change_case()} AS change_type FROM x"""
)
def change_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"])
    return c.select("project", "id", T.change_type(F.col("title"), F.col("body"), F.col("files")).alias("change_type"))


def _doc_case() -> str:
    parts = [f"WHEN {f"regexp_matches(p, '{on_path}') OR " if on_path else ''}regexp_matches(t, '{on_text}') THEN '{k}'" for k, on_path, on_text in K.DOCUMENT_TYPES]
    return "CASE " + " ".join(parts) + " ELSE 'note' END"


@query(
    f"""WITH x AS (SELECT entry_row, lower(coalesce(path, '')) AS p, lower(coalesce(path, '') || chr(10) || coalesce(title, '') || chr(10) || coalesce(body, '')) AS t FROM document_entries)
SELECT entry_row, {_doc_case()} AS doc_type FROM x"""
)
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "document_entries").select("entry_row", T.document_type(F.col("path"), F.col("title"), F.col("body")).alias("doc_type"))


TOP6 = "SELECT {k}, array_to_string(list(token ORDER BY score DESC, token), ',') AS topics FROM (SELECT {k}, token, sum(w) AS score FROM t GROUP BY {k}, token QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY score DESC, token) <= 6) GROUP BY {k}"


@query(
    f"""WITH {CHANGES}, t AS (
SELECT project, id, unnest({_tokens("coalesce(title, '')", K.CHANGE_STOP_WORDS)}) AS token, 4 AS w FROM changes
UNION ALL SELECT project, id, unnest({_tokens("coalesce(body, '')", K.CHANGE_STOP_WORDS)}), 2 FROM changes
UNION ALL SELECT project, id, unnest({_tokens("f", K.CHANGE_STOP_WORDS)}), 3 FROM (SELECT project, id, unnest(files) AS f FROM changes)
UNION ALL SELECT project, id, unnest({_tokens("f", K.CHANGE_STOP_WORDS)}), 4 FROM (SELECT project, id, unnest(symbols) AS f FROM changes)
UNION ALL SELECT project, id, unnest({_tokens("f", K.CHANGE_STOP_WORDS)}), 2 FROM (SELECT project, id, unnest(i.hints) AS f FROM (SELECT project, id, unnest(impacts) AS i FROM changes)))
{TOP6.format(k="project, id")}"""
)
def change_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"])
    return memory.change_topics(c, ["project", "id"]).withColumn("topics", F.array_join("topics", ","))


@query(
    f"""WITH t AS (
SELECT entry_row, unnest({_tokens("coalesce(path, '')", K.DOCUMENT_STOP_WORDS)}) AS token, 3 AS w FROM document_entries
UNION ALL SELECT entry_row, unnest({_tokens("coalesce(title, '')", K.DOCUMENT_STOP_WORDS)}), 5 FROM document_entries
UNION ALL SELECT entry_row, unnest({_tokens("coalesce(body, '')", K.DOCUMENT_STOP_WORDS)}), 1 FROM document_entries
UNION ALL SELECT entry_row, unnest({_tokens("coalesce(doc_type, '')", K.DOCUMENT_STOP_WORDS)}), 2 FROM document_entries)
{TOP6.format(k="entry_row")}"""
)
def doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.document_topics(load(spark, sf_dir, "document_entries"), ["entry_row"]).withColumn("topics", F.array_join("topics", ","))


WS = r"[\s\x0B\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '(?s)```.*?```', chr(10), 'g'), '`([^`]+)`', '\1', 'g'), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '<[^>]+>', ' ', 'g')"


def _trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _line(c: str) -> str:
    c = _trimmed(c)
    for pattern, put in ((r"^#{1,6}\s+", ""), (r"^[-*+]\s+", ""), (r"^\d+\.\s+", ""), (r"^>\s?", "")):
        c = f"regexp_replace({c}, '{pattern}', '{put}')"
    return _trimmed(f"regexp_replace(replace({c}, '|', ' '), '{WS}+', ' ', 'g')")


def _lines(c: str) -> str:
    return f"list_filter(list_transform(string_split({STRIPPED.format(c=c)}, chr(10)), lambda l: {_line('l')}), lambda l: length(l) >= 12 AND NOT regexp_matches(l, '^[-=_]{{3,}}$'))"


@query(f"SELECT entry_row, sha256(array_to_string({_lines('body')}, chr(10))) AS lines_hash, len({_lines('body')}) AS n FROM document_entries")
def meaningful_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.meaningful_lines(F.col("body"))
    return load(spark, sf_dir, "document_entries").select("entry_row", F.sha2(F.array_join(lines, "\n"), 256).alias("lines_hash"), F.size(lines).cast("long").alias("n"))


@query(
    f"""WITH l AS (SELECT entry_row, doc_type || ' note: ' || title AS head, list_slice({_lines('body')}, 1, 2) AS two FROM document_entries)
SELECT entry_row, CASE WHEN len(two) = 0 THEN head ELSE substr(head || '. ' || array_to_string(two, ' '), 1, 320) END AS summary FROM l"""
)
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "document_entries").select("entry_row", T.section_summary(F.col("doc_type"), F.col("title"), F.col("body")).alias("summary"))


@query(
    rf"""WITH l AS (SELECT doc_id, path, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, regexp_extract(coalesce(path, ''), '([^/\\]*)$', 1) AS base, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM l),
f AS (SELECT *, starts_with({_trimmed('line')}, '```') AS mark FROM u),
g AS (SELECT *, coalesce(sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
h AS (SELECT *, NOT mark AND NOT inside AND regexp_matches(line, '^#{{1,6}}[ \t\n\v\f\r]+\S') AS head FROM g),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM h),
b AS (SELECT doc_id, sec, any_value(base) AS base, max(CASE WHEN head THEN {_trimmed("regexp_extract(line, '^#{1,6}[ \\t\\n\\v\\f\\r]+(.+?)[ \\t\\n\\v\\f\\r]*$', 1)")} END) AS title, {_trimmed("string_agg(CASE WHEN head THEN NULL ELSE line END, chr(10) ORDER BY n)")} AS body FROM s GROUP BY doc_id, sec),
k AS (SELECT doc_id, coalesce(title, base) AS title, body, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS no FROM b WHERE body <> ''),
w AS (SELECT doc_id, regexp_extract(coalesce(path, ''), '([^/\\]*)$', 1) AS title, substr(text, 1, 4000) AS body, 0 AS no FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = d.doc_id))
SELECT doc_id, CAST(no AS INTEGER) AS section_no, title, sha256(body) AS body_hash FROM (FROM k UNION ALL FROM w) WHERE no < 24"""
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_sections(load(spark, sf_dir, "documents"), ["doc_id"], "text")
    return s.select("doc_id", "section_no", "title", F.sha2("body", 256).alias("body_hash"))


@query(
    rf"""SELECT entry_row, array_to_string(list_transform(list_filter(list_zip(s, range(len(s))), lambda p: list_position(s, p[1]) = p[2] + 1), lambda p: p[1]), ',') AS symbols FROM (
SELECT entry_row, list_slice(list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '`([^`\n]{{2,80}})`', 1), lambda t: {_trimmed('t')}), lambda t: regexp_matches(t, '^[A-Za-z0-9_./:-]+$')), 1, 12) AS s FROM document_entries)"""
)
def inline_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "document_entries").select("entry_row", F.array_join(T.inline_symbols(F.col("body")), ",").alias("symbols"))


HINTS = "list_filter(coalesce(flatten(list_transform(impacts, lambda i: coalesce(i.hints, []))), []), lambda h: h IS NOT NULL AND h <> '')"
FIRST = "list_transform(list_filter(list_zip(h, range(len(h))), lambda p: list_position(h, p[1]) = p[2] + 1), lambda p: p[1])"


@query(
    f"""WITH {CHANGES}, x AS (SELECT *, {HINTS} AS h FROM changes)
SELECT project, id, change_type || ' change: ' || CASE WHEN len(coalesce(symbols, [])) > 0 THEN 'touches ' || array_to_string(list_slice(symbols, 1, 4), ', ')
 WHEN len(h) > 0 THEN 'focuses on ' || array_to_string(list_slice({FIRST}, 1, 2), ' | ') WHEN len(coalesce(files, [])) > 0 THEN 'affects ' || array_to_string(list_slice(files, 1, 3), ', ') ELSE 'records a repository change' END
 || '. ' || coalesce(title, '') || '.' || CASE WHEN len(coalesce(topics, [])) > 0 THEN ' Topics: ' || array_to_string(list_slice(topics, 1, 4), ', ') || '.' ELSE '' END AS summary,
 CASE WHEN len(coalesce(symbols, [])) > 0 THEN array_to_string(list_slice(symbols, 1, 5), ', ') WHEN len(h) > 0 THEN array_to_string(list_slice({FIRST}, 1, 3), ' | ') ELSE array_to_string(list_slice(coalesce(files, []), 1, 3), ', ') END AS impact,
 substr(sha, 1, 8) AS label FROM x"""
)
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"])
    col = F.col
    return c.select("project", "id", T.change_summary(col("change_type"), col("title"), col("topics"), col("symbols"), col("impacts"), col("files")).alias("summary"), T.render_impact(col("symbols"), col("impacts"), col("files")).alias("impact"), T.entry_label(col("kind"), col("sha"), F.lit(None).cast("string")).alias("label"))


def _lst(key: str, c: str, glue: str = ", ") -> str:
    return f"CASE WHEN len({c}) > 0 THEN '{key}: ' || array_to_string({c}, '{glue}') END"


@query(
    f"""WITH {CHANGES} SELECT project, id, sha256(concat_ws(chr(10), 'kind: ' || kind, 'change_type: ' || change_type, 'title: ' || coalesce(title, ''), CASE WHEN coalesce(body, '') <> '' THEN 'details: ' || body END, 'summary: ' || coalesce(summary, ''),
{_lst('topics', 'topics')}, {_lst('symbols', 'symbols')}, {_lst('semantic_hints', 'list_slice(coalesce(flatten(list_transform(impacts, lambda i: coalesce(i.hints, []))), []), 1, 8)', ' | ')}, {_lst('files', 'files')},
'author: ' || coalesce(author_name, ''), 'date: ' || coalesce(timestamp, ''), 'sha: ' || coalesce(sha, ''))) AS text_hash FROM changes"""
)
def change_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"])
    return c.select("project", "id", F.sha2(T.change_embedding_text(), 256).alias("text_hash"))


@query(
    f"""SELECT entry_row, sha256(concat_ws(chr(10), 'kind: ' || kind, 'doc_type: ' || coalesce(doc_type, ''), 'title: ' || coalesce(title, ''), 'section: ' || coalesce(section, ''), 'path: ' || coalesce(path, ''), 'summary: ' || coalesce(summary, ''),
{_lst('topics', 'topics')}, {_lst('symbols', 'symbols')}, 'body: ' || coalesce(body, ''), 'date: ' || coalesce(timestamp, ''))) AS text_hash FROM document_entries"""
)
def document_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "document_entries").select("entry_row", F.sha2(T.document_embedding_text(), 256).alias("text_hash"))


@query(
    rf"""SELECT entry_row, 'doc:' || substr(sha256(path || chr(10) || title || chr(10) || coalesce(body, '')), 1, 16) AS made_id, regexp_replace(substr(sha256(id), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') AS point_id FROM document_entries"""
)
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "document_entries").select("entry_row", T.document_id(F.col("path"), F.col("title"), T.text("body")).alias("made_id"), T.memory_point_id(F.col("id")).alias("point_id"))


@query(
    r"""SELECT project, branch, CASE WHEN s = '' THEN 'default' ELSE s END AS slug FROM (
SELECT project, branch, regexp_replace(regexp_replace(regexp_replace(branch, '[/\\:*?"<>|]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS s FROM projects)"""
)
def branch_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "projects").select("project", "branch", T.branch_slug(F.col("branch")).alias("slug"))


@query(
    f"""WITH {CHANGES}, x AS (SELECT c.project, c.id, try_cast(timestamp AS TIMESTAMPTZ) AS moment, max_commits FROM changes c JOIN projects USING (project))
SELECT project, id, n AS rank FROM (SELECT project, id, max_commits, row_number() OVER (PARTITION BY project ORDER BY moment DESC NULLS LAST, id) AS n FROM x) WHERE n <= max_commits"""
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"]).withColumn("at", memory.instant(F.col("timestamp")))
    j = c.join(load(spark, sf_dir, "projects").select("project", "max_commits"), "project")
    return incremental.history_window(j, "max_commits").select("project", "id", F.col("rank").cast("long").alias("rank"))


OLD_NEW = f"{CHANGES}, x AS (SELECT project, id, sha, try_cast(timestamp AS TIMESTAMPTZ) AS moment, status FROM (SELECT *, impacts[1].status AS status FROM changes)), old AS (SELECT * FROM x WHERE moment < TIMESTAMPTZ '2024-07-01 00:00:00+00'), new AS (SELECT * FROM x WHERE moment >= TIMESTAMPTZ '2023-07-01 00:00:00+00')"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: entries before July 2024, and those since July 2023."""
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"]).withColumn("at", memory.instant(F.col("timestamp")))
    return c.where("at < TIMESTAMP '2024-07-01 00:00:00'"), c.where("at >= TIMESTAMP '2023-07-01 00:00:00'")


@query(f"WITH {OLD_NEW} SELECT project, sha, CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.project = n.project AND o.sha = n.sha) THEN 'reuse' ELSE 'build' END AS action FROM new n")
def reuse_or_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return incremental.reuse_or_build(new.select("project", "sha"), old)


@query(f"WITH {OLD_NEW} SELECT project, id, 'stale' AS change FROM (SELECT project, id FROM old EXCEPT SELECT project, id FROM new) UNION ALL SELECT project, id, 'added' FROM (SELECT project, id FROM new EXCEPT SELECT project, id FROM old)")
def entry_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.entry_difference(*_old_new(spark, sf_dir))


@query(
    f"""WITH {CHANGES} SELECT project, id, i.file AS file, CASE WHEN i.status = 'D' AND len(coalesce(parents, [])) > 0 THEN parents[1] ELSE sha END AS revision FROM (SELECT project, id, sha, parents, unnest(impacts) AS i FROM changes)"""
)
def revision_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"]).select("project", "id", "sha", "parents", F.explode("impacts").alias("i"))
    hunks = F.array().cast("array<struct<old_start:int,old_count:int,new_start:int,new_count:int,header:string>>")
    r = intervals.revision(F.col("sha"), F.col("parents"), F.col("i.file"), F.lit(None).cast("string"), T.prefers_old_revision(F.col("i.status"), hunks))
    return c.select("project", "id", F.col("i.file").alias("file"), r["revision"].alias("revision"))


@query(
    f"""WITH {CHANGES}, x AS (SELECT project, id, unnest(impacts) AS i, generate_subscripts(impacts, 1) AS n FROM changes),
s AS (SELECT project, id, s, min(n * 1000 + k) AS p FROM (SELECT project, id, n, unnest(i.symbols) AS s, generate_subscripts(i.symbols, 1) AS k FROM x) WHERE s <> '' GROUP BY ALL)
SELECT project, id, array_to_string(list(s ORDER BY p), ',') AS symbols FROM s GROUP BY ALL"""
)
def impact_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "change_entries").dropDuplicates(["project", "id"])
    merged = T.unique(F.flatten(F.transform("impacts", lambda i: T.items(i["symbols"]))))
    return c.select("project", "id", F.array_join(merged, ",").alias("symbols")).where("symbols <> ''")


@query(
    f"""WITH {ENTRIES} SELECT kind, count(*) AS n, count(doc_type) AS typed, count(DISTINCT project) AS projects FROM entries GROUP BY ALL"""
)
def hetero_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count("doc_type").alias("typed"), F.countDistinct("project").alias("projects"))
