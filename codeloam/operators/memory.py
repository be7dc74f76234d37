"""Project memory: timeline, status, feature map, topics, re-ranking.

``entries`` are the change and document entries of all projects in one table (``unify``). Rows sent
twice (same project and id) count once. Entries without a readable timestamp come last.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloam.functions import constants as K
from codeloam.functions import text as T
from codeloam.operators.ordering import first_per_key
from codeloam.session import materialise


def instant(timestamp: Column) -> Column:
    """ISO-8601 text, with any offset, as an instant; null if it is none."""
    return F.try_to_timestamp(timestamp)


def unify(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """Changes and documents as one table; ``at`` is the instant, ``kind_ord`` 0 for changes."""
    c = changes.dropDuplicates(["project", "id"]).withColumn("kind_ord", F.lit(0))
    d = documents.dropDuplicates(["project", "id"]).withColumn("kind_ord", F.lit(1))
    return dated(c.unionByName(d, allowMissingColumns=True))


def dated(entries: DataFrame) -> DataFrame:
    """Adds ``at``, and ``log_pos`` where a table has no log positions."""
    e = entries if "log_pos" in entries.columns else entries.withColumn("log_pos", F.lit(None).cast("int"))
    return e.withColumn("at", instant(F.col("timestamp")))


def newest_first() -> list[Column]:
    """By time; of the same instant changes first, in log order, then by id."""
    return [F.col("at").desc_nulls_last(), F.col("kind_ord"), F.col("log_pos").asc_nulls_last(), F.col("id")]


def timeline(entries: DataFrame) -> DataFrame:
    """All entries with their place ``pos`` in their project: newest first, changes before documents of
    the same instant.

    Entries are range-partitioned by (project, order), so a project with a third of all rows is spread
    over as many partitions as it fills; places within a partition are shifted by the counts of the
    partitions before it.
    """
    order = [F.col("project"), *newest_first()]
    parts = entries.sparkSession.sparkContext.defaultParallelism
    placed = materialise(entries.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy("project", "__part").orderBy(*newest_first())
    counts = placed.groupBy("project", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("project").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("project", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__at", F.row_number().over(inner))
    on = ranked["project"].eqNullSafe(offsets["project"]) & (ranked["__part"] == offsets["__part"])
    return ranked.join(offsets, on).select(*(ranked[c] for c in entries.columns), (F.col("__at") + F.col("__before")).alias("pos"))


def log_newest(changes: DataFrame) -> DataFrame:
    """The newest commit of each project in log order (``log_pos``), which need not be the newest in
    time: ``project``, ``latest_sha``."""
    return changes.where("kind = 'change' AND log_pos IS NOT NULL").groupBy("project").agg(F.min_by("sha", "log_pos").alias("latest_sha"))


def by_change_of_file(documents: DataFrame) -> DataFrame:
    """Document entries with their place ``pos`` in their project: last changed file first, sections of
    the same time in the order they were read (path and section)."""
    w = Window.partitionBy("project").orderBy(F.col("source_mtime_ms").desc_nulls_last(), "path", "section_no")
    return documents.withColumn("pos", F.row_number().over(w))


def newest(entries: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest entries of each project with their place ``pos``."""
    w = Window.partitionBy("project").orderBy(*newest_first())
    return entries.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def recent_changes(entries: DataFrame, limit: int = 10, change_type: str | None = None, topic: str | None = None) -> DataFrame:
    """Newest changes of each project, of a type, with a topic that contains ``topic``."""
    if not 1 <= limit <= 25:
        raise ValueError("limit is 1 to 25")
    rows = entries.where("kind = 'change'")
    if change_type:
        rows = rows.where(F.col("change_type") == change_type)
    if topic:
        rows = rows.where(F.exists(T.items("topics"), lambda t: F.contains(t, F.lit(topic.lower()))))
    return newest(rows, limit)


def topic_histogram(entries: DataFrame, window: int = 20, most: int = 5) -> DataFrame:
    """Topics of the newest entries of each project: most frequent first, ties by name."""
    counted = newest(entries, window).select("project", F.explode("topics").alias("topic")).groupBy("project", "topic").agg(F.count("*").alias("n"))
    return first_per_key(counted, ["project"], F.col("n").desc(), "topic", n=most)


def kind_histogram(entries: DataFrame, window: int = 20) -> DataFrame:
    """Change types of the newest changes of each project; ties by first appearance (``first_pos``)."""
    return newest(entries.where("kind = 'change'"), window).groupBy("project", "change_type").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def recent_fixes(entries: DataFrame, n: int = 3) -> DataFrame:
    return newest(entries.where("kind = 'change' AND change_type = 'fix'"), n)


def feature_documents(entries: DataFrame, n: int = 3) -> DataFrame:
    return newest(entries.where(T.is_feature_document(F.col("kind"), F.col("title"), F.col("doc_type"))), n)


def feature_map(entries: DataFrame, documents: int = 8, fallback: int = 5, changes: int = 5) -> DataFrame:
    """Per project ``part`` documented (feature documents, or the newest documents of any kind where
    it has none) and ``part`` recent (feature changes)."""
    features = feature_documents(entries, documents)
    others = newest(entries.where("kind = 'document'"), fallback).join(features.select("project").distinct(), "project", "left_anti")
    recent = newest(entries.where("kind = 'change' AND change_type = 'feature'"), changes)
    return features.unionByName(others).withColumn("part", F.lit("documented")).unionByName(recent.withColumn("part", F.lit("recent")))


def _top_topics(rows: DataFrame, keys: list[str], parts: list[tuple[Column, int]], stop: list[str], most: int = 6) -> DataFrame:
    """``keys`` and ``topics`` of each row that has a token: a token's score is the sum of the weights of
    the texts it occurs in; best first, ties by name. A score concerns one row only, so there is no shuffle.
    """
    n, weights, stopped = len(keys), [w for _, w in parts], frozenset(stop)
    camel, rest = re.compile("([a-z0-9])([A-Z])"), re.compile("[^a-z0-9]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, topics = [], []
            for i, texts in enumerate(zip(*(batch.column(n + j).to_pylist() for j in range(len(weights))))):
                score: Counter = Counter()
                for text, w in zip(texts, weights):
                    for t in rest.split(camel.sub(r"\1 \2", text).lower()) if text else ():
                        if 3 <= len(t) <= 24 and t not in stopped:
                            score[t] += w
                if score:
                    kept.append(i)
                    topics.append([t for t, _ in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:most]])
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(n)), pa.array(topics, pa.list_(pa.string()))], names=[*keys, "topics"])

    schema = ", ".join(f"`{a}` {b}" for a, b in rows.select(*keys).dtypes) + ", topics array<string>"
    return rows.select(*keys, *(c.alias(f"__part{j}") for j, (c, _) in enumerate(parts))).mapInArrow(run, schema)


def change_topics(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Up to six topics of each change by weighted tokens of title, body, files, symbols and hints; a
    change without tokens has no row."""
    w = K.CHANGE_WEIGHTS
    lines = lambda c: F.array_join(c, "\n")
    return _top_topics(changes, keys, [(T.text("title"), w["title"]), (T.text("body"), w["body"]), (lines(T.items("files")), w["files"]), (lines(T.items("symbols")), w["symbols"]), (lines(T.all_hints(F.col("impacts"))), w["hints"])], K.CHANGE_STOP_WORDS)


def document_topics(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Up to six topics of each document section by weighted tokens of path, title, body and type."""
    return _top_topics(documents, keys, [(T.text(c), w) for c, w in K.DOCUMENT_WEIGHTS.items()], K.DOCUMENT_STOP_WORDS)


def freshness(kind: Column, at: Column, as_of: dt.datetime) -> Column:
    """Falls from 1 with age: over a year for documents (0.2 at least), half a year for changes. An
    unknown instant is as old as can be."""
    seconds = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at)
    age = F.greatest(F.lit(0.0), seconds / F.lit(86_400e6))
    document = F.greatest(F.lit(K.DOCUMENT_FLOOR), 1 - age / K.DOCUMENT_DAYS)
    change = F.greatest(F.lit(0.0), 1 - age / K.CHANGE_DAYS)
    return F.when(kind == "document", F.coalesce(document, F.lit(K.DOCUMENT_FLOOR))).otherwise(F.coalesce(change, F.lit(0.0)))


def rerank(hits: DataFrame, question: str, as_of: dt.datetime, limit: int | None = None) -> DataFrame:
    """``hits`` (entries with ``cosine`` and ``hit_pos``) with the composite ``score``, best first:
    similarity, freshness, documents, and what the question asks for."""
    q = question.lower()
    fix, fact = (bool(re.search(p, q)) for p in (K.FIX_QUESTION, K.FACT_QUESTION))
    feature = T.is_feature_document(F.col("kind"), F.col("title"), F.col("doc_type"))
    bonus = lambda on, cond, n: F.when(F.lit(on) & F.coalesce(cond, F.lit(False)), n).otherwise(0.0)
    score = K.COSINE_WEIGHT * F.col("cosine") + K.FRESHNESS_WEIGHT * freshness(F.col("kind"), F.col("at"), as_of) + bonus(True, F.col("kind") == "document", K.DOCUMENT_BONUS) + bonus(fact, feature, K.FACT_BONUS) + bonus(fix, (F.col("kind") == "change") & (F.col("change_type") == "fix"), K.FIX_BONUS)
    ranked = hits.withColumn("score", score).orderBy(F.col("score").desc(), "hit_pos")
    return ranked.limit(limit) if limit else ranked


def change_entries(commits: DataFrame, touches: DataFrame) -> DataFrame:
    """Assembles change entries: ``commits(project, sha, parents, author_name, author_email, timestamp,
    title, body)`` with ``touches(project, sha, ord, file, status, symbols, hints)``; commits without
    touches have empty lists."""
    impact = F.struct("ord", F.struct("file", "status", "symbols", "hints").alias("i"))
    lists = touches.groupBy("project", "sha").agg(F.transform(F.array_sort(F.collect_list(impact)), lambda x: x["i"]).alias("impacts"))
    none = F.array().cast("array<string>")
    e = commits.join(lists, ["project", "sha"], "left").withColumn("impacts", F.coalesce("impacts", F.filter(F.array(F.struct(F.lit("").alias("file"), F.lit("").alias("status"), none.alias("symbols"), none.alias("hints"))), lambda _: F.lit(False))))
    e = e.select("*", F.lit("change").alias("kind"), F.concat(F.lit("change:"), "sha").alias("id"), T.unique(F.flatten(F.transform("impacts", lambda i: i["symbols"]))).alias("symbols"), T.unique(F.transform("impacts", lambda i: i["file"])).alias("files"))
    e = e.withColumn("change_type", T.change_type(F.col("title"), F.col("body"), F.col("files")))
    e = e.join(change_topics(e, ["project", "sha"]), ["project", "sha"], "left").withColumn("topics", T.items("topics"))
    return e.withColumn("summary", T.change_summary(F.col("change_type"), F.col("title"), F.col("topics"), F.col("symbols"), F.col("impacts"), F.col("files")))


def document_entries(files: DataFrame) -> DataFrame:
    """Assembles document entries from ``files(project, path, text, mtime_ms)``: their sections with
    body (cut to 4,000 signs), type, topics, summary and symbols; sections without a meaningful line
    are dropped; a project keeps the first 120 by path and place."""
    from codeloam.extract.markdown import split_sections

    s = split_sections(files, ["project", "path"], "text").join(files.select("project", "path", "mtime_ms"), ["project", "path"])
    s = s.withColumn("body", F.substring(T.trim(F.col("body")), 1, K.DOC_BODY_CHARS)).where(F.size(T.meaningful_lines(F.col("body"))) > 0)
    s = first_per_key(s, ["project"], "path", "section_no", n=K.DOC_ENTRIES).withColumn("doc_type", T.document_type(F.col("path"), F.col("title"), F.col("body")))
    s = s.withColumn("id", T.document_id(F.col("path"), F.col("title"), F.col("body"))).withColumn("summary", T.section_summary(F.col("doc_type"), F.col("title"), F.col("body")))
    s = s.join(document_topics(s, ["project", "path", "section_no"]), ["project", "path", "section_no"], "left").withColumn("topics", T.items("topics"))
    at = F.date_format(F.timestamp_millis(F.floor("mtime_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return s.select("project", "id", F.lit("document").alias("kind"), at.alias("timestamp"), "title", "body", "summary", F.lit("docs").alias("change_type"), "topics", F.array("path").alias("files"), T.inline_symbols(F.concat_ws("\n", "title", "body")).alias("symbols"), "path", "doc_type", F.col("title").alias("section"), F.col("mtime_ms").alias("source_mtime_ms"), "section_no")
