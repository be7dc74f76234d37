"""Source trees as tables: walking, ignore files, plain-file and document scans."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloam.functions import constants as K
from codeloam.functions import text as T

SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "php")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Part after the last dot of the name; empty without one."""
    return F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)


def is_secret_file(path: Column) -> Column:
    """``.env`` and its variants, which no scan reads."""
    return base_name(path).startswith(".env")


def is_plain_file(path: Column, size: Column) -> Column:
    return (size <= K.PLAIN_BYTES) & ~is_secret_file(path) & (base_name(path).isin(*K.PLAIN_NAMES) | F.lower(extension(path)).isin(*K.PLAIN_EXTENSIONS))


def is_doc_file(path: Column, size: Column) -> Column:
    return (size <= K.DOC_BYTES) & ~is_secret_file(path) & (base_name(path).isin(*K.DOC_NAMES) | F.lower(extension(path)).isin(*K.DOC_EXTENSIONS))


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _wanted(kind: str, name: str, size: int) -> bool:
    """Does a scan of this kind read a file? ``source``, ``plain``, ``doc``, or any."""
    if not kind:
        return True
    if name.startswith(".env"):
        return False
    dot = name.rfind(".")
    end = name[dot + 1 :] if dot >= 0 else ""
    if kind == "source":
        return end in SOURCE_EXTENSIONS
    names, ends, most = (K.PLAIN_NAMES, K.PLAIN_EXTENSIONS, K.PLAIN_BYTES) if kind == "plain" else (K.DOC_NAMES, K.DOC_EXTENSIONS, K.DOC_BYTES)
    return (name in names or end.lower() in ends) and size <= most


class _Rules:
    """Ignore rules on the way down a tree: a path takes the last rule that matches it, a negated rule
    (``!``) takes it back; below an ignored directory nothing is looked at."""

    def __init__(self):
        self.rules: list[tuple[bool, re.Pattern]] = []

    def below(self, here: str, rel: str) -> _Rules:
        """With the rules of a directory's own ignore file, if it has one."""
        try:
            with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                lines = [x.strip() for x in f]
        except OSError:
            return self
        more = _Rules()
        more.rules = self.rules + [(x[0] != "!", re.compile(rule_pattern(rel, x.lstrip("!")))) for x in lines if x.strip("!") and x[0] != "#"]
        return more

    def ignore(self, path: str) -> bool:
        return next((on for on, rule in reversed(self.rules) if rule.search(path)), False)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.per = options["path"], int(options.get("filespertask", 2000))
        self.kind, self.follow = options.get("kind", ""), options.get("ignorefiles", "false") == "true"
        self.skip = {*K.SKIPPED_DIRS, *filter(None, options.get("skip", "").split(","))}

    def partitions(self):
        paths: list[str] = []
        rules = {"": _Rules()}
        for here, dirs, names in os.walk(self.root):
            rel = os.path.relpath(here, self.root).replace(os.sep, "/").removeprefix(".").lstrip("/") if here != self.root else ""
            prefix = f"{rel}/" if rel else ""
            now = rules.pop(rel)
            if self.follow:
                now = now.below(here, rel)
                names = [n for n in names if not now.ignore(prefix + n)]
            dirs[:] = sorted(d for d in dirs if d not in self.skip and not (self.follow and now.ignore(prefix + d)))
            rules |= {prefix + d: now for d in dirs}
            for n in sorted(names):
                try:
                    if _wanted(self.kind, n, os.stat(os.path.join(here, n)).st_size if self.kind in ("plain", "doc") else 0):
                        paths.append(prefix + n)
                except OSError:
                    continue
        return [_Paths(paths[i : i + self.per]) for i in range(0, len(paths), self.per)] or [_Paths([])]

    def read(self, partition):
        for rel in partition.paths:
            full = os.path.join(self.root, rel)
            try:
                at = os.stat(full)
                with open(full, "rb") as f:
                    yield rel, at.st_mtime * 1000, at.st_size, f.read()
            except OSError:
                continue  # unreadable, or gone since it was listed


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: every file, hidden ones included (Spark's own
    file sources leave those out). Names are listed on the driver, and what a scan does not want is left
    out there; contents are read by the tasks from a path that all executors see. Options: ``kind``
    (source, plain, doc: only such files), ``ignoreFiles`` (true: without what ignore files name),
    ``skip`` (further directory names to leave out), ``filesPerTask``."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "rel string, mtime_ms double, size long, content binary"

    def reader(self, schema):
        return _TreeReader(self.options)


def walk_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Every file under ``root`` but those in skipped directories: ``rel`` (path from the root),
    ``mtime_ms``, ``size`` and ``content``."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**options).load(root)


def rule_pattern(directory: str, rule: str) -> str:
    """The pattern of one ignore rule: a leading slash ties it to its directory, ``*`` and ``?`` stay
    within a name, ``**`` does not; it matches a path or any directory above it."""
    tied, body = rule.startswith("/"), rule.strip("/")
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", body):
        out += {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    prefix = re.escape(directory.strip("/") + "/") if directory.strip("/") else ""
    return f"^{prefix}" + ("" if tied else "(?:.*/)?") + out + "(?:$|/)"


def ignore_rules(files: DataFrame) -> DataFrame:
    """``dir`` and ``rule`` of every line of the ignore files among ``files``; blank lines, comments
    and negated rules (``!``), which need an order, are dropped (``scan`` follows them)."""
    own = files.where(base_name(F.col("rel")) == ".gitignore")
    lines = own.select(F.regexp_replace("rel", r"/?\.gitignore$", "").alias("dir"), F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("rule"))
    return lines.withColumn("rule", T.trim(F.col("rule"))).where("rule <> '' AND NOT startswith(rule, '#') AND NOT startswith(rule, '!')").distinct()


def _patterns(rules: DataFrame) -> DataFrame:
    """``dir`` and ``pattern`` of rules."""

    @F.udf("string")
    def pattern(directory, rule):
        return rule_pattern(directory or "", rule)

    return rules.select(F.coalesce("dir", F.lit("")).alias("dir"), pattern("dir", "rule").alias("pattern")).distinct()


def drop_ignored(files: DataFrame, rules: DataFrame, path: str = "rel", most_inlined: int = 2_000) -> DataFrame:
    """Files that no rule matches.

    Up to ``most_inlined`` rules are tested as one alternation, so the scan needs no join. More of them
    meet only the files below their own directory: an equi join on directories, with the rule's
    pattern as residual condition, and an anti join on paths.
    """
    patterns = _patterns(rules)
    listed = patterns.limit(most_inlined + 1).collect()
    if not listed:
        return files
    if len(listed) <= most_inlined:
        return files.where(~F.coalesce(F.col(path).rlike("|".join(f"(?:{r['pattern']})" for r in listed)), F.lit(False)))
    names = F.split(F.col("__path"), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    below = files.select(F.col(path).alias("__path")).where("__path IS NOT NULL").distinct().select("__path", F.explode(ancestors).alias("dir"))
    hit = below.join(patterns, "dir").where("__path rlike pattern").select("__path").distinct()
    return files.join(hit, F.col(path) == F.col("__path"), "left_anti")


def scan(spark: SparkSession, root: str, kind: str = "", skip: tuple[str, ...] = ()) -> DataFrame:
    """Files under ``root`` that are not skipped, ignored or secret; only those of one ``kind`` if given.
    Ignore files are followed while names are listed, so that no file is read in vain."""
    return walk_files(spark, root, kind=kind, ignoreFiles="true", skip=",".join(skip)).where(~is_secret_file(F.col("rel")))


def plain_chunks(files: DataFrame) -> DataFrame:
    """One chunk for each plain file: its path is file and symbol, its whole text the code."""
    code = F.decode("content", "UTF-8")
    kept = files.where(is_plain_file(F.col("rel"), F.col("size")))
    return kept.select(T.chunk_id(F.col("rel"), F.lit(None).cast("string")).alias("id"), F.col("rel").alias("file"), F.col("rel").alias("symbol"), F.lit("file").alias("type"), code.alias("code"), F.array().cast("array<string>").alias("imports"), "mtime_ms")


def document_files(files: DataFrame) -> DataFrame:
    """Documents among the files: ``path``, ``text``, ``mtime_ms``."""
    return files.where(is_doc_file(F.col("rel"), F.col("size"))).select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("text"), "mtime_ms")
