"""Version-control history as tables.

``git_history`` is a data source: the driver lists the newest commits, and each partition reads its
commits' patches, so a long history is read in parallel where the repository is reachable.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloam.functions.constants import HISTORY_DEPTH

_FIELDS = "%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%s%x1f%b%x1e"
_SCHEMA = "log_pos int, sha string, parents array<string>, author_name string, author_email string, timestamp string, title string, body string, patch string"


class GitError(RuntimeError):
    """A git command that had to work did not."""


def must_git(root: str, *args: str, given: bytes | None = None) -> bytes:
    """Output of a git command; raises if it fails, so that no row goes missing in silence."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, input=given)
    if done.returncode:
        raise GitError(f"git {args[0]} failed: {done.stderr.decode('utf-8', 'replace').strip()[:500]}")
    return done.stdout


def patches(root: str, shas: list[str]) -> dict[str, str]:
    """Unified diffs without context of some commits, by one process."""
    if not shas:
        return {}
    text = must_git(root, "show", "--format=%x1e%H%x1f", "--unified=0", "--find-renames", *shas).decode("utf-8", "replace")
    parts = re.split(r"^\x1e([0-9a-f]{40,64})\x1f$", text, flags=re.M)
    return {sha: diff.lstrip("\n") for sha, diff in zip(parts[1::2], parts[2::2])}


def blobs(root: str, names: list[str]) -> list[str | None]:
    """Texts of ``revision:path`` names, None where there is no such file, by one process."""
    plain = [n for n in names if "\n" not in n]
    out, at, found = must_git(root, "cat-file", "--batch", given="".join(f"{n}\n" for n in plain).encode()) if plain else b"", 0, {}
    for n in plain:
        end = out.index(b"\n", at)
        head = out[at:end]
        at = end + 1
        if head.endswith((b" missing", b" ambiguous")):
            found[n] = None
            continue
        _, kind, size = head.rsplit(b" ", 2)
        found[n] = out[at : at + int(size)].decode("utf-8", "replace") if kind == b"blob" else None
        at += int(size) + 1
    return [found[n] if n in found else run_git(root, "show", n) for n in names]


def run_git(root: str, *args: str) -> str | None:
    """Output of a git command; None if it fails, as it does outside a repository."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    except OSError:
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def git_root(path: str) -> str | None:
    """The nearest directory at or above ``path`` that holds ``.git``."""
    here = Path(path).resolve()
    return next((str(p) for p in (here, *here.parents) if (p / ".git").exists()), None)


def git_dir(root: str) -> Path | None:
    """The repository's own directory; a ``.git`` file's ``gitdir:`` is followed."""
    dot = Path(root) / ".git"
    if dot.is_file():
        line = dot.read_text().strip()
        return (Path(root) / line[7:].strip()).resolve() if line.startswith("gitdir:") else None
    return dot if dot.is_dir() else None


def branch_name(root: str) -> str | None:
    """The branch, or ``detached-`` and 8 digits of the commit; None outside a repository."""
    own = git_dir(root)
    if own is None or not (own / "HEAD").exists():
        return None
    head = (own / "HEAD").read_text().strip()
    return head.removeprefix("ref: refs/heads/") if head.startswith("ref:") else f"detached-{head[:8]}"


def head_sha(root: str) -> str | None:
    out = run_git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def _commits(root: str, depth: int) -> list[tuple]:
    out = run_git(root, "log", f"-n{depth}", f"--pretty=format:{_FIELDS}") or ""
    rows = []
    for pos, record in enumerate(r for r in out.split("\x1e") if r.strip(" \r\n\t")):
        sha, parents, name, email, when, title, body = (record.lstrip("\r\n").split("\x1f") + [""] * 7)[:7]
        rows.append((pos, sha, [p for p in parents.split(" ") if p], name, email, when, title, body.strip()))
    return rows


class _Commits(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _HistoryReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.depth, self.per = options["path"], int(options.get("depth", HISTORY_DEPTH)), int(options.get("commitspertask", 32))

    def partitions(self):
        rows = _commits(self.root, self.depth)
        return [_Commits(rows[i : i + self.per]) for i in range(0, len(rows), self.per)] or [_Commits([])]

    def read(self, partition):
        diffs = patches(self.root, [row[1] for row in partition.rows])
        for row in partition.rows:
            yield (*row, diffs.get(row[1], ""))


class GitHistory(DataSource):
    """``spark.read.format("git_history").load(root)``; options ``depth``, ``commitsPerTask``."""

    @classmethod
    def name(cls):
        return "git_history"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return _HistoryReader(self.options)


def history(spark: SparkSession, root: str, depth: int = HISTORY_DEPTH) -> DataFrame:
    """The newest ``depth`` commits with their patches; no rows outside a repository."""
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").option("depth", depth).load(root)


def read_blobs(files: DataFrame, root: str) -> DataFrame:
    """Adds ``text`` to rows with ``revision`` and ``path``: the file at that revision, null if missing."""
    names = files.columns
    at, where = names.index("revision"), names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_of = [f"{r}:{p}" if r and p else None for r, p in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist())]
            read = dict(zip(wanted := sorted({x for x in names_of if x}), blobs(root, wanted)))
            texts = [read.get(x) for x in names_of]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", text string"
    return files.mapInArrow(run, schema)


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``status`` of changed files."""
    from codeloam.extract.diff import parse_status

    lines = [(x,) for x in (run_git(root, "status", "--porcelain") or "").split("\n") if x]
    return parse_status(spark.createDataFrame(lines, "line string"), "line")


def change_touches(commits: DataFrame, root: str) -> DataFrame:
    """``project``, ``sha``, ``ord``, ``file``, ``status``, ``symbols``, ``hints`` of each file that a commit
    of ``history`` changes: the symbols whose lines its hunks meet, parents pruned, by first line."""
    from codeloam.extract.diff import parse_patches
    from codeloam.extract.source import symbol_ranges
    from codeloam.functions import text as T
    from codeloam.operators.intervals import prune_parents, revision, touched_symbols

    keys = ["project", "sha"]
    p = parse_patches(commits, keys, "patch").join(commits.select(*keys, "parents"), keys)
    old_side = T.prefers_old_revision(F.col("status"), F.col("hunks")) & (F.size("parents") > 0)
    p = p.withColumn("old_side", old_side).withColumn("r", revision(F.col("sha"), F.col("parents"), F.col("path"), F.col("old_path"), F.col("old_side")))
    blobs = read_blobs(p.select(*keys, "file_no", F.col("r.revision").alias("revision"), F.col("r.path").alias("path")), root)
    at = [*keys, "file_no"]
    ranges = symbol_ranges(blobs.select(*at, F.col("path").alias("file"), "text"), at)
    spans = F.when(F.col("old_side"), T.hunk_ranges(F.col("hunks"), "old")).otherwise(T.hunk_ranges(F.col("hunks"), "new"))
    hunks = p.select(*at, F.explode(spans).alias("s")).select(*at, F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    touched = touched_symbols(ranges, hunks, at).groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
    joined = p.join(touched, at, "left")
    return joined.select(*keys, F.col("file_no").alias("ord"), F.col("path").alias("file"), "status", prune_parents(F.array_distinct(T.items("symbols"))).alias("symbols"), T.hunk_hints(F.col("hunks")).alias("hints"))
