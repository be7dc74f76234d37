"""Files, history, engine and stream, end to end on a small repository."""

import datetime as dt
import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloam import render
from codeloam.api import Engine, NotIndexedError
from codeloam.sources import files as FS
from codeloam.sources import git
from codeloam.sources.store import Store
from codeloam.streaming.sync import activity, newest_rows, sync_chunks

CLASS = """export class AuthService {
  login(user: string) {
    return check(user);
  }
  logout(user: string) {
    return this.login(user);
  }
}
"""


def sh(root, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x.example", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x.example"}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    if not shutil.which("git"):
        pytest.skip("no git")
    root = tmp_path_factory.mktemp("repo")
    (root / "src").mkdir()
    (root / "src/auth.ts").write_text(CLASS)
    (root / "src/tool.php").write_text("<?php\nnamespace T;\nfunction run($x) { return helper($x); }\n")
    (root / "README.md").write_text("# What It Does\n\nThe `AuthService` is the feature that checks every login.\n")
    (root / "app.json").write_text('{"name": "demo"}')
    (root / ".env").write_text("SECRET=1")
    (root / ".env.md").write_text("# no\n\nthis is never read by any scan at all")
    (root / ".gitignore").write_text("# comment\n\nout\n/top.json\n*.tmp.ts\n")
    for p in ("node_modules/x.ts", "out/y.ts", "src/z.tmp.ts", "top.json", "src/top.json"):
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text("export function no() { return 1; }")
    sh(root, "init", "-q", "-b", "main")
    sh(root, "add", "-A")
    sh(root, "commit", "-q", "-m", "add the auth service")
    (root / "src/auth.ts").write_text(CLASS.replace("return check(user);", "return check(user.trim());"))
    sh(root, "commit", "-q", "-am", "fix login of padded names")
    return root


def test_scan(spark, tree):
    got = sorted(r["rel"] for r in FS.scan(spark, str(tree)).collect())
    assert got == [".gitignore", "README.md", "app.json", "src/auth.ts", "src/tool.php", "src/top.json"]
    assert sorted(r["file"] for r in FS.plain_chunks(FS.scan(spark, str(tree))).collect()) == [".gitignore", "README.md", "app.json", "src/top.json"]


@pytest.mark.parametrize(("directory", "rule", "path", "hit"), [("", "dist", "a/dist/b", True), ("", "/dist", "a/dist/b", False), ("", "*.log", "a/b.log", True), ("", "*.log", "a/b.logs", False), ("", "a/**/z", "a/b/c/z", True), ("", "a/**/z", "a/z", True), ("", "?.ts", "x/a.ts", True), ("", "?.ts", "ab.ts", False), ("sub", "x", "sub/y/x", True), ("sub", "x", "x", False)])
def test_ignore_rules(directory, rule, path, hit):
    import re

    assert bool(re.search(FS.rule_pattern(directory, rule), path)) is hit


def test_negated_rules_and_kinds(spark, tmp_path):
    for p in ("keep/a.ts", "logs/x.log", "logs/keep.log", "sub/logs/y.log", "big.md", "small.md", "idx/z.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * (200_000 if p == "big.md" else 5))
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    (tmp_path / "sub/.gitignore").write_text("# own\n!y.log\n")
    names = lambda *a, **k: sorted(r["rel"] for r in FS.scan(spark, str(tmp_path), *a, **k).collect())
    assert names(skip=("idx",)) == [".gitignore", "big.md", "keep/a.ts", "logs/keep.log", "small.md", "sub/.gitignore", "sub/logs/y.log"]
    assert names("source") == ["idx/z.ts", "keep/a.ts"] and names("doc") == ["small.md"] and names("plain") == [".gitignore", "small.md", "sub/.gitignore"]


def test_many_rules_meet_their_own_directories(spark):
    files = spark.createDataFrame([("a/b/x.ts",), ("a/y.ts",), ("b/x.ts",), ("top.ts",), (None,)], "rel string")
    rules = spark.createDataFrame([("a", "x.ts"), ("", "top.*"), ("b", "/y.ts"), ("a", "x.ts")], "dir string, rule string")
    want = ["a/y.ts", "b/x.ts", None]
    for most in (2_000, 1):
        assert sorted((r["rel"] for r in FS.drop_ignored(files, rules, most_inlined=most).collect()), key=str) == sorted(want, key=str)


def test_git_failures_are_no_empty_rows(tree):
    sha = git.head_sha(str(tree))
    assert git.patches(str(tree), [sha])[sha].startswith("diff --git") and git.patches(str(tree), []) == {}
    assert git.blobs(str(tree), [f"{sha}:app.json", f"{sha}:none", f"{sha}:src"]) == ['{"name": "demo"}', None, None]
    with pytest.raises(git.GitError):
        git.patches(str(tree), ["0" * 40])


def test_history(spark, tree):
    commits = git.history(spark, str(tree)).orderBy("log_pos").collect()
    assert [c["title"] for c in commits] == ["fix login of padded names", "add the auth service"]
    assert commits[0]["parents"] == [commits[1]["sha"]] and git.head_sha(str(tree)) == commits[0]["sha"]
    assert git.branch_name(str(tree)) == "main" and git.git_root(str(tree / "src")) == str(tree)
    assert git.history(spark, "/nowhere").count() == 0 and git.branch_name("/nowhere") is None


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, str(tree), str(tmp_path))
    with pytest.raises(NotIndexedError):
        engine.get_symbol("x").count()
    told = []
    first = engine.index_project(lambda *x: told.append(x))
    assert told == [("embedding", 0, first.embedded), ("storing", first.embedded, first.embedded)]
    assert first.chunks == first.embedded > 5 and first.deleted == first.orphans == 0
    newest = engine.recent_changes(sync=False).first()
    assert newest["change_type"] == "fix" and newest["symbols"] == ["AuthService.login"] and newest["files"] == ["src/auth.ts"]
    assert newest["summary"].startswith("fix change: touches AuthService.login. fix login of padded names.")
    got = engine.get_symbol("AuthService.logout").first()
    assert got["callees"] == ["AuthService.login"] and got["type"] == "method"
    both = {r["symbol"]: r["chunk_row"] for r in engine.get_symbols(["AuthService.login", "nope"]).collect()}
    assert both["nope"] is None and both["AuthService.login"] is not None
    around = [r["symbol"] for r in engine.expand_graph(["check"], 2, "in").collect()]
    assert around == ["check", "AuthService.login", "AuthService.logout"]
    assert engine.list_symbols("tool").first()["file"] == "src/tool.php"
    assert engine.get_file_chunks("src/auth.ts").count() == 3 and engine.get_file_chunks("none").count() == 0
    answer = engine.query_project("auth login").collect()
    assert answer[0]["file"] == "src/auth.ts" or any(r["symbol"] == "AuthService.login" for r in answer)
    assert engine.index_status().first()["entries"] >= 3
    status = engine.project_status(sync=False)
    assert status["recent_fixes"].count() == 1 and status["active_topics"].count() > 0
    assert [r["title"] for r in engine.feature_map(sync=False).where("part = 'documented'").collect()] == ["What It Does"]
    hits = engine.query_project_memory("what does the login feature do", 3, dt.datetime(2030, 1, 1), sync=False).collect()
    assert hits and hits[0]["score"] >= hits[-1]["score"]
    lines = {(r["part"], r["line"]) for r in render.status_lines(status).collect()}
    assert ("recent_fixes", "fix login of padded names") in lines and render.memory_lines(engine.query_project_memory("login", 1, dt.datetime(2030, 1, 1), sync=False)).first()["line"][1] == "."
    assert render.feature_lines(engine.feature_map(sync=False)).first()["line"].startswith("What It Does: ") and render.result_lines(engine.query_project("auth login")).count() == len(answer)
    for bad in (lambda: engine.expand_graph(["a"], 4), lambda: engine.get_symbols([]), lambda: engine.recent_changes(0, sync=False)):
        with pytest.raises(ValueError):
            bad()

    (tree / "src/tool.php").unlink()
    os.utime(tree / "src/auth.ts", (2e9, 2e9))
    assert engine.latest_sha() == git.head_sha(str(tree))
    second = engine.index_project()
    assert second.deleted > 0 and second.entries_added == second.entries_deleted == 0 and 0 < second.embedded < first.embedded
    assert engine.get_symbol("T\\run").count() == 0


def test_command_line(spark, tree, tmp_path, capsys):
    from codeloam import cli

    assert cli.main(["--store", str(tmp_path), "query", "login", "--dir", str(tree)]) == 1
    assert cli.main(["--store", str(tmp_path), "changes", "--dir", str(tree), "--limit", "1"]) == 0
    assert "fix login of padded names" in capsys.readouterr().out


def test_stream_merges_like_a_batch(spark, data_dir, tmp_path):
    table = spark.read.parquet(f"{data_dir}/code_chunks.parquet").where("id IS NOT NULL")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    sync_chunks(stream, store, str(tmp_path / "ck")).awaitTermination()
    want = newest_rows(table, ["project", "id"], "chunk_row")
    got = store.read("chunks")
    assert got.count() == want.count() and got.select("chunk_row").exceptAll(want.select("chunk_row")).count() == 0
    q = activity(stream).writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM activity").first()[0] > 0


def test_progress_bar():
    assert render.progress_bar(3, 10, 10) == "[###-------]  3/10" and render.progress_bar(0, 0, 4) == "[####] 0/0"


def test_store_replaces_whole_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.range(3))
    store.write("t", store.read("t").where(F.col("id") > 0))
    assert sorted(r["id"] for r in store.read("t").collect()) == [1, 2] and store.read_or_none("none") is None
    before = store.read("t")  # a reader of the version before is not disturbed
    store.write("t", spark.range(7))
    assert before.count() == 2 and store.read("t").count() == 7
    for _ in range(3):
        store.write("t", spark.range(1))
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
