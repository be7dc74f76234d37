import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloam.extract.diff import parse_commits, parse_patches, parse_status
from codeloam.extract.markdown import split_sections
from codeloam.functions import text as T
from codeloam.operators import incremental, intervals, memory, vectors
from codeloam.operators.ordering import greedy_budget


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 15_000), min_size=1, max_size=12))
def test_greedy_budget_skips_and_goes_on(spark, sizes):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate(sizes)], "key string, pos int, size int")
    total, want = 0, []
    for i, s in enumerate(sizes):
        if total + s <= 12_000:
            total += s
            want.append((i, total))
    got = sorted((r["pos"], r["used"]) for r in greedy_budget(rows, "key", "size", "pos").collect())
    assert got == want


def test_greedy_budget_walks_lists_of_any_length(spark):
    """Two keys over several Arrow batches; most of what fits comes after row 250."""
    sizes = {"a": [12_001] * 400 + [5_000, None, 7_001, 7_000, 1, 0] + [12_001] * 30_000 + [None], "b": [40] * 299 + [41, 40, 1], None: [1] * 300}
    rows = spark.createDataFrame([(k, i, s) for k, ss in sizes.items() for i, s in enumerate(ss)], "key string, pos int, size int")
    got = sorted((r["key"] or "", r["pos"], r["used"]) for r in greedy_budget(rows, "key", "size", "pos").collect())
    a = [("a", 400, 5_000), ("a", 401, 5_000), ("a", 403, 12_000), ("a", 405, 12_000), ("a", 30_406, 12_000)]
    b = [("b", i, 40 * (i + 1)) for i in range(299)] + [("b", 300, 12_000)]
    assert got == [("", i, i + 1) for i in range(300)] + a + b


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(-3, 200)), max_size=8), st.lists(st.tuples(st.integers(1, 300), st.integers(-3, 90)), max_size=6))
def test_overlap_equals_nested_loop(spark, ranges, hunks):
    r = spark.createDataFrame([("f", f"s{i}", a, a + n) for i, (a, n) in enumerate(ranges)], "file string, symbol string, start_line int, end_line int")
    h = spark.createDataFrame([("f", a, a + n) for a, n in hunks], "file string, start int, end int")
    want = sorted(f"s{i}" for i, (a, n) in enumerate(ranges) if n >= 0 and any(m >= 0 and a <= b + m and b <= a + n for b, m in hunks))
    assert sorted(x["symbol"] for x in intervals.touched_symbols(r, h, ["file"]).collect()) == want


def test_overlap_of_very_long_intervals(spark):
    ranges = [("f", "whole", 1, 10**9), ("f", "one", 5, 5), ("f", "far", 7 * 10**8, 7 * 10**8 + 3), ("g", "whole", 1, 10**9), ("g", "miss", 70, 90), ("h", "long", 2, 10**8), ("h", "after", 2 * 10**8, 3 * 10**8)]
    hunks = [("f", 5, 6), ("f", 6 * 10**8, 8 * 10**8), ("g", 10**9, 2 * 10**9), ("h", 1, 10**8 + 5)]
    r, h = spark.createDataFrame(ranges, "file string, symbol string, start_line int, end_line int"), spark.createDataFrame(hunks, "file string, start int, end int")
    got = sorted((x["file"], x["symbol"]) for x in intervals.touched_symbols(r, h, ["file"]).collect())
    assert got == [("f", "far"), ("f", "one"), ("f", "whole"), ("g", "whole"), ("h", "long")]


def test_prune_parents(spark):
    arr = F.array(*map(F.lit, ["AuthService", "AuthService.login", "Auth", "N\\C", "N\\C::m", "Lone"]))
    assert one(spark, intervals.prune_parents(arr)) == ["AuthService.login", "Auth", "N\\C::m", "Lone"]


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


def test_diff_parser(spark):
    df = spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "n int, d string")
    got = parse_patches(df, ["n"], "d").orderBy("n", "file_no").collect()
    assert [(r["path"], r["old_path"], r["status"]) for r in got] == [("src/a.ts", None, "M"), ("new.md", None, "A"), ("old name.ts", None, "D"), ("to.ts", "from.ts", "R")]
    first = got[0]["hunks"]
    assert [tuple(h)[:4] for h in first] == [(3, 0, 4, 2), (10, 1, 12, 0)] and first[0]["header"] == "class A {"
    spans = spark.createDataFrame([(first,)], "h array<struct<old_start:int,old_count:int,new_start:int,new_count:int,header:string>>")
    row = spans.select(T.hunk_ranges(F.col("h"), "new").alias("n"), T.hunk_hints(F.col("h")).alias("t")).first()
    assert [tuple(x) for x in row["n"]] == [(4, 5), (12, 12)] and row["t"] == ["class A {", "run()"]


def test_commit_log(spark):
    log = "s1\x1fp1 p2\x1fAnn\x1fa@x\x1f2024-01-01T00:00:00+05:30\x1ffix it\x1fline 1\nline 2\n\x1e\ns2\x1f\x1fBob\x1fb@x\x1f2023-01-01T00:00:00Z\x1froot\x1f\x1e\n"
    got = parse_commits(spark.createDataFrame([(0, log)], "k int, t string"), ["k"], "t").orderBy("log_pos").collect()
    assert [(r["sha"], r["parents"], r["title"], r["body"]) for r in got] == [("s1", ["p1", "p2"], "fix it", "line 1\nline 2"), ("s2", [], "root", "")]


def test_snapshots_as_json(spark, tmp_path):
    import json

    from codeloam.sources import snapshots as J

    (tmp_path / "m.json").write_text(json.dumps({"mtimes": {"a.ts": 1.5, "b.ts": 2.0}, "fileChunks": {"a.ts": ["x", "y"], "c.ts": []}}))
    read = {r["file"]: (r["mtime_ms"], r["chunk_ids"]) for r in J.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert read == {"a.ts": (1.5, ["x", "y"]), "b.ts": (2.0, None), "c.ts": (None, [])}
    again = J.parse_manifest(J.manifest_json(J.read_manifest(spark, str(tmp_path / "m.json"))), "json")
    assert {r["file"]: (r["mtime_ms"], r["chunk_ids"]) for r in again.collect()} == read | {"b.ts": (2.0, [])}
    (tmp_path / "g.json").write_text(json.dumps({"symbols": {"f": ["g", "h"]}, "callers": {"g": ["f"]}, "files": {"a.ts": ["./x"]}, "symbolFile": {"f": "a.ts"}}))
    g = J.read_graph(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in g["edges"].orderBy("edge_ord").collect()] == [("f", "g", 0), ("f", "h", 1)] and g["symbol_files"].first()["file"] == "a.ts" and g["imports"].first()["import"] == "./x"
    entries = [{"id": "change:1", "kind": "change", "sha": "1", "parents": ["0"], "timestamp": "2024-01-01T00:00:00Z", "title": "t", "topics": ["a"], "impacts": [{"file": "f", "status": "M", "symbols": ["s"], "hints": []}]}, {"id": "doc:2", "kind": "document", "path": "a.md", "docType": "note", "sourceMtimeMs": 5.5}]
    (tmp_path / "p.json").write_text(json.dumps({"branch": "main", "headSha": None, "syncedAt": "now", "maxCommits": 150, "entries": entries}))
    meta, rows = J.read_memory(spark, str(tmp_path / "p.json"))
    assert tuple(meta.first()) == ("main", None, "now", 150) and [r["id"] for r in rows.orderBy("pos").collect()] == ["change:1", "doc:2"]
    back = json.loads(J.memory_json(rows, "main", None, "now", 150).first()["json"])
    assert back["entries"] == entries and back["maxCommits"] == 150
    (tmp_path / "c.json").write_text(json.dumps({"x": [1.0, 2.0]}))
    assert J.read_cache(spark, str(tmp_path / "c.json")).first()["vector"] == [1.0, 2.0]
    assert J.read_cache(spark, str(tmp_path / "no.json")).count() == J.read_manifest(spark, str(tmp_path / "no.json")).count() == 0


def test_entry_labels(spark):
    rows = [("change", "abcdef0123", "fix", None, None, None), ("document", None, None, "note", "docs/a.md", "Intro"), ("document", None, None, "note", "docs/a.md", "a.md"), ("document", None, None, "note", "docs/a.md", None)]
    d = spark.createDataFrame(rows, "kind string, sha string, change_type string, doc_type string, path string, section string")
    c = F.col
    got = d.select(T.entry_label(c("kind"), c("sha"), c("path")), T.entry_type(c("kind"), c("change_type"), c("doc_type")), T.entry_source(c("kind"), c("sha"), c("path"), c("section"))).collect()
    assert [tuple(r) for r in got] == [("abcdef01", "fix", "abcdef0123"), ("docs/a.md", "note doc", "docs/a.md > Intro"), ("docs/a.md", "note doc", "docs/a.md"), ("docs/a.md", "note doc", "docs/a.md")]
    assert one(spark, T.utf16_length(F.lit("a\U0001F600é"))) == 4 and one(spark, T.utf16_length(F.lit(None).cast("string"))) == 0


def test_status_lines(spark):
    df = spark.createDataFrame([(" M a.ts",), ("?? b.md",), ("R  old.ts -> new.ts",)], "l string")
    assert [tuple(r) for r in parse_status(df, "l").collect()] == [("a.ts", "M"), ("b.md", "??"), ("new.ts", "R")]


def test_sections(spark):
    text = "intro\n# What It Does\n`login` is the feature\n```\n# not a heading\n```\n## Empty\n\n### Architecture\nlayers"
    df = spark.createDataFrame([(1, "docs/a.md", text), (2, "b.md", None), (3, "c.md", ""), (4, "x/d.md", "# only\n")], "n int, path string, text string")
    got = {(r["n"], r["section_no"]): (r["title"], r["body"]) for r in split_sections(df, ["n"], "text").collect()}
    assert got[1, 0] == ("a.md", "intro") and got[1, 1][0] == "What It Does" and "# not a heading" in got[1, 1][1]
    assert got[1, 2] == ("Architecture", "layers") and (2, 0) not in got and got[3, 0] == ("c.md", "") and got[4, 0][0] == "d.md"
    types = df.where("n = 1").select(T.document_type(F.lit("a.md"), F.lit("What It Does"), F.lit("x")).alias("f"), T.document_type(F.lit("a.md"), F.lit("Architecture"), F.lit("y")).alias("a"), T.document_type(F.lit("CHANGELOG.md"), F.lit("z"), F.lit("y")).alias("c")).first()
    assert tuple(types) == ("feature", "architecture", "changelog")


def test_scalars(spark):
    assert one(spark, T.branch_slug(F.lit("feature/a:b*"))) == "feature-a-b" and one(spark, T.branch_slug(F.lit("//"))) == "default"
    assert one(spark, T.diff_path(F.lit('"a/x y.ts"'))) == "x y.ts"
    assert one(spark, T.split_tokens(F.lit("fixAuthService the LOGIN2 ab"), ["the"])) == ["fix", "auth", "service", "login2"]
    assert one(spark, T.change_type(F.lit("prefix work"), F.lit(None), F.array())) == "fix"
    assert one(spark, T.change_type(F.lit(None), F.lit(None), F.lit(None).cast("array<string>"))) == "chore"
    assert one(spark, T.inline_symbols(F.lit("`a b` `login` `x` `login` `src/a.ts`"))) == ["login", "src/a.ts"]
    assert one(spark, T.line_slice(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(3))) == "b\nc"
    assert one(spark, T.meaningful_lines(F.lit("# Title of it all\n---------------\n- [a link text](x) here\nshort"))) == ["Title of it all", "a link text here"]


ENTRY = "project string, id string, kind string, timestamp string, title string, change_type string, topics array<string>, doc_type string"


def entries(spark, rows):
    e = spark.createDataFrame(rows, ENTRY)
    return memory.dated(e.withColumn("kind_ord", F.when(F.col("kind") == "change", 0).otherwise(1)))


def test_feature_map_and_status(spark):
    e = entries(spark, [
        ("p", "1", "document", "2024-01-01T00:00:00Z", "Setup", None, [], "feature"), ("p", "2", "document", "2024-01-03T00:00:00Z", "Engine", None, ["b", "a"], "architecture"),
        ("p", "3", "document", "2024-01-02T00:00:00+02:00", "Parts", None, ["a"], "architecture"), ("p", "4", "change", "2024-01-04T00:00:00Z", "x", "feature", ["a"], None),
        ("q", "5", "document", "not a time", "Usage", None, None, "overview"), ("q", "6", "change", None, "y", "fix", [], None),
    ])
    got = [(r["project"], r["part"], r["id"]) for r in memory.feature_map(e).orderBy("project", "part", "pos").collect()]
    assert got == [("p", "documented", "2"), ("p", "documented", "3"), ("p", "recent", "4"), ("q", "documented", "5")]
    assert [r["id"] for r in memory.feature_documents(e).where("project = 'p'").orderBy("pos").collect()] == ["2", "3"]
    assert [(r["topic"], r["n"]) for r in memory.topic_histogram(e).where("project = 'p'").orderBy(F.desc("n"), "topic").collect()] == [("a", 3), ("b", 1)]
    assert [r["id"] for r in memory.recent_changes(e, 5, topic="A").collect()] == ["4"]
    with pytest.raises(ValueError):
        memory.recent_changes(e, 26)
    ranked = memory.rerank(e.withColumn("cosine", F.lit(0.5)).withColumn("hit_pos", F.col("id").cast("int")), "what is the architecture", dt.datetime(2024, 1, 5)).collect()
    assert ranked[0]["id"] == "2" and len(ranked) == 6


def test_manifest_difference(spark):
    m = "project string, file string, mtime_ms double, chunk_ids array<string>"
    old = spark.createDataFrame([("p", "same", 1.0, ["a"]), ("p", "touched", 1.0, ["b", "c"]), ("p", "gone", 1.0, ["d"]), ("p", "no time", None, ["e"]), ("p", "gone too", None, ["f"]), (None, None, None, None)], m)
    new = spark.createDataFrame([("p", "same", 1.0, ["a"]), ("p", "touched", 2.0, ["b"]), ("p", "no time", 3.0, ["e"])], m)
    assert sorted((r["chunk_id"], r["reason"]) for r in incremental.stale_chunks(old, new).collect()) == [("b", "changed"), ("c", "changed"), ("d", "gone"), ("f", "gone")]
    a, b = spark.createDataFrame([("p", "1"), ("p", "2"), ("p", None)], "project string, id string"), spark.createDataFrame([("p", "2"), ("p", "3")], "project string, id string")
    assert sorted((r["id"], r["change"]) for r in incremental.entry_difference(a, b).collect()) == [("1", "stale"), ("3", "added")]
    assert [r["id"] for r in incremental.orphan_ids(a, b).collect()] == ["1"]
    assert incremental.upsert(a, b, ["project", "id"]).where("id IS NOT NULL").count() == 3


def test_exact_search_ties_and_unusable(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.exact_search(v, v, 2, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (3, 1), (8, 1), (8, 2)]
    assert vectors.exact_search(v.where("vec_id > 100"), v, 2, 2).count() == 0
    assert spark.range(1).select(vectors.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))).alias("c")).first()["c"] == pytest.approx(1)


def test_embedder_is_deterministic():
    a, b = vectors.embed(["readConfig file", ""]), vectors.embed(["readConfig file", None])
    assert (a == b).all() and abs((a[0] ** 2).sum() - 1) < 1e-5 and not a[1].any()


def test_timeline_places_in_a_large_project(spark):
    rows = [("big" if i % 10 else "small", f"{i:04}", "change", f"2024-01-{1 + i % 9:02}T00:00:00Z", "t", "fix", [], None) for i in range(400)] + [("big", "none", "document", None, "t", None, None, None), (None, "x", "change", None, "t", None, None, None)]
    e = entries(spark, rows).repartition(4)
    got = memory.timeline(e).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {*e.columns, "pos"}
    for project in ("big", "small", None):
        mine = sorted((r["pos"], r["id"]) for r in got if r["project"] == project)
        want = sorted((r for r in rows if r[0] == project), key=lambda r: (r[3] is None, [-ord(c) for c in r[3] or ""], r[2] != "change", r[1]))
        assert mine == [(i + 1, r[1]) for i, r in enumerate(want)]
