"""Command line: index, query, status, changes, features, memory-query."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from codeloam import render
from codeloam.api import Engine, NotIndexedError
from codeloam.session import build_session


def _show(rows: DataFrame, columns: list[str], empty: str) -> None:
    found = rows.select(*columns).collect()
    print("\n".join("  ".join(str(v) for v in r) for r in found) if found else empty)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloam", description=__doc__)
    p.add_argument("--store", help="folder of the index; shared by all executors")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("dir")
    for name, argument in (("query", "question"), ("memory-query", "question"), ("status", None), ("changes", None), ("features", None)):
        s = sub.add_parser(name)
        if argument:
            s.add_argument(argument)
        s.add_argument("--dir", default=".")
        if name in ("changes", "memory-query"):
            s.add_argument("--limit", type=int, default=0)
        if name == "changes":
            s.add_argument("--type")
            s.add_argument("--topic")
    a = p.parse_args(argv)
    engine = Engine(build_session(), a.dir, a.store)
    try:
        if a.command == "index":
            print(engine.index_project(lambda phase, done, total: print(f"{phase} {render.progress_bar(done, total)}")))
        elif a.command == "query":
            _show(render.result_lines(engine.query_project(a.question)).orderBy("pos"), ["line"], "no result")
        elif a.command == "status":
            _show(render.status_lines(engine.project_status()), ["part", "line"], "nothing yet")
        elif a.command == "changes":
            _show(render.change_lines(engine.recent_changes(a.limit or 10, a.type, a.topic)).orderBy("pos"), ["line"], "no changes")
        elif a.command == "features":
            _show(render.feature_lines(engine.feature_map()).orderBy("part", "pos"), ["part", "line"], "no features")
        else:
            _show(render.memory_lines(engine.query_project_memory(a.question, a.limit or 5)), ["line"], "no result")
    except NotIndexedError as e:
        print(f"not indexed: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
