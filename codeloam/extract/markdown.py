"""Sections of Markdown texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.functions.constants import DOC_BODY_CHARS, DOC_SECTIONS

#: Unicode white space (``str.strip`` alone would take U+001C to U+001F too).
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
_HEADING = re.compile(r"#{1,6}[ \t\n\x0b\x0c\r]+([^\n]+?)[ \t\n\x0b\x0c\r]*\Z")
_STARTS = re.compile(r"#{1,6}[ \t\n\x0b\x0c\r]+[^ \t\n\x0b\x0c\r]")


def sections(text: str, fallback: str, most: int = DOC_SECTIONS) -> list[tuple[str, str]]:
    """(title, body) of a text's first ``most`` sections."""
    out: list[tuple[str, str]] = []
    title, lines, fence = fallback, [], False

    def close() -> None:
        body = "\n".join(lines).strip(_BLANKS)
        if body:
            out.append((title, body))

    for line in text.split("\n"):
        if "```" in line and line.strip(_BLANKS).startswith("```"):
            fence = not fence
        elif line[:1] == "#" and not fence and _STARTS.match(line):
            close()
            m = _HEADING.match(line)
            title, lines = (m[1].strip(_BLANKS) if m else ""), []
            continue
        lines.append(line)
    close()
    return out[:most] or [(fallback, text[:DOC_BODY_CHARS])]


def split_sections(documents: DataFrame, keys: list[str], text: str, path: str = "path", most: int = DOC_SECTIONS) -> DataFrame:
    """``keys``, ``section_no`` (from 0), ``title`` and ``body`` of each text's first ``most`` sections.

    A heading outside a fence closes a section; text before any heading has the file's name as title;
    empty sections are dropped; a text without a section is one, cut to 4,000 signs. Null texts give
    no rows. Keys need not be unique.

    Each text is read line by line where it lies. A fold over an array of lines in SQL copies what it
    has so far at every line (16 MB took 22 s), and exploding the lines would shuffle the corpus.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, no, title, body) for i, (p, t) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())) for no, (title, body) in enumerate(sections(t, re.split(r"[/\\]", p or "")[-1], most))]
            at, numbers, titles, bodies = zip(*rows) if rows else ((), (), (), ())
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(titles, pa.string()), pa.array(bodies, pa.string())], names=[*keys, "section_no", "title", "body"])

    schema = ", ".join(f"`{a}` {b}" for a, b in documents.select(*keys).dtypes) + ", section_no int, title string, body string"
    return documents.select(*keys, F.col(path).alias("__path"), F.col(text).alias("__text")).where("__text IS NOT NULL").mapInArrow(run, schema)
