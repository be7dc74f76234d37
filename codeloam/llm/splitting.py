"""Cutting oversized texts at natural boundaries by agglomerative merging (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries, weakest first: each has a rank, and a cut prefers the highest.
WORD, SENTENCE, LINE, BLOCK, BLANK, HEADING = 1, 2, 3, 4, 5, 6
_SENTENCES = re.compile(r".+?(?:[.!?;:]+[\"')\]]*\s+|[。！？]+|\Z)", re.S)
_WORDS = re.compile(r"\s*\S+\s*|\s+")
_CLOSES = re.compile(r"\s*(?:[})\]]+[;,]?|</[\w:.-]+>|end|fi|done|esac)\s*\Z")
_OPENS = re.compile(r"\s*(?:export|function|class|interface|type|enum|async|public|private|protected|static|final|abstract|namespace|def|import|module|describe|test|it|/\*\*)\b|\s*/\*\*|\[[^\]]+\]\s*\Z|\w[\w.-]*:\s*\Z")
_HEADING = re.compile(r"#{1,6}\s|={3,}|-{3,}")


def atoms(text: str, size: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at its end) of the atomic segments: lines, and where a
    line exceeds ``size`` its sentences, then words, then runs of ``size``. Ends never fall inside
    a CRLF or before a combining mark."""
    out: list[tuple[int, int, int]] = []

    def fine(a: int, b: int, last: int) -> None:
        if b - a <= size:
            out.append((a, b, last))
            return
        for pattern, strength in ((_SENTENCES, SENTENCE), (_WORDS, WORD)):
            ends = [m.end() for m in pattern.finditer(text, a, b)]
            if len(ends) > 1:
                starts = [a, *ends[:-1]]
                for s, e in zip(starts, ends):
                    if e - s <= size or pattern is _SENTENCES:
                        fine(s, e, last if e == b else strength)
                    else:
                        hard(s, e, last if e == b else strength)
                return
        hard(a, b, last)

    def hard(a: int, b: int, last: int) -> None:
        while b - a > size:
            e = a + size
            while e > a + 1 and (text[e - 1 : e + 1] == "\r\n" or text[e] in "‍️" or "̀" <= text[e] <= "ͯ" or text[e - 1] == "‍"):
                e -= 1
            out.append((a, e, 0))
            a = e
        out.append((a, b, last))

    lines = text.splitlines(keepends=True) if "\n" not in text else [x + "\n" for x in text.split("\n")]
    if "\n" in text:
        lines[-1] = lines[-1][:-1]
    lines = [x for x in lines if x]
    at = 0
    for i, line in enumerate(lines):
        following = lines[i + 1] if i + 1 < len(lines) else ""
        if not following.strip():
            strength = LINE
        elif _HEADING.match(following):
            strength = HEADING
        elif not line.strip():
            strength = BLANK
        elif _CLOSES.match(line) or _OPENS.match(following):
            strength = BLOCK
        else:
            strength = LINE
        if strength >= BLOCK and following[:1] in " \t":
            strength -= 0.5 * min(1.8, (len(following) - len(following.lstrip())) / 4)
        fine(at, at + len(line), strength)
        at += len(line)
    return out


def merge(text: str, max_size: int, overlap: int) -> list[tuple[int, int, int, float]]:
    """(content start, content end, repeated characters before it, strength of the cut at its end).

    Neighbouring segments are merged, weakest boundary first (between equals the smaller result),
    as long as the merged size and the overlap fit into ``max_size``. A piece with its repeated part
    is ``text[start - repeated : end]``.
    """
    if len(text) <= max_size:
        return [(0, len(text), 0, 0.0)] if text else []
    room = max_size - overlap
    parts = atoms(text, room)
    n = len(parts)
    start, end, cut = [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def fits(i: int, j: int) -> bool:
        return end[j] - start[i] <= (max_size if start[i] == 0 else room)

    heap = [(cut[i], end[i + 1] - start[i], i, i + 1) for i in range(n - 1) if fits(i, i + 1)]
    heapify(heap)
    while heap:
        _, size, i, j = heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size:
            continue  # one of the two has grown or is gone
        end[i], cut[i], alive[j] = end[j], cut[j], False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if fits(i, k):
                heappush(heap, (cut[i], end[k] - start[i], i, k))
        h = before[i]
        if h >= 0 and fits(h, i):
            heappush(heap, (cut[h], end[i] - start[h], h, i))
    out, repeated = [], 0
    for i in range(n):
        if alive[i]:
            out.append((start[i], end[i], repeated, float(cut[i])))
            repeated = min(overlap, end[i] - start[i] + repeated)
    return out


def split_oversized(items: DataFrame, item_row: str, text: str, item_kind: str, max_size: int, overlap: int) -> DataFrame:
    """``item_kind``, ``item_row``, ``piece_no`` (from 0), ``n_pieces``, ``start``, ``end`` (code
    points of the piece in its text, the repeated part included), ``repeated``, ``strength`` of the
    boundary at its end, and ``piece``; one row for each piece of each text over ``max_size``.

    A piece is at most ``max_size`` code points and, but for the first, begins with the last
    ``overlap`` of the piece before it (all of it where that is shorter); without those repeats the
    pieces make the text again. Texts within the limit, null and empty ones give no row; repeated
    rows are each cut. The length filter runs before any Python; there is no shuffle.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than max_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in zip(batch.column(0), batch.column(1)):
                whole = body.as_py()
                pieces = merge(whole, max_size, overlap)
                n = len(pieces)
                columns = zip(*((i, n, s - r, e, r, c, whole[s - r : e]) for i, (s, e, r, c) in enumerate(pieces)))
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([item_kind] * n), pa.array([row.as_py()] * n, row.type), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    names = ["item_kind", "item_row", "piece_no", "n_pieces", "start", "end", "repeated", "strength", "piece"]
    kind = dict(items.dtypes)[item_row]
    large = items.select(F.col(item_row).alias("__row"), F.col(text).alias("__text")).where(F.length("__text") > max_size)
    return large.mapInArrow(run, f"item_kind string, item_row {kind}, piece_no int, n_pieces int, start int, end int, repeated int, strength double, piece string")
