"""Byte-level BPE encoding of a whole corpus with a public vocabulary (problem 6)."""

from __future__ import annotations

import base64
import itertools
import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.llm.perfect_hash import PerfectHash

# Fixed value: the public pattern that splits a text before the merges of the rank files.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: Unicode White_Space, which is what \s means there (``re`` would add U+001C..U+001F).
SPACE = "\t-\r \x85\xa0  -     　"

#: Words kept per worker before its memo is emptied; a cache only, it changes no result.
MEMO = 1 << 19


class Encoder:
    """Encodes texts with a rank file.

    No pre-token contains white space except as its first character, so a text is first cut at
    white space (``WORD``), and the pre-tokens and ids of each distinct word are looked up once.
    A pre-token that is in the vocabulary resolves through the minimal perfect hash; any other is
    merged, lowest rank first, by a heap over the linked list of its bytes.
    """

    WORD = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def __init__(self, ranks: PerfectHash, pairs: dict[int, int], single: list[int]):
        self.ranks, self.pairs, self.single = ranks, pairs, single
        self.pre = regex.compile(PRE_TOKENS.replace(r"^\s", f"^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self._reset()

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pairs = {a << 32 | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        return cls(PerfectHash([*ranks], [*ranks.values()]), pairs, [ranks[bytes((b,))] for b in range(256)])

    def __getstate__(self):
        return self.ranks, self.pairs, self.single

    def __setstate__(self, state):
        self.__init__(*state)

    def _reset(self) -> None:
        encoder = self

        class Memo(dict):
            def __missing__(self, word: str) -> int:
                ids = encoder.word(word)
                self[word] = at = len(encoder.sizes)
                encoder.sizes.append(len(ids))
                encoder.flat.extend(ids)
                return at

        self.memo, self.sizes, self.flat = Memo(), array("q"), array("i")
        self.merged: dict[str, tuple[int, ...]] = {}

    def merge(self, token: bytes) -> tuple[int, ...]:
        """Ids of one pre-token that is not in the vocabulary as a whole."""
        n, get, single = len(token), self.pairs.get, self.single
        ids = [single[b] for b in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids.append(-1)
        heap = [r << 32 | i for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p[0] << 32 | p[1])) is not None]
        heapify(heap)
        while heap:
            item = heappop(heap)
            r, i = item >> 32, item & 0xFFFFFFFF
            if ids[i] < 0 or get(ids[i] << 32 | ids[j := after[i]]) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(r << 32 | ids[k])) is not None:
                    heappush(heap, x << 32 | i)
            if (h := before[i]) >= 0 and (x := get(ids[h] << 32 | r)) is not None:
                heappush(heap, x << 32 | h)
        return tuple(x for x in ids if x >= 0)

    def word(self, word: str) -> list[int]:
        out: list[int] = []
        for pre in self.pre.findall(word):
            if (ids := self.merged.get(pre)) is None:
                whole = self.ranks.get(token := pre.encode())
                self.merged[pre] = ids = self.merge(token) if whole is None else (whole,)
            out += ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; offsets of the texts in them)."""
        if len(self.memo) > MEMO:
            self._reset()
        find = self.WORD.findall
        words = [find(t) if t else () for t in texts]
        codes = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        sizes, flat = np.array(self.sizes), np.array(self.flat)
        starts = np.cumsum(sizes) - sizes
        took = sizes[codes] if len(codes) else codes
        ends = np.cumsum(took)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[codes] - ends + took, took) + np.arange(total) if total else np.zeros(0, np.int64)
        word_ends = np.cumsum([len(w) for w in words])
        offsets = np.zeros(len(texts) + 1, np.int64)
        if total:
            offsets[1:] = np.concatenate(([0], ends))[word_ends]
        return (flat[at] if total else np.zeros(0, np.int32)), offsets


def tokenizer_dir() -> str:
    """Where the public vocabularies lie; ``CODELOAM_TOKENIZERS`` overrides it."""
    return os.environ.get("CODELOAM_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or tokenizer_dir(), f"{name}.tiktoken")


def encode_corpus(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``keep`` columns plus ``ids`` (array<int>): the text's token ids without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary
    text; very long runs are merged in n log n. Other columns, whatever their names, are not read.
    One narrow pass without a shuffle; the vocabulary (about 1 MB, fixed by its file) is broadcast.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Encoder.from_file(vocabulary(name, folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, offsets = encoder.encode(part.column(len(keep)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), lists], names=[*keep, "ids"])

    kept = documents.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.select(*keep).dtypes) + ", ids array<int>"
    return kept.mapInArrow(run, schema)
