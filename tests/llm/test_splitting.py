import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloam.llm.splitting import merge, split_oversized

PIECES = st.sampled_from(["word ", "a sentence. ", "\n", "\n\n", "}\n", "# head\n", "x" * 70, "\r\n", "日本語。", "e\u0301", "  indented\n"])


def check(text, size, overlap):
    pieces = merge(text, size, overlap)
    if len(text) <= size:
        assert pieces == ([(0, len(text), 0, 0.0)] if text else [])
        return
    whole = [text[s - r : e] for s, e, r, _ in pieces]
    assert all(len(p) <= size for p in whole) and "".join(text[s:e] for s, e, _, _ in pieces) == text
    for a, b, (_, _, r, _) in zip(whole, whole[1:], pieces[1:]):
        assert r == min(overlap, len(a)) and b.startswith(a[len(a) - r :])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(12, 90), st.integers(0, 10))
def test_pieces(text, size, overlap):
    check(text, size, overlap)


def test_cuts_at_natural_boundaries():
    code = "".join(f"function f{i}() {{\n  return {i};\n}}\n\n" for i in range(40))
    pieces = merge(code, 300, 20)
    assert all(code[:e].endswith("\n\n") for _, e, _, _ in pieces)
    text = "One sentence here. Another one there. " * 30
    assert all(text[e - 2 : e] == ". " for _, e, _, _ in merge(text, 200, 0))


@pytest.mark.parametrize("text", ["x" * 100_000, "\n" * 5000, "word " * 30_000, "\ud7ff" * 1000])
def test_very_long_texts(text):
    check(text, 600, 24)


def test_table(spark):
    df = spark.createDataFrame([(1, "a b " * 50, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (1, "a b " * 50, "x"), (5, "é" * 100, "x"), (6, "é" * 101, "x")], "chunk_row long, code string, piece string")
    rows = split_oversized(df, "chunk_row", "code", "code", 100, 10).collect()
    assert {r["item_row"] for r in rows} == {1, 6} and sum(r["piece_no"] == 0 for r in rows) == 3
    assert all(len(r["piece"]) <= 100 and r["n_pieces"] > 1 for r in rows)
    assert split_oversized(df.limit(0), "chunk_row", "code", "code", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "chunk_row", "code", "code", 10, 10)
