import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloam.llm.packing import CurvePacker, hilbert_key, pack_documents
from codeloam.llm.perfect_hash import PerfectHash
from codeloam.llm.tokenizer import Encoder, encode_corpus, vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary()), reason="no vocabulary files here")
ODD = ["", None, " ", "hello  world\n\n x", "it's don't 'LL", "<|endoftext|>", "a" * 5000, "é\u0301 ﷽ 日本語。テスト 🙂👩‍💻", "\x00\x1c\x85\u2028 \u3000x", "Ⅷ²½ 12345 一二三", "ab\r\ncd\t\te", "0" * 3000 + " "]


@pytest.fixture(scope="module")
def encoder():
    return Encoder.from_file(vocabulary())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ids_of(encoder, texts):
    ids, offsets = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_perfect_hash():
    keys = [f"key{i}".encode() for i in range(5000)]
    h = PerfectHash(keys, list(range(5000)))
    assert [h.get(k) for k in keys] == list(range(5000)) and len(h.keys) == 5000
    assert all(h.get(f"other{i}".encode()) is None for i in range(2000)) and h.get(b"") is None


def test_odd_texts(encoder, reference):
    texts = [t or "" for t in ODD]
    assert ids_of(encoder, ODD) == reference(texts)
    assert ids_of(encoder, []) == [] and ids_of(encoder, ["", None]) == [[], []]


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(encoder, reference, texts):
    assert ids_of(encoder, texts) == reference(texts)


def test_a_full_memo_changes_nothing(encoder, reference, monkeypatch):
    monkeypatch.setattr("codeloam.llm.tokenizer.MEMO", 3)
    for text in ("one two three four", "five six", "one two"):
        assert ids_of(encoder, [text]) == reference([text])


def test_corpus(spark, reference):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, ODD[3], "x", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, `__text` int")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect())
    assert got == sorted((i, x) for (i, *_), x in zip(rows, reference([r[1] or "" for r in rows])))
    assert encode_corpus(df.limit(0)).count() == 0 and encode_corpus(df).columns == ["doc_id", "ids"]


def test_hilbert_neighbours_touch():
    import itertools

    import numpy as np

    points = np.array(list(itertools.product(range(8), repeat=3)))
    order = points[np.argsort(hilbert_key(points, 3))]
    assert len(set(hilbert_key(points, 3).tolist())) == 512 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_window_larger_than_all(sizes):
    packer = CurvePacker(100)
    boxes = [b for i, n in enumerate(sizes) for b in packer.add(n, (i,))] + [*packer.rest()]
    assert sorted(i for b in boxes for (i,) in b) == list(range(len(sizes))) and not packer.near and not packer.sizes
    assert all(sum(sizes[i] for (i,) in b) <= 100 for b in boxes)
    assert sum(sum(sizes[i] for (i,) in b) <= 50 for b in boxes) <= 1


def test_containers_follow_the_curve():
    rng = np.random.default_rng(2)
    sizes = np.minimum(2048, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1).tolist()
    packer = CurvePacker(2048)
    boxes = [b for i, n in enumerate(sizes) for b in packer.add(n, (i,))] + [*packer.rest()]
    assert sorted(i for b in boxes for (i,) in b) == list(range(len(sizes)))
    assert sum(sizes) / (2048 * len(boxes)) > 0.99
    reach = [max(b)[0] - min(b)[0] for b in boxes]
    assert np.median(reach) < 200 and np.mean([np.std([i for (i,) in b]) for b in boxes]) < 100


def test_containers(spark, reference):
    texts = [("word " * n).strip() for n in (1, 5, 30, 64, 65, 200, 3)] + ["same text here"] * 40 + ["", None, "   "]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7)], "doc_id long, text string, container int").repartition(3)
    rows = pack_documents(df, 64).collect()
    want = {}
    for i, ids in enumerate(reference([t or "" for t in texts])):
        want[i] = len(ids) * (2 if i == 3 else 1)
    got, boxes = {}, {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        boxes.setdefault(r["container"], []).append(r)
    assert got == {i: n for i, n in want.items() if n}
    assert all(sum(r["n_tokens"] for r in b) <= 64 for b in boxes.values())
    for b in boxes.values():  # offsets follow each other
        b.sort(key=lambda r: r["position"])
        assert [r["offset"] for r in b] == [sum(x["n_tokens"] for x in b[:i]) for i in range(len(b))]
    assert {r["doc_id"] for r in rows if r["part"] > 0} == {i for i, n in want.items() if n > 64 and i != 3}
    assert len(boxes) <= -(-sum(want.values()) // 64) + 2
    assert pack_documents(df.limit(0), 64).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, 0)
