import numpy as np
import pytest

from codeloam.llm.spam_pages import BINS, FEATURES, STATES, LineModel, estimated, read_pages, spam_shares

PROSE = ["The batch command reads a batch file and prints one batch per line.", "If the queue is missing, the worker returns an empty list and logs a warning.", "During the migration the old table stays readable for two weeks.", "Why was the port changed? Because the proxy no longer listens on it."] * 3
LINKS = [f"- [tool {i}](https://site{i}.example/a/b)" for i in range(14)]
PAGES = {
    "prose": ("\n".join(PROSE), False), "one paragraph": (" ".join(PROSE), False), "changelog": ("# Changelog\n\n## 1.2.0\n" + "\n".join(f"- fix(core): {p} ([#12](https://t.example/12))" for p in PROSE), False), "described links": ("\n".join(f"- [tool](https://x.example/{i}): {p}" for i, p in enumerate(PROSE)), False),
    "code": ("```js\n" + "const a = [1, 2];\n" * 20 + "```\nThis is how the array is made by hand.", False), "log": ("\n".join(f"2024-01-0{i} 10:00 WARN queue: item {i} is late" for i in range(1, 9)) + "\nWe decided to keep the log because it explains the crash.", False),
    "noise": ("aaaa" * 500, False), "base64": ("bbH0j1hPFHMDYPRHzk7DW53rcVnXwpZT" * 30, False), "german": ("Wenn der Dienst fehlt, bricht der Lauf nach 30 Sekunden ab. Die Größe der Tabelle wächst jeden Tag um einen Teil.\n" * 4, False), "chinese": ("如果服务不存在，任务会重试三次。旧的表会保留两天。\n" * 6, False), "empty": ("", False), "null": (None, False), "blank": (" \n\t\n", False),
    "links": ("\n".join(LINKS), True), "bare links": ("\n".join(f"https://a.example/x/{i}" for i in range(20)), True), "hashtags": (" ".join(f"#cheap{w}" for w in "tool code search price online free best fast".split() * 4), True), "keywords": (", ".join(f"{a} code search {b}" for a in "buy best cheap free".split() for b in "online price 2021 download".split()), True),
    "keyword lines": ("\n".join("best code search price\nprice code best search\nfree search code online".split("\n") * 8), True), "tags": (" ".join(f"tag{c} ({i * 7})" for i, c in enumerate("abcdefghijklmnop")), True), "menu": ("\n".join(f"Home > Part {i} > Page {i} | x.example/p/{i}" for i in range(15)), True), "mostly links": (PROSE[0] + "\n" + "\n".join(LINKS), True), "a few links": ("\n".join(PROSE) + "\n" + "\n".join(LINKS[:2]), False),
}


def test_fences():
    model = LineModel.guess()
    marks = list(FEATURES).index("marks")

    def states(lines):
        seen, size = read_pages(["\n".join(lines)])[0]
        assert len(seen) == len(size) * len(FEATURES)
        fenced = [x == 5 for x in seen[marks :: len(FEATURES)]]
        return [STATES[i] for i in model.label([seen])[0]], fenced

    assert states(LINKS)[0].count("links") == len(LINKS)
    assert states(["```", *LINKS])[0].count("links") >= len(LINKS)  # never closed
    assert states(["```js", "const a = 1;", "~~~", "run x", "```", "~~~", *PROSE])[1] == [True] * 5 + [False] * (1 + len(PROSE))
    assert states(["```", *LINKS, "```"])[0].count("links") >= len(LINKS)
    assert set(states(["```sh", "npm run build", "make all", "const a = [1, 2];", "```"])[0]) == {"other"}


def test_pages(spark):
    rows = [(i, text, "x") for i, (text, _) in enumerate(PAGES.values())] + [(1000 + i, "\n".join(PROSE[i % 4 :]), "x") for i in range(40)] + [(0, PAGES["prose"][0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, seen string").repartition(3)
    got = {r["doc_id"]: r for r in spam_shares(df).collect()}
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        assert (got[i]["spam"] > 0.5) is want, name
        assert abs(got[i]["links"] + got[i]["tags"] + got[i]["menu"] - got[i]["spam"]) < 1e-9
    assert len(got) == len(PAGES) + 40 and spam_shares(df).count() == len(rows) and spam_shares(df.limit(0)).count() == 0


def test_viterbi_equals_all_paths():
    import itertools

    m = LineModel.guess()
    pages = [p for p, _ in read_pages(["\n".join(x) for x in (LINKS[:2] + PROSE[:2], ["const a = 1;"], ["buy cheap tool", "Home > A > B", "tag (3)"], PROSE[:4])])]
    assert [p for p, _ in read_pages([None, "", " \n"])] == [b""] * 3
    for page in pages:
        shown = m.evidence(page)
        best = max(itertools.product(range(len(STATES)), repeat=len(shown)), key=lambda p: m.start[p[0]] + sum(m.step[a, b] for a, b in zip(p, p[1:])) + sum(shown[i, s] for i, s in enumerate(p)))
        assert m.label([b"", page, page + page])[1].tolist() == list(best)
    assert [len(x) for x in m.label([b"", pages[1] * 3000])] == [0, 3000] and np.allclose(np.exp(m.step).sum(1), 1)


def test_estimates_without_pages_are_the_first_guess():
    prior = LineModel.guess()
    same = estimated(np.zeros((len(STATES), len(STATES) + BINS)), prior, 10.0)
    assert np.allclose(same.show, prior.show) and np.allclose(same.step, prior.step)


@pytest.mark.parametrize("text", ["a" * 200_000, "# " * 9999, "x, " * 20_000, "\r" * 999, "[](" * 5000, "```\n" + "[" * 200_000 + "\n```", "🙂 " * 5000, "​\xa0 \n​"])
def test_long_and_odd_texts(text):
    seen, size = read_pages([text, "One line."])[0]
    assert len(seen) == len(size) * len(FEATURES)
