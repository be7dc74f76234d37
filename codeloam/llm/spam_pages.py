"""Keyword-stuffed and link-list pages by a hidden Markov model over lines (problem 8)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.session import materialise

#: States: what a line is. ``other`` holds code, logs, data and noise, which are no spam.
STATES = ("prose", "links", "tags", "menu", "other")
#: What is seen of a line: for each feature its bins, and the first guess of how each state spreads over
#: them (as shares). A line's observation is one bin of each feature; none of them names a state.
FEATURES: dict[str, tuple[int, dict[str, list[float]]]] = {
    # share of the visible characters in links: none, to 0.25, 0.5, 0.75, more
    "linked": (5, dict(prose=[70, 20, 8, 1, 1], links=[2, 3, 10, 35, 50], tags=[94, 3, 1, 1, 1], menu=[80, 8, 4, 4, 4], other=[90, 5, 2, 2, 1])),
    # share of function words: none, to 0.06, 0.12, 0.2, 0.3, more; the same for scripts without blanks
    "functional": (12, dict(prose=[6, 5, 10, 25, 30, 24, 2, 4, 10, 25, 30, 29], links=[80, 8, 5, 4, 2, 1, 80, 8, 4, 4, 2, 2], tags=[60, 18, 12, 6, 2, 2, 70, 14, 8, 4, 2, 2], menu=[80, 8, 5, 4, 2, 1, 80, 8, 4, 4, 2, 2], other=[70, 8, 8, 7, 4, 3, 76, 10, 8, 4, 1, 1])),
    # words between separators: no separator, to 1.5, 2.5, 4, 7, more
    "item": (6, dict(prose=[45, 1, 2, 7, 15, 30], links=[50, 10, 15, 15, 5, 5], tags=[40, 15, 20, 18, 6, 1], menu=[20, 35, 30, 10, 4, 1], other=[50, 14, 14, 11, 6, 5])),
    # how it ends: a full stop or the like, a colon, inner full stops only, none, a semicolon or brace
    "end": (5, dict(prose=[78, 6, 6, 9.5, 0.5], links=[3, 2, 10, 84, 1], tags=[16, 2, 2, 79, 1], menu=[3, 3, 4, 89, 1], other=[8, 7, 15, 45, 25])),
    # words: none, to 2, 5, 10, 25, more
    "length": (6, dict(prose=[1, 3, 8, 22, 53, 13], links=[12, 25, 38, 15, 7, 3], tags=[4, 20, 28, 16, 17, 15], menu=[2, 20, 30, 25, 20, 3], other=[10, 28, 28, 20, 10, 4])),
    # share of words that the page repeats: none, to 0.15, 0.3, 0.5, 0.75, more; the same without blanks
    "repeated": (12, dict(prose=[40, 24, 22, 11, 2, 0.5, 30, 12, 16, 20, 12, 10], links=[35, 15, 20, 15, 8, 7, 30, 14, 14, 14, 14, 14], tags=[12, 5, 8, 15, 25, 35, 6, 4, 10, 20, 25, 35], menu=[50, 15, 13, 12, 6, 4, 40, 12, 12, 12, 12, 12], other=[38, 12, 15, 14, 11, 10, 40, 12, 12, 12, 12, 12])),
    # share of distinct words, of lines of six words and more: fewer words, to 0.4, 0.6, 0.8, more
    "varied": (5, dict(prose=[20, 0.2, 0.6, 18, 61], links=[75, 3, 4, 8, 10], tags=[50, 15, 17, 13, 5], menu=[50, 3, 5, 17, 25], other=[60, 5, 7, 13, 15])),
    # share of code marks: none, to 0.03, 0.07, 0.14, more; the line is fenced
    "marks": (6, dict(prose=[62, 20, 10, 5, 2, 1], links=[60, 14, 10, 8, 7, 1], tags=[82, 10, 4, 2, 1, 1], menu=[80, 10, 4, 3, 2, 1], other=[20, 6, 8, 14, 27, 25])),
    # share of digits: none, to 0.06, 0.15, 0.4, more
    "digits": (5, dict(prose=[66, 22, 9, 2, 1], links=[74, 14, 8, 3, 1], tags=[72, 20, 7, 0.9, 0.1], menu=[85, 8, 4, 2, 1], other=[25, 15, 20, 25, 15])),
    # share of words that are hashtags or have a count after them: none, to 0.25, 0.6, more
    "tagged": (4, dict(prose=[97, 2, 0.5, 0.5], links=[97, 1, 1, 1], tags=[60, 6, 9, 25], menu=[97, 1, 1, 1], other=[95, 3, 1, 1])),
    # how it begins: plain, heading, list item, table, quote or remark, markup
    "start": (6, dict(prose=[64, 10, 16, 5, 4, 1], links=[44, 4, 36, 3, 1, 12], tags=[77, 6, 13, 0.5, 2, 1], menu=[75, 4, 14, 1, 1, 5], other=[60, 6, 6, 14, 6, 8])),
    # arrows and bars between words: none, one, more
    "arrows": (3, dict(prose=[95, 4, 1], links=[92, 5, 3], tags=[82, 5, 13], menu=[8, 12, 80], other=[82, 8, 10])),
    # characters a word: no word, to 1.5, 3, 8, 12, 25, 45, more; a script without blanks
    "width": (9, dict(prose=[1, 0.2, 2, 87, 6, 2, 0.8, 0.2, 1], links=[40, 0.2, 3, 40, 11, 4, 2, 1, 1], tags=[1, 0.2, 2, 68, 15, 9, 1.9, 0.1, 3], menu=[1, 0.2, 3, 70, 15, 6, 2.8, 0.2, 2], other=[3, 9, 8, 32, 15, 12, 8, 11, 2])),
}
#: A line's features depend on each other, so their evidence counts less than its sum.
EVIDENCE = 0.5
_STAY = 0.85
#: Parts of a long line are at most about this long.
PART = 240

_LINKISH = re.compile(r"://|\bhref=|\]\(|\bwww\.|[\w-]+\.(?:com|org|net|io|test|example|invalid|info|biz|ru|cn|de|co|dev|app)/")
_LINK = re.compile(r"\[\[[^\]\n]+\]\]|<a\b[^>]*>[^<]*</a>|<a\b[^>]*>|</a>|!?\[(?:!\[[^\]\n]*\]\([^)\s]*\)|[^\]\n])*\]\([^)\s]*\)|\[[^\]\n]*\]:\s*\S+(?:\s+\"[^\"\n]*\")?|(?:https?://|ftp://|www\.)[^\s<>\"')\]]+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|io|test|example|invalid|info|biz|ru|cn|de|co|dev|app)/[^\s<>\"')\]]*")
_MARKUP = re.compile(r"</?(?:ul|ol|li|nav|div|p|br|span|td|tr)\b[^>]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?…。！？][\"'”’)\]*_`]*\s*(?:\(?\[[^\]]*\]\([^)]*\)\)?)?\s*\|?\s*\Z|:\s*\Z")
_SENTENCE_CUT = re.compile(r"(?<=[.!?])\s+(?=[^\s])|(?<=[。！？])")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_COUNTED = re.compile(r"(?<=[^\W\d_])\s?(?:\(\d+\)|×\d+)|(?<=[^\W\d_]):\s?\d+(?=\s|,|\Z)")
_START = re.compile(r"(#{1,6}\s|={3,}\s*\Z|-{3,}\s*\Z)|([-*+•]\s|\d+[.)]\s)|(\|)|(>|//|/\*|\*/)|(<)")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯ก-๿]")
#: Classes of characters, each with a bit.
DIGIT, MARK, SEPARATOR, WIDE, PARTICLE, BLANK, DASH, ARROW = (1 << i for i in range(8))
# The characters of each class; particles and function characters of Japanese and Chinese.
_CLASSES = {
    DIGIT: "0123456789", MARK: "{}()=<>$[]\\@`\"", SEPARATOR: ",;|·•、，；｜#", BLANK: " \t\u3000", DASH: "/-–—*~", ARROW: ">»›→|",
    PARTICLE: "はをにがでのともへやかられますだるいくきむ的了是在会将从后和与或不如果先然本再被把就也都这那有为以上下中",
}
_WIDE_RANGES = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x0E00, 0x0E7F))


@cache
def _character_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for a, b in _WIDE_RANGES:
        table[a : b + 1] |= WIDE
    for bit, signs in _CLASSES.items():
        table[[ord(c) for c in signs]] |= bit
    return table


# Common function words of the languages that use spaces.
FUNCTION_WORDS = frozenset(
    "a about after all also an and any are as at be because been before but by can do does each for from had has have how if in into is it its many may more most must no not nor of off on once one only or other otherwise our over per so some than that the their them then there these they this those to too under until up upon usually was we were what when where which while who why will with without would you your"
    " der die das den dem des ein eine einen einem einer und oder nicht ist sind war wird werden wenn weil auf für mit von vom zum zur bei bis nach über sich auch nur noch wie als aus durch um im am"
    " le la les un une des du de et ou ne pas est sont que qui dans sur pour par avec sans plus ce cette ces il elle au aux en se son sa ses chaque quand avant après à côté reste"
    " el los las una unos y o no es son que en con por para sin del al se su sus como más cada cuando si falta esta este porque aún"
    " o os as um uma e não é são em com da do das dos no na nos nas ao se ser quando antes cada sem esta"
    " i a w z na do po za od o u nie się jest są był była być że to tak ale lub albo oraz gdy kiedy jeśli jeżeli ponieważ aby żeby który która które których jak jako czy tylko już jeszcze też także może można należy ma mają przed przez przy między nad pod bez dla ten ta te tego tej tych tym każdy każda każde zostanie zostaje został została zostały".split()
)


def parts_of(text: str) -> Iterator[tuple[str, bool]]:
    """(line or part of a long line, is it inside a code fence). A fence that no later line of its sign
    closes is an ordinary line."""
    fenced, sign = False, ""
    lines = text.replace("\r", "\n").split("\n")
    closes = {m.group()[-1]: i for i, line in enumerate(lines) if (m := _FENCE.match(line))}
    for i, line in enumerate(lines):
        if not line or line.isspace():
            continue
        fence = _FENCE.match(line)
        if fence and (fence.group()[-1] == sign if fenced else closes[fence.group()[-1]] > i):
            fenced, sign = not fenced, fence.group()[-1]
            yield line, True
            continue
        if len(line) <= PART:
            yield line, fenced
            continue
        held = ""
        for piece in _SENTENCE_CUT.split(line):
            while len(piece) > 2 * PART:  # no sentence: cut at a separator
                at = max(piece.rfind(c, PART // 2, PART) for c in (" ", ",", "|", ";", "、", "，", "#"))
                at = PART if at <= 0 else at
                yield piece[:at], fenced
                piece = piece[at:]
            if _END.search(piece) or len(piece) > 60:
                if held:
                    yield held, fenced
                    held = ""
                yield piece, fenced
            else:
                held += piece + " "
        if held:
            yield held, fenced


_ROOM = len(FEATURES)


def _bins(values: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    """0 for none, else 1 and the number of edges below."""
    return np.where(values <= 0, 0, np.searchsorted(edges, values) + 1)


def read_pages(texts: list[str | None]) -> list[tuple[bytes, np.ndarray]]:
    """(observations of a page's lines, one byte a feature; their visible characters) of each text."""
    lines: list[str] = []  # without links
    words: list[list[str]] = []
    # of each line: visible characters, those outside links, fenced, tags, start, end, function words, repeated, distinct
    facts: list[tuple] = []
    ends: list[int] = []
    particles = frozenset(_CLASSES[PARTICLE])
    for text in texts:
        first = len(facts)
        for part, fenced in parts_of(text.replace("\xa0", " ").replace("\u200b", "")) if text and not text.isspace() else ():
            s = rest = part.strip()
            if not s:
                continue
            visible = outside = len(s) - s.count(" ")
            if "://" in s or "](" in s or "href=" in s or "[[" in s or "/" in s and _LINKISH.search(s):
                rest = _LINK.sub(" ", s)
                if "<" in rest and len(rest) < 0.9 * len(s):
                    rest = _MARKUP.sub(" ", rest)
                outside = len(rest) - rest.count(" ")
            tagged = 0
            if "(" in rest or "×" in rest or ":" in rest:
                rest, tagged = _COUNTED.subn("", rest)
            start = _START.match(s)
            if start and start[3]:
                rest = rest.replace("|", " ")
            low = rest.lower()
            tokens = low.split()
            if "#" in low:
                tagged += sum(w[0] == "#" and len(w) > 1 and w[1] not in "#0123456789" for w in tokens)
            last = rest.rstrip("\"'”’)]*_`| ")[-1:]
            end = 0 if last and last in ".!?…。！？" else 1 if last == ":" else 4 if last and last in ";{}" else 2 if ". " in rest or "。" in rest else 3
            known = tokens if low.isascii() or not _WIDE.search(low) else _WORD.findall(low)
            distinct = len(set(known)) / len(known) if len(known) > 5 else 2.0
            functional = sum(map(FUNCTION_WORDS.__contains__, tokens))
            facts.append((visible, outside, fenced, tagged, start.lastindex if start else 0, end, functional, len(tokens), distinct))
            lines.append(rest)
            words.append(known)
        # words (no function words and no clauses) that make at least a fortieth of the page, and occur four times
        counts = Counter(chain.from_iterable(words[first:]))
        least = max(4, 0.025 * sum(counts.values()))
        common = {w for w, c in counts.items() if c >= least and 1 < len(w) < 25 and w not in FUNCTION_WORDS and (w.isascii() or sum(map(particles.__contains__, w)) < 2)}
        for i in range(first, len(facts)):
            w = words[i]
            facts[i] += (sum(map(common.__contains__, w)) / len(w) if w and common else 0.0,)
        ends.append(len(facts))
    if not facts:
        return [(b"", np.zeros(0, np.int32))] * len(texts)
    visible, outside, fenced, tagged, start, end, functional, tokens, distinct, often = np.array(facts, np.float64).T
    sizes = np.array([len(x) + 1 for x in lines])
    kinds = _character_classes()[np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    begins = np.cumsum(sizes) - sizes
    count = lambda mask: np.add.reduceat(mask, begins, dtype=np.int64)
    of = lambda bit: count((kinds & bit) != 0)
    n = np.maximum(1, sizes - 1)
    spaced = np.zeros(len(kinds), bool)  # between blanks
    spaced[1:-1] = ((kinds[:-2] & BLANK) != 0) & ((kinds[2:] & BLANK) != 0)
    wide, blanks = of(WIDE), of(BLANK)
    unspaced = (wide > n / 5) & (wide >= 4)
    length = np.where(unspaced, np.maximum(1, wide // 2), tokens)
    separators = of(SEPARATOR) + count(spaced & ((kinds & DASH) != 0)) + np.where(unspaced, blanks, 0)
    arrows = np.where(start == 3, 0, count(spaced & ((kinds & ARROW) != 0)))
    share = np.where(unspaced, of(PARTICLE) / 2, functional) / np.maximum(1, length)
    seen = np.stack(
        [
            _bins(1 - outside / np.maximum(1, visible), (0.25, 0.5, 0.75)),
            _bins(share, (0.06, 0.12, 0.2, 0.3)) + 6 * unspaced,
            np.where(separators == 0, 0, np.searchsorted((1.5, 2.5, 4, 7), length / (separators + 1)) + 1),
            end,
            _bins(length, (2, 5, 10, 25)),
            _bins(often, (0.15, 0.3, 0.5, 0.75)) + 6 * unspaced,
            np.where(distinct > 1, 0, np.searchsorted((0.4, 0.6, 0.8), distinct) + 1),
            np.where(fenced > 0, 5, _bins(of(MARK) / n, (0.03, 0.07, 0.14))),
            _bins(of(DIGIT) / n, (0.06, 0.15, 0.4)),
            _bins(tagged / np.maximum(1, tokens), (0.25, 0.6)),
            start,
            np.minimum(2, arrows),
            np.where(unspaced, 8, np.where(tokens == 0, 0, np.searchsorted((1.5, 3, 8, 12, 25, 45), n / np.maximum(1, tokens)) + 1)),
        ],
        axis=1,
    ).astype(np.uint8)
    return [(seen[a:b].tobytes(), visible[a:b].astype(np.int32)) for a, b in zip([0, *ends], ends)]


#: Where each feature's bins begin in one row of a state's emissions.
_FROM = np.concatenate([[0], np.cumsum([n for n, _ in FEATURES.values()])]).astype(np.int64)
BINS = int(_FROM[-1])
_AT = dict(zip(FEATURES, _FROM.tolist()))
#: Runs of bins that share 1. The script is no evidence: features that are read in two ways share 1 for
#: each, and the width of a line without blanks says nothing.
_RUNS = [(a, b) for a, b in zip(_FROM.tolist(), _FROM[1:].tolist()) if a not in (_AT["functional"], _AT["repeated"], _AT["width"])]
_RUNS += [(_AT[f] + i, _AT[f] + i + n) for f, i, n in (("functional", 0, 6), ("functional", 6, 6), ("repeated", 0, 6), ("repeated", 6, 6), ("width", 0, 8))]
_RUNS += [(_AT["width"] + 8, _AT["width"] + 9)]


def _places(seen: bytes) -> np.ndarray:
    """Lines by features: the column of each observed bin in the emissions."""
    return np.frombuffer(seen, np.uint8).reshape(-1, _ROOM) + _FROM[:-1]


class LineModel:
    """Hidden Markov model; a line's observation is one bin of each feature, independent given the
    state. Kept as logarithms of shares."""

    def __init__(self, start: np.ndarray, step: np.ndarray, show: np.ndarray):
        self.start, self.step, self.show = (np.log(x) for x in (start, step, show))

    @classmethod
    def guess(cls) -> LineModel:
        k = len(STATES)
        show = np.array([np.concatenate([f[s] for _, f in FEATURES.values()]) for s in STATES], np.float64)
        for a, b in _RUNS:
            show[:, a:b] /= show[:, a:b].sum(1, keepdims=True)
        step = np.full((k, k), (1 - _STAY) / (k - 1))
        np.fill_diagonal(step, _STAY)
        return cls(np.full(k, 1 / k), step, show)

    def evidence(self, seen: bytes) -> np.ndarray:
        """Lines by states: how well each state explains the line."""
        return EVIDENCE * self.show[:, _places(seen)].sum(2).T

    def label(self, pages: list[bytes]) -> list[np.ndarray]:
        """Most likely states of each page's lines (Viterbi, many pages at a time)."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
        for a in range(0, len(order), 256):
            some = order[a : a + 256]
            sizes = np.array([len(pages[i]) // _ROOM for i in some])
            ends = np.cumsum(sizes)
            shown = self.evidence(b"".join([pages[i] for i in some]))
            first = ends - sizes
            best = self.start + shown[first]
            back = np.zeros((sizes[0], len(some), len(STATES)), np.int8)
            for t in range(1, sizes[0]):
                m = int((sizes > t).sum())  # pages come longest first
                via = best[:m, :, None] + self.step
                back[t, :m] = via.argmax(1)
                best[:m] = via.max(1) + shown[first[:m] + t]
            state = best.argmax(1)
            paths = np.zeros((len(some), sizes[0]), np.int8)
            for t in range(sizes[0] - 1, -1, -1):
                m = int((sizes > t).sum())
                paths[:m, t] = state[:m]
                state[:m] = back[t, np.arange(m), state[:m]] if t else state[:m]
            for row, i in enumerate(some):
                out[i] = paths[row, : sizes[row]]
        return out


def observe_pages(documents: DataFrame, item_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id``, ``seen`` (one byte a feature for each line) and ``size`` (visible characters of each
    line)."""
    kind = dict(documents.dtypes)[item_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = read_pages(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p[0] for p in pages], pa.binary()), pa.array([p[1] for p in pages], pa.list_(pa.int32()))], names=[item_id, "seen", "size"])

    return documents.select(F.col(item_id), F.col(text).alias("__text")).mapInArrow(run, f"`{item_id}` {kind}, seen binary, size array<int>")


def train(observed: DataFrame, rounds: int = 2, weight: float = 2000.0) -> LineModel:
    """Re-estimates steps and emissions from all pages (Viterbi training); a page may begin with any kind
    of line. The first guess counts as ``weight`` lines a state. Counts are summed in each task; what comes back is a table of states by
    states and bins."""
    model = prior = LineModel.guess()
    k = len(STATES)
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model: LineModel = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k + BINS))
            for batch in batches:
                pages = batch.column(0).to_pylist()
                for page, path in zip(pages, model.label(pages)):
                    if page:
                        np.add.at(total, (path[:-1], path[1:]), 1)
                        np.add.at(total, (path[:, None], k + _places(page)), 1)
            at, to = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array(total[at, to])], names=["state", "place", "n"])

        rows = observed.select("seen").mapInArrow(count, "state int, place int, n double").groupBy("state", "place").agg(F.sum("n").alias("n")).collect()
        total = np.zeros((k, k + BINS))
        for r in rows:
            total[r["state"], r["place"]] = r["n"]
        model = estimated(total, prior, weight)
    return model


def estimated(total: np.ndarray, prior: LineModel, weight: float) -> LineModel:
    """The model of counted steps and bins, with the prior as so many lines a state."""
    k = len(STATES)
    step = total[:, :k] + weight * np.exp(prior.step)
    show = total[:, k:] + weight * np.exp(prior.show)
    for a, b in _RUNS:
        show[:, a:b] /= show[:, a:b].sum(1, keepdims=True)
    return LineModel(np.exp(prior.start), step / step.sum(1, keepdims=True), show)


def spam_shares(documents: DataFrame, item_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id`` and the shares ``links``, ``tags``, ``menu`` and ``spam`` (their sum) of its visible
    characters; one row for each row of ``documents``. Null, empty and blank texts have shares of 0."""
    observed = materialise(observe_pages(documents, item_id, text))
    model = train(observed)
    kind = dict(documents.dtypes)[item_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            shares = []
            for path, size in zip(model.label(batch.column(1).to_pylist()), sizes):
                per = np.bincount(path, weights=size, minlength=len(STATES)) if len(path) else np.zeros(len(STATES))
                shares.append(per / max(1, per.sum()))
            s = np.array(shares).reshape(-1, len(STATES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, i]) for i in (1, 2, 3)), pa.array(s[:, 1:4].sum(1))], names=[item_id, "links", "tags", "menu", "spam"])

    return observed.mapInArrow(run, f"`{item_id}` {kind}, links double, tags double, menu double, spam double")
