"""Generated, minified, vendored and data files among source files (problem 3).

Per language a character trigram model of identifiers is counted over all files, and the spread of the
files' cross-entropies is measured. A file's evidence is added up for each class: names far from the
language's own (mangled) and a dense layout for minified files, names of a few templates (low diversity)
and tools' marks for generated ones, names and text that follow another package and package marks for
third-party ones, machine-made literals and delimited records for data. A class with enough points
takes the file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.llm.files import ending, whole_files
from codeloam.session import materialise

#: Endings that share a model of names.
FAMILY = {"ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "php": "php", "sh": "sh", "json": "data", "yaml": "data", "yml": "data", "xml": "data", "toml": "data", "lock": "data"}
SHINGLE, SIMILARITY = 5, 0.8
#: Names longer than this tell one package from another.
RARE = 8
#: Points from which a class takes a file, and what each piece of evidence counts. ``names``: for each
#: deviation by which a file's cross-entropy exceeds the language's middle, at most ``MOST_DEVIATIONS``, so
#: that names alone, say of an HTML page saved as a script, are not enough.
ENOUGH = 3.0
POINTS = {"names": 0.8, "dense": 1.8, "short": 0.8, "bundle": 3.0, "mark": 3.2, "templates": 3.1, "transpiled": 3.0, "lock": 3.2, "known": 3.75, "text": 3.1, "package": 3.0, "banner": 1.5, "records": 3.1, "literals": 3.0}
MOST_DEVIATIONS = 3.5
CLASSES = ("generated", "third-party", "minified", "data")
#: Least deviation (bits) of a language's cross-entropies, so that a few equal files set no scale.
LEAST_SPREAD = 0.15
#: Names whose bits a worker keeps; a cache only.
MEMO = 1 << 18

# Reserved words of the languages of both models, which are nobody's names.
RESERVED = frozenset("abstract and any array as async await boolean break case catch class clone const constructor continue declare default delete do echo else elseif enum export extends false final finally fn for foreach from function get if implements import in instanceof int interface isset empty let match module exports namespace new null number object of or package private protected public readonly require require_once return self set static string super switch this throw true try type typeof undefined unknown unset use var void while yield".split())
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_DECLARED = re.compile(r"(?:function &?|class |interface |const |var |let |public |protected |private |\.prototype\.)(?:static |function |readonly |int |string |array |\?)*\$?([A-Za-z_$][\w$]*)")
_METHOD = re.compile(r"\n[ \t]+(?:async |static )?([A-Za-z_$][\w$]*)\([^()\n]*\)[^\n{};]*\{")
_BLOCKS = frozenset("if for while switch catch function".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[_$]+")
_HEAD_COMMENT = re.compile(r"\s*(?:<\?php\s*)?(?:#![^\n]*\n\s*)?((?:\s*(?://[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->))+)")
# What tools write at the head of the files they make, in several languages.
_GENERATED = re.compile(
    r"code generated by|(?:file|code|module|class|source) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created) (?:by|from|automatically)|auto[- ]?generated\s*(?:[:.;,!]|by|from|file|code|at|on|\n|\*|$)|automatically generated (?:by|from|file|code|at|on)|generated by [\w.\-]*(?:gen|generator|compiler|tool|protoc|swagger|openapi|codegen)\b|generated from\b[^\n]*(?:schema|idl|proto|spec|\.ya?ml|\.json)|^[\s/*#]*@generated\b|produced (?:from|by) [^\n]*(?:gen\b|generator|task instead|instead of)|instead of (?:changing|editing) this file|(?:changes|edits|modifications)[^\n]{0,40}(?:will be|are|get) (?:lost|overwritten)|do not (?:edit|modify|change) (?:this file|manually|by hand\s*[.!*\n])|do not edit[.!]?\s*(?:\*/|-->|\n|$)|wurde (?:automatisch )?von [^\n]* (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|nicht (?:von hand )?(?:bearbeiten|ändern)|(?:généré|generado|gerado|generato|wygenerowan\w*)\w* (?:automatiquement|autom[aá]ticamente|automaticamente|automatycznie|par|por|da|przez)|(?:ne pas|no) (?:modifier|editar|modificar) (?:ce fichier|este archivo)|自動生成|自动生成",
    re.I | re.M,
)
_GENERATOR_ITSELF = re.compile(r"^[\s/*#]*(?:this (?:generator|script|tool|command|module|helper)|builds? |writes? |checks? |creates? |produces? the)", re.I | re.M)
_PACKAGE = re.compile(r"this file is part of (?:the )?[\w@/.\-]+(?: package| library| project)?\b|\(c\)\s+(?:\d{4}[-\d, ]*)?(?:the )?[\w.\-]+ (?:contributors|authors|developers)|^[\s/*!#]*@?[a-z][\w.\-]*(?:/[\w.\-]+)?[@ ]v?\d+\.\d+\.\d+\s*(?:$|\*|\||-)|@license\b|@preserve\b", re.I | re.M)
_TEXTS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"")
_TRANSPILED = re.compile(r"\(this && this\.__\w+\)|\"__esModule\"|_super\.apply\(this, arguments\)|regeneratorRuntime|_interopRequireDefault|_classCallCheck")
_BUNDLED = re.compile(r"\(function\s*\((?:modules|e|t|n)\)\s*\{[\s\S]{0,400}?(?:\bload\b|require|cache)[\s\S]{0,400}?\}\)\(\{?\[?\s*\n?\s*(?:\d+|\"[^\"]+\")?\s*:?\s*function|__webpack_require__|webpackJsonp|System\.register\(|define\.amd")
_LOCKED = re.compile(r"\"?lockfileVersion\"?\s*:|\"content-hash\"\s*:|^# yarn lockfile|^\s*\"?(?:resolved|integrity|checksum|_hash|sha(?:256|512)|resolution)\"?\s*[:=]", re.M)
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`|(?<![\w$])-?\d+(?:\.\d+)?(?:e[+-]?\d+)?\b")
_KEYS = re.compile(r"-----BEGIN [A-Z ]+-----[\s\S]*?-----END [A-Z ]+-----")
_KEYWORD = re.compile(r"\b(?:function|return|if|for|while|class|import|export|const|let|var|new|throw|switch)\b")


def _signs(name: str) -> str:
    return "^" + re.sub(r"\d", "0", re.sub(r"[^\w$]|[^\x00-\x7f]", "?", name)) + "$$"


def name_trigrams(names: Counter) -> Counter:
    out: Counter = Counter()
    for name, n in names.items():
        s = _signs(name)
        for i in range(len(s) - 2):
            out[s[i : i + 3]] += n
    return out


def names_of(text: str) -> list[str]:
    """The names that a code text uses, in order, without reserved words and what stands in literals
    and comments."""
    return [n for x in _NAME.findall(_TEXTS.sub(" ", text)) if (n := x.lstrip("$") or x) not in RESERVED]


class NameModel:
    """Smoothed trigram model: bits per character of a name."""

    def __init__(self, counts: dict[str, int]):
        self.memo: dict[str, float] = {}
        two: Counter = Counter()
        for t, n in counts.items():
            two[t[:2]] += n
        self.bits = {t: -math.log2((n + 0.1) / (two[t[:2]] + 5.7)) for t, n in counts.items()}
        self.unseen = {p: -math.log2(0.1 / (n + 5.7)) for p, n in two.items()}
        self.worst = -math.log2(0.1 / 5.7)

    def file_bits(self, names: list[str]) -> float | None:
        """Cross-entropy of a file's names, each as often as it is used; None for fewer than five."""
        if len(names) < 5:
            return None
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, total = self.memo, 0.0
        for x in names:
            b = memo.get(x)
            if b is None:
                b = memo[x] = self.cross_entropy(x)
            total += b
        return total / len(names)

    def cross_entropy(self, name: str) -> float:
        s = _signs(name)
        total = 0.0
        for i in range(len(s) - 2):
            t = s[i : i + 3]
            b = self.bits.get(t)
            total += b if b is not None else self.unseen.get(t[:2], self.worst)
        return total / (len(s) - 2)


def shingles(words: list[str]) -> set[int]:
    return {xxhash.xxh3_64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(len(words) - SHINGLE + 1)}


class KnownPackages:
    """Names and word shingles of third-party files."""

    def __init__(self, texts: list[str]):
        words = [re.findall(r"\w+", t) for t in texts]
        self.shingles = [shingles(w) for w in words]
        names = [{x for x in _NAME.findall(t) if len(x) > RARE} for t in texts]
        self.sizes = [len(n) for n in names]
        self.by_name: dict[str, list[int]] = {}
        for i, n in enumerate(names):
            for x in n:
                self.by_name.setdefault(x, []).append(i)

    def nearest(self, names: set[str]) -> tuple[int, float, float]:
        """(file with most of these names, their share of the names given, and of its own)."""
        shared = Counter(i for x in names for i in self.by_name.get(x, ()))
        if not shared or len(names) < 3:
            return 0, 0.0, 0.0
        i, n = shared.most_common(1)[0]
        return i, n / len(names), n / self.sizes[i]


def template_like(declared: list[str]) -> bool:
    """Do a few templates make most declared names?"""
    n = len(declared)
    if n < 6:
        return False
    numbered: Counter = Counter()
    rest: dict[str, set[str]] = {}
    uses: Counter = Counter()
    inner: Counter = Counter()
    verbs: Counter = Counter()
    for name in declared:
        bare = name.rstrip("0123456789")
        if bare != name:
            numbered[bare] += 1
        words = _WORDS.findall(name)
        words = [w for w in words if w.strip("_$")]
        if len(words) > 1:
            verbs[words[0].lower()] += 1
            what = "".join(words[1:]).lower()
            uses[what] += 1
            rest.setdefault(what, set()).add(words[0].lower())
            inner.update({w for w in words[1:] if len(w) > 2 and not w.isdigit()})
    if sum(c for c in numbered.values() if c >= 4) >= 0.6 * n:
        return True
    if inner and n >= 8 and inner.most_common(1)[0][1] >= 0.9 * n:
        return True
    paired = sum(c for k, c in uses.items() if len(rest[k]) > 1)
    few = sum(c for _, c in verbs.most_common(4))
    return paired >= 0.6 * n and few >= 0.85 * sum(verbs.values()) and bool(rest)


def data_share(text: str) -> float:
    """Share of a text's visible characters in numbers and in literals no one writes by hand (key
    blocks, which are credentials, do not count)."""
    text = _KEYS.sub("", text)
    visible = len(text) - sum(map(text.count, " \n\t\r"))
    if not visible:
        return 0.0
    made = 0
    for m in _LITERAL.finditer(text):
        v = m[1] or m[2] or m[3]
        if v is None:
            made += m.end() - m.start() + 1
        elif len(v) > 3 and (not re.search(r"\s", v.strip()) and any(c.isdigit() for c in v) and not re.search(r"[./_]\w+[./_]|^/|://", v) or len(v) > 120 and sum(c.isdigit() for c in v) > len(v) / 8 or len(v) > 200 and len(v.split()) < len(v) / 60):
            made += len(v) + 3
    return made / visible


def records(text: str) -> bool:
    """Is it a table of delimited lines?"""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 8:
        return False
    for d in ";\t,|":
        counts = Counter(x.count(d) for x in lines)
        k, n = counts.most_common(1)[0]
        if k >= 2 and n >= 0.9 * len(lines) and not any(_KEYWORD.search(x) and x.rstrip()[-1:] in "{};" for x in lines):
            return True
    return False


def _marked(top: str) -> bool:
    """Has a head comment the mark of a generated file, in a line that is not about a generator?"""
    for g in _GENERATED.finditer(top):
        line, end = top.rfind("\n", 0, g.start()) + 1, top.find("\n", g.start())
        if not _GENERATOR_ITSELF.search(top, line, end if end >= 0 else len(top)):
            return True
    return False


def known_package(names: list[str], text: str, packages: KnownPackages) -> list[tuple[str, float, str]]:
    """Evidence that a file follows one of these packages, by its long names, else by its text."""
    i, share, covered = packages.nearest({x for x in names if len(x) > RARE})
    found = [("third-party", POINTS["known"] * share, "names of a known package")] if share else []
    if share < SIMILARITY and (covered >= 0.5 or share >= 0.4):
        mine = shingles(re.findall(r"\w+", text))
        if len(mine) >= 8 and len(mine & packages.shingles[i]) >= SIMILARITY * min(len(mine), len(packages.shingles[i])):
            found.append(("third-party", POINTS["text"], "text of a known package"))
    return found


def evidence(kind: str, text: str, model: NameModel | None = None, packages: KnownPackages | None = None) -> tuple[list[tuple[str, float, str]], float | None]:
    """((class, points, reason) of all that speaks against a file's being hand-written, cross-entropy of
    its names)."""
    text = text.removeprefix("\ufeff")
    head = _HEAD_COMMENT.match(text)
    top = head[1] if head else ""
    out: list[tuple[str, float, str]] = []

    def add(to: str, points: str, reason: str) -> None:
        out.append((to, POINTS[points], reason))

    if _marked(top):
        add("generated", "mark", "mark of a tool")
    if kind == "data":
        locked = _LOCKED.findall(text)
        if locked and ("lockfileVersion" in locked[0] or "content-hash" in text or "yarn lockfile" in text) or len(locked) >= 4 and len(locked) >= 0.12 * text.count("\n"):
            add("generated", "lock", "dependency lock")
        return out, None
    if top and _PACKAGE.search(top):
        add("third-party", "package", "package mark")
    if text.lstrip()[:3] == "/*!":
        add("minified", "banner", "banner")
    names = names_of(text) if kind in ("js", "php") else []
    if packages is not None and names:
        out += known_package(_NAME.findall(text), text, packages)
    if kind == "js":
        if _BUNDLED.search(text):
            add("minified", "bundle", "bundle")
        if _TRANSPILED.search(text):
            add("generated", "transpiled", "transpiled")
    lines = text.count("\n") + 1 - sum(not x or x.isspace() for x in text.split("\n"))
    bits = model.file_bits(names) if model and names else None
    if lines and names and len(text) / lines > 90 and sum(map(text.count, " \t")) < 0.12 * len(text):
        add("minified", "dense", "dense layout")
        if sum(len(x) <= 2 for x in names) > 0.4 * len(names):
            add("minified", "short", "short names")
    if template_like(_DECLARED.findall(text) + [x for x in _METHOD.findall(text) if x not in _BLOCKS]):
        add("generated", "templates", "template names")
    if records(text):
        add("data", "records", "delimited records")
    digits = sum(map(text.count, "0123456789"))
    if digits > 0.08 * len(text) and len(text) > 150 and data_share(text) > 0.45:
        add("data", "literals", "literals")
    return out, bits


def judge(kind: str, text: str, model: NameModel | None, packages: KnownPackages | None, middle: float = 0.0, spread: float | None = None) -> tuple[str, str] | None:
    """(class, strongest reason) of a file that is no hand-written source, else None."""
    found, bits = evidence(kind, text, model, packages)
    if bits is not None and spread:
        found.append(("minified", POINTS["names"] * min(MOST_DEVIATIONS, max(0.0, (bits - middle) / max(spread, LEAST_SPREAD))), "mangled names"))
    sums = {c: sum(p for to, p, _ in found if to == c) for c in CLASSES}
    best = max(CLASSES, key=lambda c: sums[c])
    return (best, max((p, r) for to, p, r in found if to == best)[1]) if sums[best] >= ENOUGH else None


def _names_of(chunks: DataFrame) -> DataFrame:
    return whole_files(chunks).withColumn("__ending", ending(F.col("file"))).where(F.length("code") > 0)


def train_names(chunks: DataFrame) -> dict[str, NameModel]:
    """One model per family, from the distinct names of every whole-file row. Counts are summed in
    each task first; the result is bounded by the alphabet, not by the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, Counter] = {}
        for batch in batches:
            for e, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.setdefault(FAMILY[e], Counter()).update(set(names_of(text)))
        for family, counter in names.items():
            grams = name_trigrams(counter)
            yield pa.RecordBatch.from_arrays([pa.array([family] * len(grams)), pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], names=["family", "gram", "n"])

    code = _names_of(chunks).where(F.col("__ending").isin(*(e for e, f in FAMILY.items() if f in ("js", "php"))))
    rows = code.select("__ending", "code").mapInArrow(count, "family string, gram string, n bigint").groupBy("family", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    by: dict[str, dict[str, int]] = {}
    for family, gram, n in zip(rows["family"], rows["gram"], rows["n"]):
        by.setdefault(family, {})[gram] = n
    return {f: NameModel(c) for f, c in by.items()}


def judge_files(chunks: DataFrame, library_files: DataFrame, library_block_mb: int = 64) -> DataFrame:
    """``project``, ``file``, ``class`` (generated, minified, third-party, data), ``reason`` (the strongest)
    and ``points``: one row for each whole file; class and reason are null for hand-written source.

    Null and empty code is hand-written; of copies of a file's row the one with most points counts.
    Configuration formats are judged by tools' marks and lock files only, endings outside ``FAMILY``
    not at all. The known packages are broadcast as names and shingles, in blocks of at most about
    ``library_block_mb`` of code, each looked up in one pass over the files.

    The files are read twice: once for the names' counts, once for their evidence; the spread of the
    cross-entropies is then taken over the rows of evidence, a few numbers a file.
    """
    spark = chunks.sparkSession
    models = train_names(chunks)
    known = library_files.where(F.length("code") > 0)
    size = known.agg(F.coalesce(F.sum(F.length("code")), F.lit(0))).first()[0]
    blocks = 1 + size // (library_block_mb << 20)
    files = whole_files(chunks).withColumn("__ending", ending(F.col("file"))).select("project", "file", "__ending", "code")
    schema = "project string, file string, family string, bits double, " + ", ".join(f"`{c}` double, `why {c}` string" for c in CLASSES)

    def read(block: int) -> DataFrame:
        part = known.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == block) if blocks > 1 else known
        shared = spark.sparkContext.broadcast((models, KnownPackages([r[0] for r in part.select("code").toLocalIterator()])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, packages = shared.value
            for batch in batches:
                rows = []
                for e, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    kind = FAMILY.get(e, "other")
                    found, bits = [], None
                    if text and kind != "other":
                        code = kind in ("js", "php")
                        if not block:
                            found, bits = evidence(kind, text, models.get(kind), packages if code else None)
                        elif code:
                            found = known_package(_NAME.findall(text), text, packages)
                    row = [kind, bits]
                    for c in CLASSES:
                        mine = [(p, r) for to, p, r in found if to == c]
                        row += [sum(p for p, _ in mine), max(mine)[1] if mine else None]
                    rows.append(row)
                columns = zip(*rows) if rows else [()] * (2 + 2 * len(CLASSES))
                types = [pa.string(), pa.float64(), *[pa.float64(), pa.string()] * len(CLASSES)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

        return files.mapInArrow(run, schema)

    names = ["project", "file", "family", "bits", *(x for c in CLASSES for x in (c, f"why {c}"))]
    rows = read(0)
    for block in range(1, blocks):
        rows = rows.unionByName(read(block))
    rows = materialise(rows)
    at = F.percentile_approx("bits", F.array(F.lit(0.5), F.lit(0.84)), 10_000)
    usual = rows.where("bits IS NOT NULL").groupBy("family").agg(at.alias("q")).select("family", F.col("q")[0].alias("middle"), F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD)).alias("spread"))
    names_points = POINTS["names"] * F.least(F.lit(MOST_DEVIATIONS), F.greatest(F.lit(0.0), (F.col("bits") - F.col("middle")) / F.col("spread")))
    judged = rows.join(F.broadcast(usual), "family", "left").withColumn("by names", F.coalesce(names_points, F.lit(0.0)))
    judged = judged.withColumn("why minified", F.when(F.col("by names") > 1.5, "mangled names").otherwise(F.col("why minified"))).withColumn("minified", F.col("minified") + F.col("by names"))
    best = F.greatest(*(F.struct(F.col(f"`{c}`").alias("points"), F.lit(-i).alias("place"), F.lit(c).alias("class"), F.col(f"`why {c}`").alias("reason")) for i, c in enumerate(CLASSES)))
    top = judged.groupBy("project", "file").agg(F.max(best).alias("x"))
    enough = F.col("x.points") >= ENOUGH
    return top.select("project", "file", F.when(enough, F.col("x.class")).alias("class"), F.when(enough, F.col("x.reason")).alias("reason"), F.col("x.points").alias("points"))
