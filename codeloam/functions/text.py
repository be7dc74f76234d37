"""Scalar functions as Column expressions; none needs Python on the executors.

Null handling: a null text gives null, except where a docstring says otherwise. Lengths count code
points unless said otherwise. ``\\s`` below is Unicode white space where the text is trimmed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloam.functions import constants as K


def text(c: Column | str) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def items(c: Column | str) -> Column:
    """The array, or an empty one for null."""
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.array().cast("array<string>"))


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unique(c: Column) -> Column:
    """Without repeats and empty strings; the first place of each stays."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


# ---- identity


def sha256_prefix(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def chunk_id(file: Column, symbol: Column) -> Column:
    """First 32 hex digits of sha256(file::symbol); a null symbol stands for the whole file."""
    return sha256_prefix(F.concat(file, F.lit("::"), F.coalesce(symbol, F.lit("<file>"))), 32)


def uuid_form(hex32: Column) -> Column:
    return F.regexp_replace(hex32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def document_id(path: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit("doc:"), sha256_prefix(F.concat_ws("\n", path, title, body), 16))


def memory_point_id(entry_id: Column) -> Column:
    return uuid_form(sha256_prefix(entry_id, 32))


def collection_name(scope: str, root: Column, branch: Column) -> Column:
    """``scope-`` and 8 hex digits of sha256 of the root, with the branch on a second line if any."""
    return F.concat(F.lit(f"{scope}-"), sha256_prefix(F.concat_ws("\n", root, branch), 8))


def branch_slug(branch: Column) -> Column:
    s = F.regexp_replace(branch, r'[/\\:*?"<>|]', "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.when(s == "", "default").otherwise(s)


# ---- tokens and topics


def split_tokens(c: Column, stop_words: list[str]) -> Column:
    """Lower-case tokens of 3 to 24 signs that are no stop words; camel case is cut."""
    parts = F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(parts, lambda t: F.length(t).between(3, 24) & ~t.isin(*stop_words))


def question_tokens(question: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\s\\/.\-_:]+", question.lower()) if len(t) >= 3 and t not in K.QUESTION_STOP_WORDS]


# ---- classifiers


def change_type(title: Column, body: Column, files: Column) -> Column:
    """First of the fixed patterns that occurs in title, body and files; ``chore`` if none does."""
    all_text = F.lower(F.concat_ws("\n", text(title), text(body), F.array_join(items(files), "\n")))
    return reduce(lambda rest, kind: F.when(all_text.rlike(kind[1]), kind[0]).otherwise(rest), reversed(K.CHANGE_TYPES), F.lit("chore"))


def document_type(path: Column, title: Column, body: Column) -> Column:
    all_text = F.lower(F.concat_ws("\n", text(path), text(title), text(body)))
    low = F.lower(text(path))
    result = F.lit("note")
    for kind, on_path, on_text in reversed(K.DOCUMENT_TYPES):
        hit = all_text.rlike(on_text) if on_path is None else low.rlike(on_path) | all_text.rlike(on_text)
        result = F.when(hit, kind).otherwise(result)
    return result


def is_feature_document(kind: Column, title: Column, doc_type: Column) -> Column:
    t = F.lower(text(title))
    wanted = doc_type.isin("feature", "architecture") | ((doc_type == "overview") & t.rlike(K.FEATURE_ALLOW))
    return F.coalesce((kind == "document") & ~t.rlike(K.FEATURE_DENY) & wanted, F.lit(False))


# ---- markdown


def strip_markdown(c: Column) -> Column:
    """Without fences, code marks, images, link targets and tags, in this order."""
    for pattern, put in ((r"(?s)```.*?```", "\n"), (r"`([^`]+)`", "$1"), (r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"<[^>]+>", " ")):
        c = F.regexp_replace(c, pattern, put)
    return c


#: White space of any kind but the line feed.
_IN_LINE = r"[\s&&[^\n]]"


def normalise_lines(c: Column) -> Column:
    """A text whose lines are without the marks of headings, lists and quotes, with single blanks. Each
    pattern runs once over the whole text, not once a line."""
    ends = lambda x: F.regexp_replace(x, rf"(?U)(?md)^{_IN_LINE}+|{_IN_LINE}+$", "")
    c = ends(c)
    for pattern, put in ((rf"^#{{1,6}}{_IN_LINE}+", ""), (rf"^[-*+]{_IN_LINE}+", ""), (rf"^\d+\.{_IN_LINE}+", ""), (rf"^>{_IN_LINE}?", ""), (r"\|", " "), (rf"(?U){_IN_LINE}+", " ")):
        c = F.regexp_replace(c, f"(?md){pattern}", put)
    return ends(c)


def meaningful_lines(c: Column) -> Column:
    """Normalised lines of at least 12 signs that are no rules; none for null."""
    return F.filter(F.split(normalise_lines(strip_markdown(text(c))), "\n"), lambda x: (F.length(x) >= 12) & ~x.rlike("^[-=_]{3,}$"))


def inline_symbols(c: Column) -> Column:
    """Marked code words of a text: of the first 12 that look like names, each once."""
    found = F.transform(F.regexp_extract_all(text(c), F.lit(r"`([^`\n]{2,80})`"), 1), trim)
    return F.array_distinct(F.slice(F.filter(found, lambda t: t.rlike(r"^[A-Za-z0-9_./:-]+$")), 1, 12))


def section_summary(doc_type: Column, title: Column, body: Column) -> Column:
    head = F.concat(doc_type, F.lit(" note: "), title)
    of = lambda lines: F.when(F.size(lines) == 0, head).otherwise(F.substring(F.concat(head, F.lit(". "), F.array_join(lines, " ")), 1, 320))
    # bound as a lambda's variable, so that the lines are made once
    return F.element_at(F.transform(F.array(F.slice(meaningful_lines(body), 1, 2)), of), 1)


# ---- changes


def all_hints(impacts: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(impacts, lambda i: items(i["hints"]))), F.array().cast("array<string>"))


def change_impact(symbols: Column, impacts: Column, files: Column) -> Column:
    hints = unique(all_hints(impacts))
    return (
        F.when(F.size(items(symbols)) > 0, F.concat(F.lit("touches "), F.array_join(F.slice(items(symbols), 1, 4), ", ")))
        .when(F.size(hints) > 0, F.concat(F.lit("focuses on "), F.array_join(F.slice(hints, 1, 2), " | ")))
        .when(F.size(items(files)) > 0, F.concat(F.lit("affects "), F.array_join(F.slice(items(files), 1, 3), ", ")))
        .otherwise("records a repository change")
    )


def change_summary(kind: Column, title: Column, topics: Column, symbols: Column, impacts: Column, files: Column) -> Column:
    tail = F.when(F.size(items(topics)) > 0, F.concat(F.lit(" Topics: "), F.array_join(F.slice(items(topics), 1, 4), ", "), F.lit("."))).otherwise("")
    return F.concat(kind, F.lit(" change: "), change_impact(symbols, impacts, files), F.lit(". "), text(title), F.lit("."), tail)


def render_impact(symbols: Column, impacts: Column, files: Column) -> Column:
    hints = unique(all_hints(impacts))
    return (
        F.when(F.size(items(symbols)) > 0, F.array_join(F.slice(items(symbols), 1, 5), ", "))
        .when(F.size(hints) > 0, F.array_join(F.slice(hints, 1, 3), " | "))
        .otherwise(F.array_join(F.slice(items(files), 1, 3), ", "))
    )


def _part(key: str, value: Column, keep: Column) -> Column:
    return F.when(keep, F.concat(F.lit(f"{key}: "), value))


def _list_part(key: str, values: Column, glue: str = ", ") -> Column:
    return _part(key, F.array_join(values, glue), F.size(values) > 0)


def chunk_embedding_text(file: Column, symbol: Column, code: Column) -> Column:
    return F.concat(F.lit("file: "), text(file), F.lit("\n"), text(symbol), F.lit("\n\n"), text(code))


def change_embedding_text() -> Column:
    """Over the columns of a change entry; empty parts are left out."""
    some = F.lit(True)
    body = text("body")
    return F.concat_ws(
        "\n", _part("kind", F.col("kind"), some), _part("change_type", F.col("change_type"), some), _part("title", text("title"), some), _part("details", body, body != ""), _part("summary", text("summary"), some),
        _list_part("topics", items("topics")), _list_part("symbols", items("symbols")), _list_part("semantic_hints", F.slice(all_hints(F.col("impacts")), 1, 8), " | "), _list_part("files", items("files")),
        _part("author", text("author_name"), some), _part("date", text("timestamp"), some), _part("sha", text("sha"), some),
    )


def document_embedding_text() -> Column:
    some = F.lit(True)
    return F.concat_ws(
        "\n", _part("kind", F.col("kind"), some), _part("doc_type", text("doc_type"), some), _part("title", text("title"), some), _part("section", text("section"), some), _part("path", text("path"), some),
        _part("summary", text("summary"), some), _list_part("topics", items("topics")), _list_part("symbols", items("symbols")), _part("body", text("body"), some), _part("date", text("timestamp"), some),
    )


# ---- diffs


def diff_path(c: Column) -> Column:
    """Without quotes and the ``a/`` or ``b/`` before a path."""
    return F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), "^[ab]/", "")


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$"


def hunk(line: Column) -> Column:
    """The numbers of a hunk's header line and the text after it; a missing count is 1."""
    count = lambda g: F.coalesce(F.nullif(F.regexp_extract(line, HUNK, g), F.lit("")).cast("int"), F.lit(1))
    number = lambda g: F.regexp_extract(line, HUNK, g).cast("int")
    return F.struct(number(1).alias("old_start"), count(2).alias("old_count"), number(3).alias("new_start"), count(4).alias("new_count"), F.trim(F.regexp_extract(line, HUNK, 5)).alias("header"))


def hunk_ranges(hunks: Column, side: str) -> Column:
    """Closed line ranges of one side (``old`` or ``new``); those that start before line 1 are none."""
    ranges = F.transform(hunks, lambda h: F.struct(h[f"{side}_start"].alias("start"), (h[f"{side}_start"] + F.greatest(h[f"{side}_count"], F.lit(1)) - 1).alias("end")))
    return F.filter(ranges, lambda r: r["start"] > 0)


def hunk_hints(hunks: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(hunks, lambda h: trim(h["header"])), lambda x: F.length(x) >= 3))


def prefers_old_revision(status: Column, hunks: Column) -> Column:
    gone = (F.size(hunks) > 0) & F.forall(hunks, lambda h: (h["new_count"] == 0) & (h["old_count"] > 0))
    return F.coalesce((status == "D") | gone, F.lit(False))


def line_slice(source: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(source, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


# ---- labels


def score_label(score: Column) -> Column:
    return F.when(score > 0, F.format_string("score: %.3f", score)).otherwise("related")


def entry_label(kind: Column, sha: Column, path: Column) -> Column:
    return F.when(kind == "change", F.substring(sha, 1, 8)).otherwise(path)


def entry_type(kind: Column, change_type: Column, doc_type: Column) -> Column:
    return F.when(kind == "change", change_type).otherwise(F.concat(doc_type, F.lit(" doc")))


def entry_source(kind: Column, sha: Column, path: Column, section: Column) -> Column:
    """The commit; of a document its path, with the section unless that is the file's own name."""
    named = (text(section) != "") & (section != F.regexp_extract(path, r"([^/\\\\]*)$", 1))
    return F.when(kind == "change", sha).when(F.coalesce(named, F.lit(False)), F.concat(path, F.lit(" > "), section)).otherwise(path)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: a sign beyond the basic plane counts twice; 0 for null."""
    return F.coalesce((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"), F.lit(0))
