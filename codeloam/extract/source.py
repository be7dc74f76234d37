"""Symbols, line ranges, imports and calls of TypeScript, JavaScript and PHP sources.

No parser library is used: literals and comments are blanked out at equal length, then declarations
are found and their braces matched. Unsupported: declarations inside template expressions, decorators
with braces before a declaration's first line, and PHP alternative syntax inside methods' heads.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.functions.constants import PLAIN_BYTES
from codeloam.functions.text import chunk_id


class Symbol(NamedTuple):
    name: str
    kind: str  # function, class, method, or closure (a named arrow or function expression)
    start: int
    end: int
    owner: str = ""  # enclosing class


_KEYWORDS = frozenset("if for while switch catch return typeof void delete await yield throw case in of instanceof do else function with new".split())
_PHP_KEYWORDS = frozenset("if elseif while for foreach switch match catch function fn array isset empty list exit die echo print return and or xor use unset declare new static include include_once require require_once".split())
_BLANK = re.compile(r"[^\n]")
_JS_PARTS = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:[^'\\\n]|\\[\s\S])*'?|\"(?:[^\"\\\n]|\\[\s\S])*\"?|`|[{}]|/")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_PHP_PARTS = re.compile(r"\?>[\s\S]*?(?:<\?(?:php\b|=)|\Z)|//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|'(?:[^'\\]|\\[\s\S])*'?|\"(?:[^\"\\]|\\[\s\S])*\"?|`[^`]*`?|<<<[ \t]*['\"]?(\w+)['\"]?\r?\n[\s\S]*?\n[ \t]*\1\b")


def _spaces(s: str) -> str:
    return _BLANK.sub(" ", s)


def mask_js(text: str) -> str:
    """The text with literals and comments as blanks; code inside ``${}`` stays."""
    out, at, pos = [], 0, 0
    depth: list[int] = []  # open braces since each template expression began
    while m := _JS_PARTS.search(text, pos):
        tok, start = m.group(), m.start()
        if tok == "{" and depth:
            depth[-1] += 1
        elif tok == "}" and depth:
            if depth[-1]:
                depth[-1] -= 1
            else:
                depth.pop()
                tok = "`"  # the template's text goes on
        if tok == "/":
            before = text[:start].rstrip()[-1:] if start < 200 else text[start - 200 : start].rstrip()[-1:]
            r = _JS_REGEX.match(text, start) if before in "" or before in "(,=:[!&|?{};+-*%<>~^" or re.search(r"\b(?:return|typeof|case|in|of)\s*\Z", text[max(0, start - 12) : start]) else None
            if r:
                out += (text[at:start], _spaces(r.group()))
                at = pos = r.end()
            else:
                pos = m.end()
            continue
        if tok == "`":
            t = _TEMPLATE_TEXT.match(text, start + 1)
            end = t.end()
            if text.startswith("${", end):
                depth.append(0)
                end += 2
            else:
                end = min(len(text), end + 1)
            out += (text[at:start], _spaces(text[start:end]))
            at = pos = end
            continue
        if tok in ("{", "}"):
            pos = m.end()
            continue
        out += (text[at:start], _spaces(tok))
        at = pos = m.end()
    out.append(text[at:])
    return "".join(out)


def mask_php(text: str) -> str:
    first = re.search(r"<\?(?:php\b|=)", text)
    if not first:
        return _spaces(text)
    return _spaces(text[: first.end()]) + _PHP_PARTS.sub(lambda m: _spaces(m.group()), text[first.end() :])


def _close(masked: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for m in re.compile(r"[(){}\[\]]").finditer(masked, at):
        depth += 1 if m.group() in "([{" else -1
        if not depth:
            return m.end()
    return len(masked)


def _depths(masked: str) -> tuple[list[int], list[int]]:
    """Places of the brackets, and the depth after each."""
    places, depths, d = [], [], 0
    for m in re.finditer(r"[(){}\[\]]", masked):
        d += 1 if m.group() in "([{" else -1
        places.append(m.start())
        depths.append(d)
    return places, depths


_TS_FUNCTION = re.compile(r"(?:\bexport\s+(?:default\s+)?)?(?:\bdeclare\s+)?(?:\basync\s+)?\bfunction\b\s*\*?\s*([\w$]*)\s*(?:<[^(]*>)?\s*(?=\()")
_TS_CLASS = re.compile(r"(?:\bexport\s+(?:default\s+)?)?(?:\bdeclare\s+)?(?:\babstract\s+)?\bclass\b\s*((?!extends\b|implements\b)[\w$]+)?[^{;]*?(?=\{)")
_TS_MEMBER = re.compile(r"(?:(?:public|private|protected|static|async|override|abstract|readonly|declare|get|set)\s+)*(?:\*\s*)?([#\w$]+)\s*\??\s*(?:<[^(){};]*>)?\s*(?=\()")
_TS_PROPERTY = re.compile(r"(?:(?:public|private|protected|static|override|readonly|declare)\s+)*([#\w$]+)\s*[?!]?\s*(?::[^=;{}]+)?=\s*(?=(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>|<))")
_TS_NAMED = re.compile(r"(?:\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]+?)?=|(?<![\w$.])([\w$]+)\s*:)\s*(?=(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>|<[\w\s,]+>\())")
_TS_ARROW = re.compile(r"(?:async\s*)?(?:<[^()]*>\s*)?(?:\(|[\w$]+\s*=>)")
_IMPORT = re.compile(r"^[ \t]*import\b(?:[^'\";()]*?\bfrom\b)?\s*(['\"])([^'\"\n]+)\1", re.M)


def _body_end(masked: str, paren: int) -> int:
    """After a function's head at its parenthesis: the end of its body, or of its declaration."""
    after = _close(masked, paren)
    m = re.compile(r"\s*(?::\s*)?").match(masked, after)
    at = m.end()
    if ":" in m.group():  # a return type: braces in it belong to the type
        while at < len(masked):
            if masked[at] in "([":
                at = _close(masked, at)
            elif masked[at] == "{":
                end = _close(masked, at)
                if re.compile(r"\s*(?:[|&{]|\[\])").match(masked, end):
                    at = end
                    continue
                return end
            elif masked[at] in ";\n" and masked[at] == ";":
                return at + 1
            else:
                at += 1
        return at
    if at < len(masked) and masked[at] == "{":
        return _close(masked, at)
    semi = masked.find(";", after)
    return semi + 1 if semi >= 0 else after


def _arrow_end(masked: str, at: int) -> int | None:
    """The end of the arrow or function expression at ``at``; None if it is none."""
    f = re.compile(r"(?:async\s*)?function\b\s*\*?\s*[\w$]*\s*(?:<[^(]*>)?\s*\(").match(masked, at)
    if f:
        return _body_end(masked, f.end() - 1)
    m = _TS_ARROW.match(masked, at)
    if not m:
        return None
    if masked[m.end() - 1] == "(":
        end = _close(masked, m.end() - 1)
        arrow = re.compile(r"\s*(?::[^={}]*(?:\{[^{}]*\})?[^={}]*)?\s*=>").match(masked, end)
        if not arrow:
            return None
        end = arrow.end()
    else:
        end = m.end()
    body = re.compile(r"\s*").match(masked, end).end()
    if masked[body : body + 1] == "{":
        return _close(masked, body)
    depth = 0
    for t in re.compile(r"[(){}\[\],;]").finditer(masked, body):
        c = t.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if not depth:
                return t.start()
            depth -= 1
        elif not depth:
            return t.start()
    return len(masked.rstrip())


def ts_symbols(text: str, masked: str | None = None) -> list[Symbol]:
    """Top-level functions, classes and their methods, then named closures, in this order."""
    masked = mask_js(text) if masked is None else masked
    places, depths = _depths(masked)
    depth = lambda at: depths[i - 1] if (i := bisect_right(places, at - 1)) else 0
    out: list[Symbol] = []
    for m in _TS_FUNCTION.finditer(masked):
        if depth(m.start()) == 0 and not re.search(r"[=(,:?&|!]\s*\Z|\b(?:return|await|new|typeof)\s*\Z", masked[max(0, m.start() - 40) : m.start()]):
            out.append(Symbol(m[1] or "<anonymous>", "function", m.start(), _body_end(masked, m.end())))
    classes, methods, closures = [], [], []
    for m in _TS_CLASS.finditer(masked):
        d = depth(m.start())
        if d and not re.search(r"[;{}]\s*\Z", masked[max(0, m.start() - 40) : m.start()]):
            continue
        end = _close(masked, m.end())
        name = m[1] or "<anonymous>"
        if d == 0:
            classes.append(Symbol(name, "class", m.start(), end, name))
        inner, at = d + 1, m.end() + 1
        while at < end - 1:
            if masked[at].isspace() or masked[at] in ";,}":
                at += 1
                continue
            if masked[at] == "@":  # a decorator
                deco = re.compile(r"@[\w$.]+\s*").match(masked, at)
                at = deco.end() if deco else at + 1
                at = _close(masked, at) if masked[at : at + 1] == "(" else at
                continue
            member = _TS_MEMBER.match(masked, at)
            if member and depth(at) == inner:
                stop = _body_end(masked, member.end())
                words = member.group().split()
                if member[1] != "constructor" and not {"get", "set"} & set(words[:-1]) and d == 0:
                    methods.append(Symbol(f"{m[1] or '<class>'}.{member[1]}", "method", at, stop, name))
                at = max(stop, at + 1)
                continue
            prop = _TS_PROPERTY.match(masked, at)
            if prop and (stop := _arrow_end(masked, prop.end())):
                closures.append(Symbol(f"{m[1] or '<class>'}.{prop[1]}", "closure", at, stop, name))
                at = stop
                continue
            # any other member: to its semicolon, line end or block
            while at < end - 1:
                c = masked[at]
                if c in "([{":
                    at = _close(masked, at)
                    continue
                at += 1
                if c == ";" or c == "\n":
                    break
    for m in _TS_NAMED.finditer(masked):
        stop = _arrow_end(masked, m.end())
        if stop and (m[1] or (m[2] not in _KEYWORDS and m[2] not in ("default", "public", "private"))):
            closures.append(Symbol(m[1] or m[2], "closure", m.start(), stop))
    for group in (classes, methods, closures):
        out += group
    return out


_TS_CALL = re.compile(r"(\bthis\s*\??\.\s*|(?<![\w$])super\s*\.\s*|\??\.\s*)?(?<![\w$])([A-Za-z_$][\w$]*)\s*(?:\?\.\s*)?(?:<[\w\s,\[\]|.]*>)?\(")


def ts_calls(text: str) -> list[tuple[str, str]]:
    """(caller, callee) pairs in order, each once: callers are functions, closures, then methods; a
    nested call belongs to every named function around it."""
    masked = mask_js(text)
    symbols = ts_symbols(text, masked)
    declared = {m.start(1) for m in _TS_FUNCTION.finditer(masked) if m[1]}
    for s in symbols:
        if s.kind == "method":
            m = _TS_MEMBER.match(masked, s.start)
            declared.add(m.start(1))
    calls: list[tuple[int, str, bool]] = []
    for m in _TS_CALL.finditer(masked):
        name = m[2]
        if m.start(2) in declared:
            continue
        if name == "async" and not m[1] and re.compile(r"\s*(?::[^={}]*)?=>").match(masked, _close(masked, m.end() - 1)):
            continue  # the head of an arrow function
        if m[1]:
            calls.append((m.start(2), name, m[1].lstrip().startswith("this")))
        elif name not in _KEYWORDS and name != "constructor" and not re.search(r"\bnew\s+\Z", masked[max(0, m.start() - 16) : m.start()]):
            if re.compile(r"[^()]*\)\s*(?::[^;{}=]+)?\{").match(masked, m.end()) and re.search(r"(?:^|[;{},]|\b(?:async|static|get|set|public|private|protected|\*))\s*\Z", masked[max(0, m.start() - 24) : m.start()]):
                continue  # the head of a method
            calls.append((m.start(2), name, False))
    order = {"function": 0, "closure": 1, "method": 2}
    out: dict[tuple[str, str], None] = {}
    class_at = [s for s in symbols if s.kind == "class"]
    for s in sorted((x for x in symbols if x.kind in order and x.name != "<anonymous>"), key=lambda x: (order[x.kind], x.start)):
        for at, name, own in calls:
            if s.start <= at < s.end:
                owner = next((c.name for c in class_at if c.start <= at < c.end), "") if own else ""
                out[s.name, f"{owner}.{name}" if owner else name] = None
    return list(out)


def ts_imports(text: str) -> list[str]:
    return [m[2] for m in _IMPORT.finditer(text)]


_PHP_NAMESPACE = re.compile(r"\bnamespace\s+([\w\\]+)\s*([;{])|\bnamespace\s*(\{)")
_PHP_FUNCTION = re.compile(r"\bfunction\s+&?\s*(\w+)\s*(?=\()")
_PHP_CLASS = re.compile(r"(?:\b(?:abstract|final|readonly)\s+)*\b(class|interface|trait)\s+(\w+)[^{;]*?(?=\{)")
_PHP_METHOD = re.compile(r"(?:\b(?:public|protected|private|static|abstract|final|readonly|var)\s+)*\bfunction\s+&?\s*(\w+)\s*(?=\()")
_PHP_USE = re.compile(r"^[ \t]*use\s+(?!\()([^;{]+?)(?:\{([^}]*)\})?\s*;", re.M)


def php_symbols(text: str, masked: str | None = None) -> list[Symbol]:
    """Functions, classes, interfaces, traits and methods, with the namespace before their names;
    symbols outside any namespace come first."""
    masked = mask_php(text) if masked is None else masked
    places, depths = _depths(masked)
    depth = lambda at: depths[i - 1] if (i := bisect_right(places, at - 1)) else 0
    spaces: list[tuple[int, int, str, int]] = []
    for m in _PHP_NAMESPACE.finditer(masked):
        braced = m[2] == "{" or m[3]
        if spaces and not braced:
            spaces[-1] = (*spaces[-1][:1], m.start(), *spaces[-1][2:])
        spaces.append((m.start(), _close(masked, m.end() - 1) if braced else len(masked), f"{m[1]}\\" if m[1] else "", 1 if braced else 0))

    def place(at: int) -> tuple[str, int]:
        return next(((p, d) for a, b, p, d in reversed(spaces) if a <= at < b), ("", 0))

    out: list[Symbol] = []
    taken: list[tuple[int, int]] = []
    for m in _PHP_CLASS.finditer(masked):
        prefix, base = place(m.start())
        if depth(m.start()) != base or re.search(r"(?:::|->|\bnew)\s*\Z", masked[max(0, m.start() - 8) : m.start()]):
            continue
        end = _close(masked, m.end())
        taken.append((m.start(), end))
        name = prefix + m[2]
        out.append(Symbol(name, "class", m.start(), end, name))
        for f in _PHP_METHOD.finditer(masked, m.end(), end):
            if depth(f.start()) == base + 1:
                out.append(Symbol(f"{name}::{f[1]}", "method", f.start(), _php_end(masked, f.end()), name))
    for m in _PHP_FUNCTION.finditer(masked):
        prefix, base = place(m.start())
        if depth(m.start()) == base and not any(a <= m.start() < b for a, b in taken):
            out.append(Symbol(prefix + m[1], "function", m.start(), _php_end(masked, m.end())))
    return sorted(out, key=lambda s: (bool(place(s.start)[0]), s.start))


def _php_end(masked: str, paren: int) -> int:
    after = _close(masked, paren)
    m = re.compile(r"[^{;]*").match(masked, after)
    return _close(masked, m.end()) if masked[m.end() : m.end() + 1] == "{" else min(len(masked), m.end() + 1)


_PHP_CALL = re.compile(r"(\bnew\s+[\w\\]+|(?:\$[\w]+|\)|\]|\w)\s*\??->\s*\w+|[\w\\]+\s*::\s*\w+|\\?[A-Za-z_][\w\\]*)\s*\(")


def php_calls(text: str) -> list[tuple[str, str]]:
    """(caller, callee) pairs in order, each once. A bare callee that is a method of the caller's
    class is qualified with it."""
    masked = mask_php(text)
    symbols = php_symbols(text, masked)
    methods: dict[str, set[str]] = {}
    for s in symbols:
        if s.kind == "method":
            methods.setdefault(s.owner, set()).add(s.name.rsplit("::", 1)[1])
    out: dict[tuple[str, str], None] = {}
    for s in symbols:
        if s.kind == "class":
            continue
        body = masked.find("{", s.start, s.end)
        for m in _PHP_CALL.finditer(masked, body if body >= 0 else s.start, s.end):
            c = re.sub(r"\s+", "", m[1]) if not m[1].startswith("new ") else ""
            if not c or c in _PHP_KEYWORDS or re.search(r"\b(?:function|new)\s+&?\s*\Z", masked[max(0, m.start() - 12) : m.start()]):
                continue
            if "->" in c:
                c = c.rsplit("->", 1)[1]
            elif "::" in c:
                left, right = c.rsplit("::", 1)
                c = right if left in ("self", "static", "parent") else c
            if "::" not in c and c in methods.get(s.owner, ()):
                c = f"{s.owner}::{c}"
            out[s.name, c] = None
    return list(out)


def php_imports(text: str) -> list[str]:
    out: list[str] = []
    for m in _PHP_USE.finditer(mask_php(text)):
        names = m[2].split(",") if m[2] else m[1].split(",")
        head = m[1].strip() if m[2] else ""
        out += [head + re.split(r"\s+as\s+", n.strip())[0] for n in names if n.strip()]
    return [re.sub(r"^(?:function|const)\s+", "", x) for x in out]


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def chunks_of(file: str, text: str) -> list[tuple[str, str, str, list[str], int, int]]:
    """(symbol, type, code, imports, first line, last line) of each chunk of a source file. PHP code is
    cut by whole lines; PHP without ``<?php`` is one file chunk of at most 32,000 signs."""
    ending = file.rsplit(".", 1)[-1].lower()
    starts = _line_starts(text)
    line = lambda at: bisect_right(starts, at)
    if ending == "php":
        if "<?" not in text:
            return unread_chunk(file, text)
        found, imports = php_symbols(text), php_imports(text)
    else:
        found, imports = [s for s in ts_symbols(text) if s.kind != "closure"], ts_imports(text)
    out = []
    for s in found:
        a, b = line(s.start), line(max(s.start, s.end - 1))
        code = text[starts[a - 1] : starts[b] - 1 if b < len(starts) else len(text)] if ending == "php" else text[s.start : s.end]
        out.append((s.name, s.kind, code, imports, a, b))
    return out


def unread_chunk(file: str, text: str) -> list[tuple[str, str, str, list[str], int, int]]:
    """A PHP file that is not read as such: one file chunk of at most 32,000 signs; none for others."""
    return [(file, "file", text[:PLAIN_BYTES], [], 1, text.count("\n") + 1)] if file.lower().endswith(".php") else []


def ranges_of(file: str, text: str) -> list[tuple[str, str, int, int]]:
    """(symbol, kind, first line, last line), closed; a symbol of the same name and first line once."""
    php = file.lower().endswith(".php")
    starts = _line_starts(text)
    seen: dict[tuple[str, int], tuple[str, str, int, int]] = {}
    for s in php_symbols(text) if php else ts_symbols(text):
        if s.name == "<anonymous>":
            continue
        a, b = bisect_right(starts, s.start), bisect_right(starts, max(s.start, s.end - 1))
        kind = s.kind if s.kind != "closure" else "method" if "." in s.name else "function"
        seen.setdefault((s.name, a), (s.name, kind, a, b))
    return list(seen.values())


def _flat(files: DataFrame, keys: list[str], schema: str, types: list[pa.DataType], make, otherwise=None) -> DataFrame:
    """Rows of ``make(file, text)`` for each row of ``files(keys, file, text)``; a text on which that
    fails gives those of ``otherwise``, else none."""
    n = len(keys)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (file, text) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                if not file or not text:
                    continue
                text = text.removeprefix("\ufeff")
                try:
                    rows = make(file, text)
                except Exception:  # a source that cannot be read is no reason to lose the others
                    rows = otherwise(file, text) if otherwise else []
                at += [i] * len(rows)
                out += rows
            rows_of = pa.array(at, pa.int64())
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows_of) for k in range(n + 1)), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*keys, "file", *names])

    own = ", ".join(f"`{a}` {b}" for a, b in files.select(*keys).dtypes)
    return files.select(*keys, "file", "text").mapInArrow(run, ", ".join(x for x in (own, "file string", schema) if x))


def extract_chunks(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Symbol chunks of source files: ``keys``, ``file``, ``symbol``, ``type``, ``code``, ``imports``,
    ``start_line``, ``end_line`` and the chunk ``id``."""
    rows = _flat(files, keys or [], "symbol string, type string, code string, imports array<string>, start_line int, end_line int", [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()], chunks_of, unread_chunk)
    return rows.withColumn("id", chunk_id(F.col("file"), F.col("symbol")))


def symbol_ranges(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _flat(files, keys or [], "symbol string, kind string, start_line int, end_line int", [pa.string(), pa.string(), pa.int32(), pa.int32()], ranges_of)


def _edges(file: str, text: str) -> list[tuple[str, str, int]]:
    return [(a, b, i) for i, (a, b) in enumerate(php_calls(text) if file.lower().endswith(".php") else ts_calls(text))]


def call_edges(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``src``, ``dst``, ``edge_ord`` of each file's calls."""
    return _flat(files, keys or [], "src string, dst string, edge_ord int", [pa.string(), pa.string(), pa.int32()], _edges)


def _definitions(file: str, text: str) -> list[tuple[str, int]]:
    if file.lower().endswith(".php"):
        return [(s.name, i) for i, s in enumerate(php_symbols(text))]
    order = {"function": 0, "closure": 1, "method": 2}
    found = sorted((s for s in ts_symbols(text) if s.kind in order and s.name != "<anonymous>"), key=lambda s: (order[s.kind], s.start))
    return [(s.name, i) for i, s in enumerate(found)]


def symbol_definitions(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``symbol`` and ``def_ord`` of everything a file defines that calls can name: functions, closures and
    methods, of PHP files classes, interfaces and traits too."""
    return _flat(files, keys or [], "symbol string, def_ord int", [pa.string(), pa.int32()], _definitions)
