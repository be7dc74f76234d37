"""Tokens of source and configuration texts: names, literals, comments and operators with their places.

One pass for each text. A literal or comment that never ends is read as single characters, so a text
cut from the middle of a file still gives the tokens that follow.
"""

from __future__ import annotations

import re
from bisect import bisect_right

NAME, NUMBER, STRING, PIECE, COMMENT, OPERATOR, TEXT = range(7)

#: Family of each file ending; texts of other endings are read as plain lines.
FAMILIES = {
    **dict.fromkeys("ts tsx js jsx mjs cjs json vue java go cs kt swift rs c cpp css scss".split(), "c"),
    "php": "php",
    **dict.fromkeys("yaml yml toml ini conf npmrc sh bash env envrc dockerfile properties cfg editorconfig py rb pl makefile".split(), "hash"),
    **dict.fromkeys("xml html htm svg".split(), "xml"),
}


def _pattern(comment: str, string: str, special: str, operator: str, name: str = r"[A-Za-z_$\u0080-￿][\w$]*") -> re.Pattern:
    """Groups: 1 comment, 2 string, 3 name, 4 number, 5 special (two groups for heredocs), operator, other."""
    return re.compile(rf"\s*(?:({comment})|({string})|({name})|(\d[\w.]*)|{special}|({operator}[^\s\w])|(\S))")


_NEVER = r"(?!)"
_MARKS = r"//+|/\*+|#+(?!\[)"
_QUOTED = r"'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|`[^`\n]*`|(?<!\w)'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
_C = (r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"", "(`)", r"=>|[=!]==?|\?\?=?|\|\|=?|&&=?|\?\.|::|->|:=|")
_PHP = (r"'(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\"", r"(<<<[ \t]*[\"']?(\w+)[\"']?\r?\n)", r"=>|[=!]==?|\?\?=?|\|\|=?|&&=?|\?->|::|->|\?>|")
_PLAIN = (_QUOTED, f"({_NEVER})", r"=>|[=!]==?|\|\||&&|:=|")
_XML = (r"\"[^\"<]*\"|'[^'<]*'", f"({_NEVER})", "", r"[A-Za-z_$\u0080-￿][\w$.-]*")
_WHOLE = {
    "c": _pattern(r"//[^\n]*|/\*[\s\S]*?\*/", *_C),
    "php": _pattern(r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/", *_PHP),
    "hash": _pattern(r"(?:(?<=\s)|(?<![\s\S]))(?:#|;(?!;))[^\n]*", *_PLAIN),
    "plain": _pattern(_NEVER, *_PLAIN),
    "xml": _pattern(r"<!--[\s\S]*?-->", *_XML),
}
#: Inside a comment or a literal the mark of a comment is only a mark.
_INSIDE = {"c": _pattern(_MARKS, *_C), "php": _pattern(_MARKS, *_PHP), "hash": _WHOLE["plain"], "plain": _WHOLE["plain"], "xml": _pattern(_NEVER, *_XML)}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
_PHP_OPEN = re.compile(r"<\?(?:php\b|=)?")
_BEFORE_REGEX = frozenset("return typeof case in of".split())


class Tokens:
    """Parallel lists: ``kind``, ``start``, ``end`` and, of literals and comments, the content's place
    ``a`` to ``b``; ``fresh`` tells that a line begins before the token."""

    def __init__(self, text: str):
        self.text = text
        self.kind: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, kind: int, start: int, end: int, a: int = -1, b: int = -1) -> None:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)
        self.a.append(a if a >= 0 else start)
        self.b.append(b if b >= 0 else end)

    def __len__(self) -> int:
        return len(self.kind)

    def at(self, place: int) -> int:
        """The token that holds a place, else the next one."""
        i = bisect_right(self.start, place) - 1
        return i if i >= 0 and place < self.end[i] else i + 1

    def value(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def fresh(self, i: int) -> bool:
        return "\n" in self.text[self.end[i - 1] if i else 0 : self.start[i]]


def _template(out: Tokens, text: str, at: int, end: int, braces: list[int], dead: list[int]) -> int:
    """Reads template text from ``at``; gives the place after it."""
    m = _TEMPLATE.match(text, at, end)
    if not m[1]:
        dead[0] = at
        return at
    whole = m[1] == "`" and text[at - 1] == "`"
    out.add(STRING if whole else PIECE, at - 1, m.end(), at, m.start(1))
    if m[1] == "${":
        braces.append(0)
    return m.end()


def lex(text: str, family: str | None, start: int = 0, end: int | None = None, inner: bool = False) -> Tokens:
    """The tokens of ``text[start:end]``. ``inner`` reads the inside of a comment or a literal, where
    the marks of comments are left out."""
    out = Tokens(text)
    end = len(text) if end is None else end
    if family is None:
        return out
    match = (_INSIDE if inner else _WHOLE)[family].match
    operator = 7 if family == "php" else 6
    pos, braces, dead = start, [], [-1]
    if family == "php" and not inner:
        opened = _PHP_OPEN.search(text)
        if opened and text.lstrip("\ufeff \t\r\n")[:1] == "<":  # else a part of a file, code from its first sign
            if opened.start():
                out.add(TEXT, 0, opened.start())
            pos = opened.end()
    prev = ""
    while pos < end:
        m = match(text, pos, end)
        if m is None:
            break
        group = m.lastindex
        if family == "php" and m[5]:
            group = 5
        at, pos = m.start(group), m.end()
        if inner and group == 1:
            continue
        if group == 1:
            head = 4 if family == "xml" else 2 if text[at : at + 2] in ("//", "/*") else 1
            close = 3 if family == "xml" else 2 if text.startswith("/*", at) else 0
            out.add(COMMENT, at, pos, at + head, pos - close)
        elif group == 2:
            k = 3 if family in ("hash", "plain") and text[at : at + 3] in ("'''", '"""') and pos - at >= 6 else 1
            out.add(STRING, at, pos, at + k, pos - k)
            prev = '"'
        elif group == 3:
            prev = m[3]
            out.add(NAME, at, pos)
        elif group == 4:
            prev = "0"
            out.add(NUMBER, at, pos)
        elif group == 5 and family == "php":
            close = re.compile(rf"^[ \t]*{m[6]}\b", re.M).search(text, pos, end)
            if close:
                out.add(STRING, at, close.end(), pos, max(pos, close.start() - 1))
                pos, prev = close.end(), '"'
        elif group == 5:
            if dead[0] < 0:
                pos = _template(out, text, pos, end, braces, dead)
                prev = '"'
        elif group == operator:
            c = m[group]
            if c == "/" and family in ("c",) and (not prev or prev in _BEFORE_REGEX or prev[-1] in "(,=:[!&|?{};+-*%<>~^"):
                r = _REGEX.match(text, at, end)
                if r:
                    pos, prev = r.end(), "0"
                    out.add(NUMBER, at, pos)
                    continue
            if braces and c == "{":
                braces[-1] += 1
            elif braces and c == "}":
                if braces[-1]:
                    braces[-1] -= 1
                else:
                    braces.pop()
                    pos = _template(out, text, pos, end, braces, dead)
                    prev = '"'
                    continue
            if c == "?>":
                opened = _PHP_OPEN.search(text, pos)
                stop = opened.start() if opened else end
                if stop > pos:
                    out.add(TEXT, pos, stop)
                pos = min(end, opened.end()) if opened else end
                prev = ""
                continue
            prev = c
            out.add(OPERATOR, at, pos)
        else:
            prev = ""
    return out


def groups(tokens: Tokens) -> list[tuple[int, int]]:
    """(start, end) of the comments; line comments that follow each other, each on its own line, are one."""
    out: list[tuple[int, int]] = []
    last = -2
    for i, kind in enumerate(tokens.kind):
        if kind == COMMENT:
            if last == i - 1 and not tokens.text.startswith("/*", tokens.start[i]) and tokens.text.count("\n", out[-1][1], tokens.start[i]) <= 1:
                out[-1] = (out[-1][0], tokens.end[i])
            else:
                out.append((tokens.start[i], tokens.end[i]))
            last = i
    return out


def literal_text(tokens: Tokens) -> str:
    """The text with quotes in place of everything but the contents of literals and comments, at equal length."""
    text, out, at = tokens.text, [], 0
    for kind, a, b in zip(tokens.kind, tokens.a, tokens.b):
        if kind in (STRING, PIECE, COMMENT, TEXT):
            out.append('"' * (a - at))
            out.append(text[a:b])
            at = b
    out.append('"' * (len(text) - at))
    return "".join(out)
