"""Lexers with a pushdown stack that tell whether a source text can parse (problem 5).

Each checker reads a text once, keeps the open delimiters (elements, keywords) on a stack, and knows
whether an operand may come next. It raises ``Invalid`` with a reason and a place. JSON, TOML and XML
texts that pass their lexer are read by the standard library's strict parsers too.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.parsers.expat
from collections.abc import Callable


class Invalid(ValueError):
    def __init__(self, reason: str, at: int = 0):
        super().__init__(reason)
        self.reason, self.at = reason, at


#: A line that a version control system leaves in a conflicting text.
_CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?:\s|\Z)|={7}\s*?(?:\n|\Z)")


def _marker(text: str, at: int) -> None:
    """Raises for a conflict marker at ``at``; lexers ask where code, not a comment or a literal, is read."""
    if (not at or text[at - 1] == "\n") and _CONFLICT.match(text, at):
        raise Invalid("merge conflict marker", at)


# ---------------------------------------------------------------- JavaScript, TypeScript, JSX

_JS = re.compile(
    r"[ \t\r\f\v ﻿]*(?:"
    r"(\n)"  # 1
    r"|(//[^\n]*)"  # 2
    r"|(/\*)"  # 3
    r"|([A-Za-z_$\u0080-￿][\w$]*)"  # 4 word
    r"|('(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")"  # 5 string
    r"|((?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?)"  # 6 number
    r"|(`)"  # 7
    r"|([([{])"  # 8
    r"|([)\]}])"  # 9
    r"|(=>|\.\.\.|\?\.(?!\d)|\*\*=|>>>=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%=<>!~?:;,.&|^@#\\])"  # 10 operator
    r"|(\S)"  # 11
    r")"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
_BLOCK_END = re.compile(r"\*/")
#: After these an operand follows.
_JS_BEFORE_OPERAND = frozenset("return typeof case do else in of instanceof new delete void throw await yield extends default import export async const let var function class if while for switch with catch finally try static get set type interface namespace module declare abstract readonly public private protected override as is keyof infer unique asserts from satisfies enum global implements accessor out require continue break".split())
_JS_INFIX = frozenset("in of instanceof as is extends implements from satisfies".split())
_JS_RESERVED = frozenset("const var return throw new delete typeof void case if while switch else do class".split())
_JS_CONTROL = frozenset("if while for switch with catch".split())
_JS_MODIFIERS = frozenset("private public protected readonly abstract override declare".split())
#: What may follow ``export``.
_JS_EXPORTED = frozenset("const let var function class default async interface type enum namespace module abstract declare import as".split())
_JS_BINARY = frozenset("= == === != !== && || ?? + - / % ** += -= *= /= %= &= |= ^= &&= ||= ??= **= <<= >>= >>>= => . ?. <= >= <<".split())
_JS_NEVER_FIRST = _JS_BINARY - {"+", "-", "/", "."} | {"*"}
_JSX_ELEMENT = re.compile(r"<(?:>|[A-Za-z_$])")
_JSX_GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b|=)")
_JSX_IN_TS = re.compile(r"<>|<[A-Za-z][\w.]*(?:\s+[\w:-]+=[\"'{]|\s*/>|\s+\{\.\.\.)|<([A-Za-z][\w.]*)>(?:[^<>]|<[^<>]*>)*</\1\s*>|</")
_JSX_TAG = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)?")
_JSX_ATTRIBUTE = re.compile(r"\s*(?:(/>)|(>)|(\{)|([A-Za-z_$][\w$.:-]*)(?:\s*=\s*(?:(\"[^\"]*\"|'[^']*')|(\{)|(<)))?)|/\*[\s\S]*?\*/|\s*//[^\n]*")
_JSX_TEXT = re.compile(r"[^<{}>]*")


def check_js(text: str, ts: bool = False, jsx: bool = False) -> None:
    """A script or module. JSX is accepted only with ``jsx``, type syntax only with ``ts``."""
    match, pos, n = _JS.match, 0, len(text)
    if text.startswith("#!"):
        pos = (text.find("\n") + 1) or n
    # an open delimiter: [character, kind, place, open ternaries, in a case label]
    stack: list[list] = []
    top = ["", "block", 0, 0, False]
    operand = True  # may an operand come next
    prev, prev2, kind = ";", "", "op"  # last token, the one before, its kind
    newline = True
    class_due = -1  # depth at which a class body is awaited
    last_paren, pattern = "", False  # what the last closed parenthesis was; was it a pattern that must be assigned

    def template(at: int) -> tuple[int, bool]:
        m = _TEMPLATE.match(text, at)
        if not m[1]:
            raise Invalid("unterminated template", at)
        return m.end(), m[1] == "`"

    def element(at: int) -> int:
        """Reads a tag from its ``<``; pushes what is left open; gives the place after it."""
        nonlocal top
        m = _JSX_TAG.match(text, at + 1)
        tag, at = m[1] or "", m.end()
        return attributes(tag, at)

    def attributes(tag: str, at: int) -> int:
        nonlocal top
        while True:
            m = _JSX_ATTRIBUTE.match(text, at)
            if not m or m.end() == at:
                if tag and text[at : at + 1] == "<":  # type arguments
                    end = text.find(">", at)
                    if end > 0:
                        at = end + 1
                        continue
                raise Invalid("malformed tag", at)
            at = m.end()
            if m[1]:
                return closed(at)
            if m[2]:
                stack.append(top)
                top = ["<", tag, at, 0, False]
                return children(at)
            if m[3] or m[6]:
                stack.append(top)
                top = ["{", "attribute", at, tag, False]
                return -at - 1  # an expression follows
            if m[7]:
                raise Invalid("element as attribute", at)

    def closed(at: int) -> int:
        """An element has ended: inside another one its text goes on."""
        return children(at) if top[0] == "<" else at

    def children(at: int) -> int:
        nonlocal top
        while True:
            at = _JSX_TEXT.match(text, at).end()
            c = text[at : at + 1]
            if c == "{":
                stack.append(top)
                top = ["{", "child", at, 0, False]
                return -at - 2
            if c != "<":
                raise Invalid("unclosed element" if not c else "stray character in element text", at)
            if text.startswith("</", at):
                m = _JSX_TAG.match(text, at + 2)
                end = re.compile(r"\s*>").match(text, m.end())
                if not end or (m[1] or "") != top[1]:
                    raise Invalid("mismatched closing tag", at)
                top = stack.pop()
                at = end.end()
                if top[0] != "<":
                    return at
                continue
            return element(at)

    def resumed(at: int) -> tuple[int, bool]:
        """(place, does an expression follow) of what the tag readers give."""
        return (-at - 1, True) if at < 0 else (at, False)

    while pos < n:
        m = match(text, pos)
        if m is None:
            break  # blanks up to the end
        group = m.lastindex
        start, pos = m.start(group), m.end()
        if group == 1:
            newline = True
            continue
        if group == 2:
            continue
        if group == 3:
            end = text.find("*/", pos)
            if end < 0:
                raise Invalid("unterminated comment", start)
            newline = newline or "\n" in text[start:end]
            pos = end + 2
            continue
        tok = m[group]
        member = prev == "." or prev == "?."
        if group == 4:  # word
            if member:
                operand, kind = False, "word"
            else:
                infix = tok in _JS_INFIX
                if kind in ("word", "num", "str") and not operand and not infix and (not newline or top[0] == "(" or top[0] == "[" or not ts and top[1] == "object"):
                    raise Invalid("two operands without an operator", start)
                if prev == "export" and kind == "word" and tok not in _JS_EXPORTED:
                    raise Invalid("declaration expected", start)
                if pattern and prev == "}" and not infix:
                    raise Invalid("pattern without a value", start)
                if not ts and kind == "word" and not newline:
                    if prev in _JS_MODIFIERS or prev in ("interface", "enum", "namespace", "type") and prev2 in (";", "}", "{", "export", "") and tok not in _JS_INFIX:
                        raise Invalid("type syntax outside TypeScript", start)
                if not ts and prev == "as" and kind == "word" and not operand_before_as_ok(top, prev2):
                    raise Invalid("type syntax outside TypeScript", start)
                operand, kind = tok in _JS_BEFORE_OPERAND, "word"
                if tok == "case" or tok == "default" and prev != "export":
                    if top[4] and top[1] == "block":
                        raise Invalid("label without a colon", start)
                    top[4] = True
                elif tok == "class":
                    class_due = len(stack)
            prev2, prev = prev, tok
            newline = False
            continue
        if group == 5 or group == 6:
            k = "str" if group == 5 else "num"
            if kind in ("word", "num", "str") and not newline and not operand:
                raise Invalid("two operands without an operator", start)
            if group == 6 and pos < n and (text[pos] == "_" or text[pos].isalnum()):
                raise Invalid("malformed number", start)
            operand, kind, prev2, prev, newline = False, k, prev, tok, False
            continue
        if group == 7:
            pos, whole = template(pos)
            if not whole:
                stack.append(top)
                top = ["{", "template", start, 0, False]
                operand, kind, prev2, prev = True, "op", prev, "${"
            else:
                operand, kind, prev2, prev = False, "tpl", prev, "`"
            newline = False
            continue
        if group == 8:
            what = "block"
            if tok == "{":
                if prev == ")" and kind == "op" and last_paren == "call" and not newline and top[1] not in ("class", "object") and class_due != len(stack):
                    raise Invalid("brace after an expression", start)
                if kind in ("word", "str", "num", "tpl") and not operand and top[0] in ("(", "[") and class_due != len(stack):
                    raise Invalid("brace after an operand", start)
                if class_due == len(stack):
                    what, class_due = "class", -1
                elif prev in ("const", "let", "var") and kind == "word" and not member:
                    what = "pattern"
                elif operand and kind == "op" and prev not in (";", "{", "}", ")", "=>", "", "${") and not (prev == ":" and (top[4] or ts)):
                    what = "object"
                elif prev in ("return", "default", "throw", "yield", "await", "typeof", "in", "of") and kind == "word" and not member:
                    what = "object"
                elif prev in ("import", "export", "type") or prev2 == "import":
                    what = "import"
                if top[1] == "object" and prev == "{":
                    raise Invalid("brace where a key is expected", start)
            elif tok == "(":
                if prev in _JS_CONTROL and not (prev2 in (".", "?.")) or prev == "await" and prev2 == "for":
                    what = "control"
                elif prev == "function" or prev2 == "function" or prev2 == "*" or prev == "*" or prev == ">":
                    what = "params"
                elif kind == "num" and not newline:
                    raise Invalid("number called", start)
            stack.append(top)
            top = [tok, what, start, 0, False]
            operand, kind, prev2, prev, newline = True, "op", prev, tok, False
            continue
        if group == 9:
            want = {")": "(", "]": "[", "}": "{"}[tok]
            if top[0] != want:
                raise Invalid(f"unbalanced {tok}", start)
            if kind == "op" and prev in _JS_BINARY:
                raise Invalid("operand missing", start)
            if kind == "word" and prev in ("new", "typeof", "const", "throw", "case", "instanceof") and prev2 not in (".", "?.", ",", "{", "get", "set"):
                raise Invalid("operand missing", start)
            if what_open(top, ts):
                raise Invalid("operand missing", start)
            what, tag = top[1], top[3]
            top = stack.pop()
            newline = False
            if tok == ")":
                last_paren = "call" if what == "block" else what
            pattern = what == "pattern"
            if what == "template":
                pos, whole = template(pos)
                if whole:
                    operand, kind, prev2, prev = False, "tpl", prev, "`"
                else:
                    stack.append(top)
                    top = ["{", "template", start, 0, False]
                    operand, kind, prev2, prev = True, "op", prev, "${"
                continue
            if what in ("attribute", "child"):
                at = attributes(tag, pos) if what == "attribute" else children(pos)
                pos, more = resumed(at)
                operand, kind, prev2, prev = (True, "op", prev, "{") if more else (False, "jsx", prev, "/>")
                continue
            operand = what == "control" or tok == "}" and what == "block"
            kind, prev2, prev = "op", prev, tok
            continue
        if group == 11:
            raise Invalid("character outside the language", start)
        # operators
        if tok[0] in "<>=|":
            _marker(text, start)
        if tok == "/" or tok == "/=":
            if operand:
                r = _REGEX.match(text, start)
                if r:
                    pos = r.end()
                    operand, kind, prev2, prev, newline = False, "re", prev, "/r/", False
                    continue
                if prev != ")" and prev != "}":
                    raise Invalid("unterminated regular expression", start)
        elif tok == "<" and (operand or newline and prev == "}"):
            c = text[pos : pos + 1]
            if jsx and _JSX_ELEMENT.match(text, start) and not (ts and _JSX_GENERIC.match(text, start)) and (kind != "word" or prev in ("return", "default", "yield", "case", "else", "await", "typeof", "of", "in")):
                at, more = resumed(element(start))
                pos = at
                operand, kind, prev2, prev, newline = (True, "op", prev, "{", False) if more else (False, "jsx", prev, "/>", False)
                continue
            if c in "!?%/" or kind == "op" and not ts and (c.isalpha() or c == ">"):
                raise Invalid("markup outside JSX", start)
            if ts and not jsx and (kind == "op" or prev in ("return", "default")) and _JSX_IN_TS.match(text, start):
                raise Invalid("markup outside JSX", start)
        elif tok == "#":
            if not (text[pos : pos + 1].isalpha() or text[pos : pos + 1] in ("_", "$")):
                raise Invalid("character outside the language", start)
            prev2, prev, kind, operand = prev, "#", "op", True
            continue
        elif tok == "\\":
            raise Invalid("character outside the language", start)
        elif tok == ":" and not ts:
            if top[3] > 0:
                top[3] -= 1
            elif top[0] in ("(", "["):
                raise Invalid("type syntax outside TypeScript", start)
            elif top[4]:
                top[4] = False
            elif prev == ")" and kind == "op" or kind == "word" and prev2 in ("const", "let", "var"):
                raise Invalid("type syntax outside TypeScript", start)
        elif tok == ":":
            if top[3] > 0:
                top[3] -= 1
            top[4] = False
        elif tok == "?":
            top[3] += 1
            if not ts and text[pos : pos + 1] == ":":
                raise Invalid("type syntax outside TypeScript", start)
        if tok == ";":
            if what_open(top, ts):
                raise Invalid("operand missing", start)
            top[3] = 0
        if tok in _JS_NEVER_FIRST and kind == "op" and (prev in (";", "(", "[", ",", "{") or prev in _JS_BINARY):
            if not (tok == "*" and prev in ("{", ",", ";")) and not (tok == "=>" and prev == ")"):
                raise Invalid("operand missing", start)
        elif tok in (";", ",") and kind == "op" and prev in _JS_BINARY:
            raise Invalid("operand missing", start)
        elif kind == "word" and prev in _JS_RESERVED and prev2 not in (".", "?.") and tok in _JS_BINARY and tok not in ("+", "-", "/", ".") and top[1] == "block":
            raise Invalid("operand missing", start)
        if tok in ("++", "--"):
            if newline:
                operand = True
        elif tok == "!" and not operand and ts and not newline:
            pass  # non-null
        else:
            operand = True
        if tok == ";" and top[0] in ("(", "[") and top[1] != "control":
            raise Invalid("unbalanced " + top[0], top[2])
        kind, prev2, prev, newline = "op", prev, tok, False
    if stack:
        raise Invalid("unclosed element" if top[0] == "<" else f"unclosed {top[0]}", top[2])
    if kind == "op" and prev in _JS_BINARY or kind == "word" and prev in _JS_RESERVED | {"function", "import", "export", "extends", "await"} and prev2 not in (".", "?."):
        raise Invalid("premature end", n)


def what_open(top: list, ts: bool) -> bool:
    """Is a label or, outside TypeScript, a conditional still without its colon where a statement or a
    bracket ends?"""
    if top[0] in ("{", "") and top[1] == "block" and top[4]:
        return True
    return not ts and top[1] in ("block", "control", "class", "params") and isinstance(top[3], int) and top[3] > 0


def operand_before_as_ok(top: list, before: str) -> bool:
    """Is ``x as y`` legal in JavaScript here: in the braces of an import or export, or after ``*``."""
    return top[1] in ("import", "object") or before == "*" or top[0] == "{" and top[1] == "block" and before in ("default",)


# ---------------------------------------------------------------- PHP

_PHP = re.compile(
    r"\s*(?:"
    r"(//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z))"  # 1
    r"|(/\*)"  # 2
    r"|(<<<[ \t]*(?:\"(\w+)\"|'(\w+)'|(\w+))\r?\n)"  # 3 4 5 6
    r"|(\$+[A-Za-z_\x80-￿][\w\x80-￿]*)"  # 7 variable
    r"|(\\?[A-Za-z_\x80-￿][\w\x80-￿]*(?:\\[A-Za-z_\x80-￿][\w\x80-￿]*)*(?:\\(?=\{))?)"  # 8 word
    r"|('(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`)"  # 9 string
    r"|((?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?))"  # 10 number
    r"|(\#\[|[([{])"  # 11
    r"|([)\]}])"  # 12
    r"|(\?>\n?)"  # 13
    r"|(=>|->|\?->|::|\.\.\.|\*\*=|<<=|>>=|\?\?=|<=>|===|!==|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.=|\*\*|<<|>>|[-+*/%=<>!~?:;,.&|^@$\\])"  # 14
    r"|(\S)"  # 15
    r")"
)
_PHP_BINARY = frozenset("= == === != !== && || ?? + - * / % ** += -= *= /= .= %= &= |= ^= ??= **= <<= >>= -> ?-> :: . < > <= >= <=> <>".split())
_PHP_NEVER_FIRST = _PHP_BINARY - {"+", "-", "::"}
_PHP_BEFORE_OPERAND = frozenset("return echo print new clone throw case instanceof and or xor as insteadof include include_once require require_once yield from global static function fn class interface trait enum extends implements namespace use const public private protected abstract final readonly var if elseif else while for foreach switch match catch try finally do goto default declare".split())
_PHP_CONTROL = frozenset("if elseif while for foreach switch catch declare".split())
#: Words that may stand right after a value.
_PHP_AFTER_VALUE = frozenset("instanceof and or xor as insteadof use extends implements".split())
_PHP_MODIFIERS = frozenset("public private protected static abstract final readonly".split())
_PHP_CAST = re.compile(r"\(\s*(?:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)\s*\)", re.I)
_PHP_NEEDS_OPERAND = frozenset("new clone throw instanceof function class".split())


def check_php(text: str) -> None:
    """PHP 8; text outside ``<?php`` is free."""
    n, pos = len(text), 0
    stack: list[list] = []
    top = ["", "block", 0, 0]  # character, kind, place, open conditionals
    closed_what = ""
    while True:
        opened = re.compile(r"<\?(?:php\b|=|(?=\s))", re.I).search(text, pos)
        if not opened:
            break
        pos = opened.end()
        prev, prev2, kind = ";", "", "op"
        ended = closed_may_precede = closed_control = closed_call = after_match = after_attribute = word_is_member = False
        while pos < n:
            m = _PHP.match(text, pos)
            if m is None:
                pos = n
                break
            group = m.lastindex if not m[3] else 3
            start, pos = m.start(group), m.end()
            if group == 1:
                continue
            if group == 2:
                end = text.find("*/", pos)
                if end < 0:
                    raise Invalid("unterminated comment", start)
                pos = end + 2
                continue
            tok = m[group]
            if group == 3:
                label = m[4] or m[5] or m[6]
                end = re.compile(rf"^[ \t]*{label}\b", re.M).search(text, pos)
                if not end:
                    raise Invalid("unterminated heredoc", start)
                pos, group, tok = end.end(), 9, "<<<"
            if group == 13:
                if top[0] not in ("", "{") or kind == "op" and prev in _PHP_BINARY:
                    raise Invalid("premature end", start)
                ended = True
                break
            if group == 15:
                raise Invalid("unterminated string" if tok in "'\"`" else "character outside the language", start)
            member = prev in ("->", "?->", "::")
            if group in (7, 9, 10):
                if not member:
                    if kind in ("var", "str", "num"):
                        raise Invalid("two operands without an operator", start)
                    if kind == "op" and prev == "]" or kind == "op" and prev == ")" and not closed_may_precede:
                        raise Invalid("two operands without an operator", start)
                    if kind == "word" and group != 7 and prev.lower() not in _PHP_BEFORE_OPERAND and not word_is_member:
                        raise Invalid("two operands without an operator", start)
                    if kind == "word" and group == 7 and word_is_member:
                        raise Invalid("two operands without an operator", start)
                if group == 10 and pos < n and (text[pos] == "_" or text[pos].isalpha()):
                    raise Invalid("malformed number", start)
                kind = {7: "var", 9: "str", 10: "num"}[group]
                prev2, prev = prev, tok
                continue
            if group == 8:
                low = tok.lower()
                if not member and kind in ("var", "str", "num") and low not in ("instanceof", "and", "or", "xor", "as", "insteadof", "from"):
                    raise Invalid("two operands without an operator", start)
                if not member and kind == "word" and prev.lower() not in _PHP_BEFORE_OPERAND and low not in ("instanceof", "and", "or", "xor", "as", "insteadof", "extends", "implements") and top[1] != "types":
                    raise Invalid("two operands without an operator", start)
                if kind == "op" and (prev == "]" and not after_attribute or prev == ")" and closed_call) and low not in _PHP_AFTER_VALUE:
                    raise Invalid("two operands without an operator", start)
                word_is_member = member and prev != "::" or member
                prev2, prev, kind = prev, tok, "word"
                continue
            if group == 11:
                what = "block"
                low = prev.lower() if kind == "word" else ""
                if tok == "(" and kind == "word" and prev2.lower() in _PHP_MODIFIERS and low not in ("function", "fn"):
                    raise Invalid("function expected", start)
                if tok == "(" and low in ("class", "use"):
                    what = "class"
                elif tok == "(":
                    what = "control" if low in _PHP_CONTROL and not word_is_member else "match" if low == "match" else "params" if low in ("function", "fn") or prev2.lower() in ("function", "fn") or prev2 == "&" else "cast" if _PHP_CAST.match(text, start) else "call"
                elif tok == "{":
                    if prev == ")" and after_match:
                        what = "match"
                    elif prev == ")" and kind == "op" and closed_call and closed_what != "class":
                        raise Invalid("brace after an expression", start)
                    elif member or low.endswith("\\"):
                        what = "name"
                    elif kind in ("var", "str", "num"):
                        raise Invalid("brace after an operand", start)
                stack.append(top)
                top = [tok, what, start, 0]
                prev2, prev, kind = prev, tok, "op"
                continue
            if group == 12:
                want = {")": "(", "]": "[", "}": "{"}[tok]
                if top[0] != want and not (tok == "]" and top[0] == "#["):
                    raise Invalid(f"unbalanced {tok}", start)
                if kind == "op" and prev in _PHP_BINARY or kind == "op" and prev == "=>":
                    raise Invalid("operand missing", start)
                if kind == "word" and prev.lower() in _PHP_NEEDS_OPERAND and prev2 not in ("->", "?->", "::"):
                    raise Invalid("operand missing", start)
                if tok == "}" and top[1] == "block" and (kind in ("var", "str", "num") or kind == "word" and prev.lower() not in ("else", "do", "try") or kind == "op" and prev in (")", "]") and not closed_control):
                    raise Invalid("statement without its semicolon", start)
                if top[3]:
                    raise Invalid("operand missing", start)
                closed_what = top[1]
                closed_call = tok == ")" and top[1] in ("call", "class")
                after_attribute = top[0] == "#["
                closed_may_precede = tok == ")" and top[1] in ("control", "cast")
                closed_control = tok == ")" and top[1] == "control"
                after_match = tok == ")" and top[1] == "match"
                if tok == "]" and top[0] == "#[":
                    prev2, prev, kind = prev, ";", "op"
                else:
                    prev2, prev, kind = prev, tok if tok != "}" or top[1] in ("block",) else "]", "op"
                top = stack.pop()
                continue
            # operators
            if tok[0] in "<>=|":
                _marker(text, start)
            if kind == "op" and tok in _PHP_NEVER_FIRST and (prev in (";", "(", "[", ",", "{", "=>") or prev in _PHP_BINARY):
                raise Invalid("operand missing", start)
            if kind == "op" and tok in (";", ",") and (prev in _PHP_BINARY or prev == "=>"):
                raise Invalid("operand missing", start)
            if tok == ";" and top[0] in ("(", "[") and top[1] != "control":
                raise Invalid(f"unbalanced {top[0]}", top[2])
            if tok == "?" and (kind in ("var", "str", "num") or kind == "op" and prev in (")", "]") or kind == "word" and (word_is_member or prev.lower() not in _PHP_BEFORE_OPERAND)):
                top[3] += 1
            elif tok == ":" and top[3]:
                top[3] -= 1
            elif tok in (";", ",") and top[3]:
                raise Invalid("operand missing", start)
            if kind == "word" and tok in _PHP_NEVER_FIRST - {"->", "?->", ".", "*", "<", ">"} and prev.lower() in ("return", "echo", "new", "throw", "function") and prev2 not in ("->", "?->", "::", "const", "case"):
                raise Invalid("operand missing", start)
            if tok == "\\":
                raise Invalid("character outside the language", start)
            prev2, prev, kind = prev, tok, "op"
        if not ended:
            if stack:
                break
            if kind != "op" or prev not in (";", "}", "{", ":") and prev != "":
                raise Invalid("premature end", n)
            break
    if stack:
        raise Invalid(f"unclosed {top[0]}", top[2])


# ---------------------------------------------------------------- JSON

_JSON = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.])|([\[{])|([\]}])|([,:])|(\S))')


def check_json(text: str) -> None:
    stack: list[str] = []
    expect = "value"
    pos = 0
    while True:
        m = _JSON.match(text, pos)
        if m is None:
            if text[pos:].strip(" \t\r\n"):
                raise Invalid("character outside the language", pos)
            break
        pos, group = m.end(), m.lastindex
        at = m.start(group)
        if group == 1 and expect in ("key", "key or end"):
            expect = "colon"
        elif group in (1, 2) and expect in ("value", "value or end"):
            expect = "more"
        elif group == 3 and expect in ("value", "value or end"):
            stack.append(m[3])
            expect = "key or end" if m[3] == "{" else "value or end"
        elif group == 4 and stack and {"}": "{", "]": "["}[m[4]] == stack[-1] and (expect == "more" or expect.endswith("or end")):
            stack.pop()
            expect = "more"
        elif group == 5 and m[5] == ":" and expect == "colon":
            expect = "value"
        elif group == 5 and m[5] == "," and expect == "more" and stack:
            expect = "key" if stack[-1] == "{" else "value"
        else:
            raise Invalid(f"{expect} expected", at)
    if stack or expect != "more":
        raise Invalid("premature end", len(text))
    try:
        json.loads(text)
    except (ValueError, RecursionError) as e:
        raise Invalid(str(e), getattr(e, "pos", 0)) from None


# ---------------------------------------------------------------- XML

_XML = re.compile(r"<(?:!--([\s\S]*?)-->|!\[CDATA\[[\s\S]*?\]\]>|\?[\s\S]*?\?>|!DOCTYPE(?:[^<>\[]|\[[\s\S]*?\])*>|(/?)([A-Za-z_:\u0080-￿][\w:.\-\u0080-￿]*)((?:\s+[A-Za-z_:\u0080-￿][\w:.\-\u0080-￿]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(/?)>)")


def check_xml(text: str) -> None:
    stack: list[tuple[str, int]] = []
    pos, roots = 0, 0
    while (at := text.find("<", pos)) >= 0:
        m = _XML.match(text, at)
        if not m:
            raise Invalid("malformed tag", at)
        pos = m.end()
        if not m[3]:
            continue
        if m[2]:
            if not stack or stack.pop()[0] != m[3]:
                raise Invalid("mismatched closing tag", at)
        else:
            roots += not stack
            if not m[5]:
                stack.append((m[3], at))
    if stack:
        raise Invalid("unclosed element", stack[-1][1])
    if roots != 1:
        raise Invalid("not one root element", 0)
    try:
        parser = xml.parsers.expat.ParserCreate("utf-8")
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except xml.parsers.expat.ExpatError as e:
        raise Invalid(str(e), 0) from None


# ---------------------------------------------------------------- TOML

_TOML_KEY = r"(?:[\w-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')"
_TOML_HEAD = re.compile(rf"\s*\[\[?\s*{_TOML_KEY}(?:\s*\.\s*{_TOML_KEY})*\s*\]\]?\s*(?:#.*)?\Z")
_TOML_PAIR = re.compile(rf"\s*{_TOML_KEY}(?:\s*\.\s*{_TOML_KEY})*\s*=\s*(?=[^\s#])")
_TOML_PART = re.compile(r"\"\"\"[\s\S]*?(?<!\\)\"\"\"+|'''[\s\S]*?'''+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|#[^\n]*|([\[{])|([\]}])|(\n)|([\"'])|[^\s\[\]{}\"'#]+|[ \t\r]+")


def check_toml(text: str) -> None:
    text = text.replace("\r\n", "\n")
    pos, n = 0, len(text)
    while pos < n:
        end = text.find("\n", pos)
        end = n if end < 0 else end
        line = text[pos:end]
        if not line.strip() or line.lstrip()[0] == "#" or _TOML_HEAD.match(line):
            pos = end + 1
            continue
        m = _TOML_PAIR.match(text, pos, end)
        if not m:
            raise Invalid("neither table nor key and value", pos)
        at, stack = m.end(), []
        while at < n:
            p = _TOML_PART.match(text, at)
            if p[1]:
                stack.append(p[1])
            elif p[2]:
                if not stack or {"]": "[", "}": "{"}[p[2]] != stack.pop():
                    raise Invalid(f"unbalanced {p[2]}", at)
            elif p[4]:
                raise Invalid("unterminated string", at)
            at = p.end()
            if p[3] and not stack:
                break
        if stack:
            raise Invalid(f"unclosed {stack[-1]}", pos)
        pos = at
    try:
        tomllib.loads(text)
    except (ValueError, RecursionError) as e:
        raise Invalid(str(e)[:80], 0) from None


# ---------------------------------------------------------------- YAML

_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|\Z)|<<\s*:(?=\s|\Z)|[?:](?=\s|\Z)")
_YAML_PROPERTY = re.compile(r"(?:[&!][^\s,\[\]{}]*|!<[^>]*>)(?:\s+|\Z)")
_YAML_FLOW = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'|([\[{])|([\]}])|(?<=\s)#[^\n]*|([\"'])(?<=[\[{,:\s][\"'])|[^\[\]{}\"'\s#]+|[\s#\"']")
_YAML_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:\s#.*)?\Z")


def check_yaml(text: str) -> None:
    """Block structure by an indent stack of mappings and sequences, flow collections and quoted
    scalars to their end."""
    lines = text.replace("\r\n", "\n").split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    whole = "\n".join(lines)
    stack: list[tuple[int, str]] = []
    i, n = 0, len(lines)
    scalar_over: int | None = None  # a plain scalar may go on, indented by more than this
    value_due: tuple[int, str] | None = None  # a key or dash whose value may be nested

    def value(rest: str, i: int, column: int, parent: int) -> int:
        """Reads a value that starts on line ``i``; gives the number of the line after it."""
        nonlocal scalar_over, value_due
        while m := _YAML_PROPERTY.match(rest):
            column += m.end()
            rest = rest[m.end() :]
        if not rest or rest[0] == "#":
            return i + 1
        value_due = None
        if _YAML_BLOCK.match(rest):
            j = i + 1
            while j < n and (not lines[j].strip() or len(lines[j]) - len(lines[j].lstrip(" ")) > parent):
                j += 1
            return j
        if rest[0] in "[{":
            depth, at = [], starts[i] + column
            begin = at
            while at < len(whole):
                f = _YAML_FLOW.match(whole, at)
                if f[1]:
                    depth.append(f[1])
                elif f[2]:
                    if not depth or {"]": "[", "}": "{"}[f[2]] != depth.pop():
                        raise Invalid(f"unbalanced {f[2]}", at)
                elif f[3]:
                    raise Invalid("unterminated string", at)
                at = f.end()
                if not depth:
                    break
            if depth:
                raise Invalid(f"unclosed {depth[-1]}", begin)
            return tail(at)
        if rest[0] in "\"'":
            begin = starts[i] + column
            m = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'").match(whole, begin)
            if not m:
                raise Invalid("unterminated string", begin)
            return tail(m.end())
        if rest[0] in "@`%" or rest[0] in ",]}" or rest[0] == "*" and not re.match(r"\*[^\s,\[\]{}]+\s*(?:#.*)?\Z", rest):
            raise Invalid("character that starts no value", starts[i] + column)
        plain = re.split(r"\s#", rest, maxsplit=1)[0]
        if re.search(r":(?:\s|\Z)", plain):
            raise Invalid("a mapping where a value is expected", starts[i] + column)
        scalar_over = parent if len(plain) == len(rest) and rest[0] != "*" else None
        return i + 1

    def tail(at: int) -> int:
        end = whole.find("\n", at)
        end = len(whole) if end < 0 else end
        rest = whole[at:end]
        if rest.strip() and not re.match(r"\s+#", rest):
            raise Invalid("text after a value", at)
        return whole.count("\n", 0, end) + 1

    while i < n:
        line = lines[i]
        body = line.lstrip(" ")
        if not body.strip():
            i += 1
            continue
        indent = len(line) - len(body)
        if body[0] == "#":
            scalar_over = None
            i += 1
            continue
        if indent == 0 and (body.startswith("%") and not stack or re.match(r"(?:---|\.\.\.)(?:\s|\Z)", body)):
            stack, scalar_over, value_due = [], None, None
            rest = body[3:].strip() if body[0] != "%" else ""
            i += 1
            if rest and rest[0] != "#" and not re.match(r"[|>]", rest):
                if _YAML_KEY.match(rest):
                    raise Invalid("a mapping after a document's start", starts[i - 1])
                i = value(rest, i - 1, line.index(rest), -1)
            continue
        if scalar_over is not None and indent > scalar_over:
            if re.search(r"[^\s:]:(?:\s|\Z)", re.split(r"\s#", body)[0]):
                raise Invalid("a mapping where a value is expected", starts[i])
            i += 1
            continue
        scalar_over = None
        if body[0] == "\t":
            raise Invalid("tab as indentation", starts[i])
        column = indent
        first = True
        while True:  # dashes, keys, then a value, all on one line
            dash = body[0] == "-" and (len(body) == 1 or body[1] in " \t")
            key = None if dash else _YAML_KEY.match(body)
            if not dash and not key:
                if first and value_due is None and stack:
                    raise Invalid("neither key nor item", starts[i])
                if first and value_due is not None and column <= value_due[0]:
                    raise Invalid("neither key nor item", starts[i])
                parent = value_due[0] if value_due else -1
                if first and not stack and value_due is None:
                    if i and any(x.strip() and x.lstrip()[0] != "#" for x in lines[:i]) and not re.match(r"---", lines[0]):
                        raise Invalid("text after a value", starts[i])
                i = value(body.rstrip(), i, column, parent)
                break
            kind = "-" if dash else ":"
            if first:
                while stack and stack[-1][0] > column:
                    stack.pop()
                if stack and stack[-1][0] == column and stack[-1][1] == "-" and kind == ":":
                    stack.pop()  # a key after the items that stood at its own column
                    if not stack or stack[-1] != (column, ":"):
                        raise Invalid("a key among items", starts[i])
                here = stack[-1] if stack else (-1, "")
                if here[0] == column and here[1] != kind:
                    if not (kind == "-" and here[1] == ":" and value_due == (column, ":")):
                        raise Invalid("an item among keys", starts[i])
                    stack.append((column, "-"))
                elif here[0] < column:
                    if stack and (value_due is None or value_due[0] >= column):
                        raise Invalid("indentation that fits no level", starts[i])
                    stack.append((column, kind))
            else:
                stack.append((column, kind))
            value_due = (column, kind)
            first = False
            used = 1 if dash else key.end()
            rest = body[used:].lstrip(" \t")
            column += len(body) - len(rest) if rest else used
            body = rest.rstrip()
            if not body or body[0] == "#":
                i += 1
                break
            m = _YAML_PROPERTY.match(body)
            inner = body[m.end() :] if m else body
            if kind == ":":
                if key.group() in ("?", ":") and not re.match(r"[|>\[{\"']", body):
                    if _YAML_KEY.match(body) or body[0] == "-":
                        continue
                    i = value(body, i, column, stack[-1][0])
                    break
                if inner and _YAML_KEY.match(inner) and inner[0] not in "[{\"'":
                    raise Invalid("a mapping where a value is expected", starts[i] + column)
                if re.match(r"-\s", inner):
                    raise Invalid("an item where a value is expected", starts[i] + column)
                i = value(body, i, column, stack[-1][0])
                break
            if not (body[0] == "-" and (len(body) == 1 or body[1] == " ")) and not _YAML_KEY.match(body):
                i = value(body, i, column, stack[-1][0])
                break


# ---------------------------------------------------------------- shell

_SH = re.compile(
    r"[ \t\r]*(?:(\\\n)|(\n)|(\#[^\n]*)|(<<-?[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([\w.-]+)))|(\$\(\()|(\$\(|<\(|>\()|(\$\{)|(')|(\")|(`)"
    r"|(;;&?|;&|&&|\|\||\|&|<<<|>>|>&|<&|&>|>\||[;&|<>])|(\(\(|\()|(\)\)|\))|((?:\\[\s\S]|\$(?:'(?:[^'\\]|\\[\s\S])*'|[\w*@#?$!-])?|[^\s\\'\"`$;&|<>()])+))"
)
_SH_OPEN = {"if": "fi", "case": "esac", "for": "do", "while": "do", "until": "do", "select": "do", "do": "done", "{": "}", "[[": "]]"}


def check_sh(text: str) -> None:
    n, pos = len(text), 0
    stack: list[list] = []
    pending: list[tuple[str, bool]] = []  # here-documents that start on the next line
    command = True  # may a command come next
    last, empty = "", False

    def quoted(at: int, open_at: int) -> int:
        """The place after a double-quoted string; nested substitutions are followed."""
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == '"':
                return at + 1
            elif c == "`":
                end = text.find("`", at + 1)
                if end < 0:
                    raise Invalid("unterminated string", at)
                at = end + 1
            elif text.startswith("$(", at) or text.startswith("${", at):
                at = nested(at + 2, ")" if text[at + 1] == "(" else "}", at)
            else:
                at += 1
        raise Invalid("unterminated string", open_at)

    def nested(at: int, close: str, open_at: int) -> int:
        depth = 1
        while at < n:
            c = text[at]
            if c == "\\":
                at += 1
            elif c == '"':
                at = quoted(at + 1, at)
                continue
            elif c == "'" and close == ")":
                at = text.find("'", at + 1)
                if at < 0:
                    raise Invalid("unterminated string", open_at)
            elif c == ("(" if close == ")" else "{"):
                depth += 1
            elif c == close:
                depth -= 1
                if not depth:
                    return at + 1
            at += 1
        raise Invalid("unterminated substitution", open_at)

    while pos < n:
        m = _SH.match(text, pos)
        if m is None:
            break
        group = m.lastindex if not m[4] else 4
        start, pos = m.start(group), m.end()
        if group == 1:
            continue
        if group == 2:
            while pending:
                word, tabs = pending.pop(0)
                end = re.compile(rf"^{'	*' if tabs else ''}{re.escape(word)}\r?$", re.M).search(text, pos)
                if not end:
                    raise Invalid("unterminated here-document", start)
                pos = end.end()
            if last not in ("&&", "||", "|"):
                command = True
            continue
        if group == 3:
            continue
        if group == 4:
            pending.append((m[5] or m[6] or m[7], m[4].startswith("<<-")))
            last = "word"
            continue
        if group in (8, 9, 10):
            pos = nested(pos, "}" if group == 10 else ")", start)
            command, last = False, "word"
        elif group == 11:
            end = text.find("'", pos)
            if end < 0:
                raise Invalid("unterminated string", start)
            pos, command, last = end + 1, False, "word"
        elif group == 12:
            pos, command, last = quoted(pos, start), False, "word"
        elif group == 13:
            end = text.find("`", pos)
            if end < 0:
                raise Invalid("unterminated substitution", start)
            pos, command, last = end + 1, False, "word"
        elif group == 14:
            tok = m[14]
            if tok[0] in "<>|":
                _marker(text, start)
            if tok[0] in "<>" or tok == "&>":
                if last == "redirect":
                    raise Invalid(f"unexpected {tok}", start)
                last = "redirect"
                continue
            if stack and stack[-1][0] == "]]":
                continue
            if tok in (";;", ";&", ";;&"):
                if not stack or stack[-1][0] != "esac":
                    raise Invalid("unexpected ;;", start)
                stack[-1][2] = True
            elif command and last not in ("word", "&", "done") and tok != "&" or last in ("&&", "||", "|", ";") and tok in ("&&", "||", "|", ";", ";;"):
                raise Invalid(f"unexpected {tok}", start)
            command, last = True, tok
        elif group == 15:
            if stack and stack[-1][0] == "esac" and stack[-1][2]:
                continue  # the optional parenthesis of a pattern
            if m[15] == "((":
                pos = nested(pos, ")", start)
                if text[pos : pos + 1] == ")":
                    pos += 1
                command, last = False, "word"
                continue
            if not command and text[pos : pos + 1] != ")":
                if not (stack and stack[-1][0] == "]]") and not text[start - 1 : start] == "=":
                    raise Invalid("unexpected (", start)
            end = re.compile(r"\s*\)").match(text, pos)
            if end and not command:  # a function's name went before
                pos, command, last = end.end(), True, "fn"
                continue
            if text[start - 1 : start] == "=":
                pos = nested(pos, ")", start)
                last = "word"
                continue
            stack.append([")", start, False])
            command, last = True, "("
        elif group == 16:
            if stack and stack[-1][0] == "esac" and stack[-1][2]:
                stack[-1][2] = False
                command, last = True, "pattern"
                pos = start + 1
                continue
            if not stack or stack[-1][0] != ")":
                raise Invalid("unbalanced )", start)
            stack.pop()
            pos = start + 1
            command, last = False, "word"
        else:
            tok = m[17]
            if stack and stack[-1][0] == "esac" and stack[-1][2] and tok != "esac":
                continue  # patterns
            if stack and stack[-1][0] == "]]":
                if tok == "]]":
                    stack.pop()
                    command, last = False, "word"
                continue
            if tok == "in" and stack and stack[-1][0] == "esac" and not stack[-1][2] and stack[-1][3:] == []:
                stack[-1][2] = True
                stack[-1].append(True)
                continue
            if command:
                if last == "redirect":
                    last = "word"
                    continue
                if tok in ("then", "elif", "else"):
                    if not stack or stack[-1][0] != "fi":
                        raise Invalid(f"unexpected {tok}", start)
                    if tok == "then":
                        stack[-1][2] = True
                    elif not stack[-1][2]:
                        raise Invalid("then missing", start)
                    if tok == "elif":
                        stack[-1][2] = False
                    command, last = True, "keyword"
                    continue
                if tok == "do" and stack and stack[-1][0] == "do":
                    stack[-1] = ["done", start, False]
                    last = "keyword"
                    continue
                if tok in ("fi", "done", "esac", "}"):
                    if not stack or stack[-1][0] != tok or tok == "fi" and not stack[-1][2]:
                        raise Invalid(f"unexpected {tok}", start)
                    stack.pop()
                    command, last = False, "word"
                    continue
                if tok in ("do",):
                    raise Invalid("unexpected do", start)
                if tok in _SH_OPEN:
                    stack.append([_SH_OPEN[tok], start, False])
                    command, last = tok not in ("case", "for", "select", "[["), "keyword"
                    continue
                if tok in ("!", "time", "function") or re.match(r"\w+=", tok):
                    last = "word"
                    command = tok in ("!", "time")
                    continue
            command, last = False, "word"
    if pending:
        raise Invalid("unterminated here-document", n)
    if stack:
        raise Invalid(f"{stack[-1][0]} missing", stack[-1][1])
    if last in ("&&", "||", "|"):
        raise Invalid("premature end", n)


#: Language of each file ending, and its checker.
LANGUAGES: dict[str, tuple[str, Callable[[str], None]]] = {
    "ts": ("typescript", lambda s: check_js(s, ts=True)),
    "tsx": ("tsx", lambda s: check_js(s, ts=True, jsx=True)),
    "js": ("javascript", check_js),
    "jsx": ("jsx", lambda s: check_js(s, jsx=True)),
    "php": ("php", check_php),
    "json": ("json", check_json),
    "yaml": ("yaml", check_yaml),
    "yml": ("yaml", check_yaml),
    "toml": ("toml", check_toml),
    "xml": ("xml", check_xml),
    "sh": ("shell", check_sh),
}


def fault(ending: str, text: str) -> tuple[str, int] | None:
    """(reason, line) of what makes a text unparsable in the language of its file ending."""
    text = text.removeprefix("﻿")
    if not text:
        return None
    try:
        LANGUAGES[ending][1](text)
    except Invalid as e:
        line = text.rfind("\n", 0, e.at) + 1
        marked = _CONFLICT.match(text, line) or _CONFLICT.match(text, e.at)
        return "merge conflict marker" if marked else e.reason, text.count("\n", 0, e.at) + 1
    return None
