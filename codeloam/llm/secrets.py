"""Credentials in source and configuration text: found lexically, redacted in place (problem 2).

Every text with a cue is cut into tokens (``lexer``). A literal is flagged if it is assigned or passed
to a credential-named identifier and is no placeholder; forms that give themselves away (key blocks,
prefixed tokens, URLs and headers that hold one) are looked for inside literals and comments, or
anywhere in texts whose values need no quotes. Only the characters of the value are replaced, so
delimiters, escapes and everything around stay as they were.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.llm.lexer import COMMENT, FAMILIES, NAME, NUMBER, OPERATOR, PIECE, STRING, TEXT, Tokens, groups, lex, literal_text

# Words that name a credential by themselves, and those that do after a qualifier.
STRONG = frozenset("password passwd pwd passphrase passcode secret apikey authtoken accesstoken secretkey privatekey credential credentials passwort kennwort contrasena contraseña clave senha motdepasse wachtwoord parola haslo pw pass pin".split())
WEAK_KEY = frozenset("api secret private access signing encryption auth master session service account storage shared client webhook ssh deploy hmac jwt crypt cipher admin root aes rsa app consumer".split())
TOKEN_KIND = frozenset("auth access refresh bot private api session bearer id csrf oauth secret deploy personal npm github gitlab slack webhook user service client jwt admin".split())
#: Trailing parts that say nothing about what a name holds.
NEUTRAL = frozenset("value literal string str const default raw plain text b64 base64 encoded enc fallback prod dev staging test live old new tmp local env var current main backup".split())
#: Functions that look a value up: their literals name a place.
LOOKUPS = re.compile(r"(?:getenv|env|read\w*|get\w*|lookup\w*|fetch\w*|find\w*|load\w*|config|require|import|include|vault\w*|resolve\w*|param\w*|input|header|option|file_get_contents|constant|defined|hash\w*|md5|sha\w*|has|isset|test|match|replace|split|log|warn|error|debug|info|print\w*|echo|throw|Error|describe|it|t|__)\Z", re.I)
# Words near which a credential may stand; looked for in lower case.
CUES = (*"pass pwd pw secret token key credential kennwort contrase clave senha motdep mot_de mot-de wachtw parola haslo pin auth login access: zugang user connect pdo mysqli client signin sign_in account konto hmac cipher openssl_ jwt ://".split(), "bearer ", "basic ", "begin ", "-u ")
_NAME_TAIL = re.compile(r"[\w$\-ñ]*")
_PARTS = re.compile(r"[A-ZÑ]+(?![a-zñ])|[A-ZÑ]?[a-zñ]+|\d+")

_PREFIXED = re.compile(
    r"(?<![\w/+.-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|npm_[A-Za-z0-9]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|ya29\.[\w-]{20,}|dop_v1_[0-9a-f]{32,}|hf_[A-Za-z0-9]{20,}|pypi-[\w-]{30,}|shp(?:at|ss)_[0-9a-fA-F]{20,}|sk-[A-Za-z0-9]{20,})"
)
_PREFIXES = ("gh", "glpat-", "npm_", "k_live_", "k_test_", "xox", "AKIA", "ASIA", "AIza", "SG.", "eyJ", "ya29.", "dop_v1_", "hf_", "pypi-", "shpat_", "shpss_", "sk-")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^\s/:@'\"`<>|$]*):([^\s/'\"`<>|]+)@[\w.\-\[{$]")
_PARAMETER = re.compile(r"[?&;](?:(?:access|auth|refresh|id|api|private|session)[_-]?(?:token|key|secret)|token|api[_-]?key|apikey|auth|key|secret|password|passwd|pwd|sig|signature|client[_-]?secret|sas|code)=([^\s&'\"`<>#|;,)\]}]+)", re.I)
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token)\s+([A-Za-z0-9._~+/=-]{8,})")
_FLAG = re.compile(r"(?<!\S)(?:-u|--user)[ =]['\"]?([^\s:'\"$]+):([^\s'\"]+)")
_OPTION = re.compile(r"(?<!\S)--?[\w-]*?(?:password|passwd|pass|token|api-?key|secret|secret-key|access-key|pw)[ =](['\"]?)([^\s'\"]+)\1", re.I)
_LOGIN_CALL = re.compile(r"(?:\b|_)(?:login|log_in|signin|sign_in|authenticate|auth|connect|setCredentials|withCredentials|basicAuth|PDO|mysqli|mysqli?_connect|new\s+\w*(?:Client|Connection|Pool|Session)|createConnection|ftp_login)\s*\(", re.I)
_ENCODED = re.compile(r"[:=][ \t]*[\"']?([A-Za-z0-9+/]{10,}={1,2}|[A-Za-z0-9+/]{16,})[\"']?,?\r?$", re.M)
_KEYED_CALL = re.compile(r"(?:createHmac|hash_hmac|createCipheriv|createDecipheriv|openssl_encrypt|openssl_decrypt|jwt\s*\.\s*sign|jwt\s*\.\s*verify|JWT::encode|JWT::decode|hmac\.new|(?<!as)(?<!de)sign|verify)\s*\(", re.I)
#: The argument that holds the credential, of calls where it has one place; calls whose only argument is one; calls that say it by other words of their line.
_PLACE_OF = {"pdo": 2, "mysqli": 2, "mysqli_connect": 2, "mysql_connect": 2, "ftp_login": 2, "createhmac": 1, "hash_hmac": 2, "createcipheriv": 1, "createdecipheriv": 1, "openssl_encrypt": 2, "openssl_decrypt": 2, "jwt.sign": 1, "jwt.verify": 1, "jwt::encode": 1, "jwt::decode": 1, "hmac.new": 0}
_ALONE = re.compile(r"_?(?:login|log_in|signin|sign_in|authenticate|auth|setCredentials|withCredentials|basicAuth)\Z", re.I)
_VAGUE = re.compile(r"(?:sign|verify|new\w*(?:Pool|Session))\Z", re.I)
_LOGIN_CUES = ("login", "access:", "zugang", "account", "konto", "connect", "pdo", "mysqli", "client", "signin", "sign_in", "auth", "user", "credential")
_KEYED_CUES = ("hmac", "cipher", "openssl_", "jwt")
_ALGORITHM = re.compile(r"(?:sha|aes|md|hs|rs|es|des)-?\d", re.I)
_NOTE = re.compile(r"(?:login|log in|credentials?|zugang\w*|access|sign in|account|acceso|acc[eè]s|acesso|anmeldung)\b", re.I)
_NOTE_IS = re.compile(r"[:=]")
_NOTE_PAIR = re.compile(r"(?:\b\w[\w.@-]*\s*[/|]\s*(\S+))|(?:\b(?:key|password|passwd|pass|pw|pwd|token|secret|passwort|kennwort|clave|contrase\w+|senha|mot de passe|schl[uü]ssel|code|pin)\b\s*[:=]?\s*(?:is\s+)?(\S+))", re.I)

_ASSIGN = re.compile(
    r"[\"'`\])]*[ \t]*(?:\?[ \t]*)?(?:"
    r"(?::[ \t]*(?:string|any|unknown|String|[A-Z][a-z]+)(?:\[\])?(?:[ \t]*\|[ \t]*\w+)*(?=[ \t]*=(?!=)))?[ \t]*(===?|!==?|=>|:=|\?\?=|\|\|=|=(?![=>~]))"  # 1
    r"|(:)(?!:)"  # 2
    r"|(\s*,)"  # 3 an argument
    r"|(>)"  # 4 an element's content
    r"|(\"?\s+value\s*=)"  # 5
    r"|(\s*\|)"  # 6 table cell
    r")[ \t]*"
)
_PLACEHOLDER = re.compile(
    r"(?:your|my|insert|enter|some|sample|example|demo|fake|dummy|placeholder|change|replace|todo|fixme|tbd|xxx|null|none|nil|undefined|true|false|yes|no|on|off|redacted|hidden|masked|optional|required|empty|default|n/?a)(?:[-_ ./].*|me\b.*|this.*|it.*|\d*)?\Z"
    r"|.*(?:your[-_ ]|[-_ ]here\b|change[-_ ]?me|change[-_ ]?it|placeholder|example[-_ ]?(?:key|token|secret|password)|<[^>]*>|\$\{|\{\{|\$\(|%\(|%[A-Z_]+%|@@|#\{).*"
    r"|[x*.#•_-]{3,}\Z|\$[A-Za-z_]\w*\Z|(?:env|vault|secret|secrets|ref|file|ssm|arn|op|kms|keyring|sops|gcp|aws|config)[:.].*|@\w+\Z|\[.*\]\Z|<.*|test|password|passwd|secret|token|key|changeit",
    re.I | re.S,
)
_KEY_RUN = re.compile(r"[A-Za-z0-9+/=]{16,}")
_KEY_BODY = re.compile(r"(?:\\[nr]|[A-Za-z0-9+/=\s\"'+.,:-])*")
_UPPER_NAME = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\Z")
_PLACE = re.compile(r"(?:\.{1,2}/|/[\w.-]+(?:/[\w.-]+)*/?\Z|~/|[A-Za-z]:\\)|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?::\d+)?\Z|[\w.+-]+@[\w-]+\.[\w.]+\Z|[a-z][a-z+.-]*://")
_ID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z|(?:sha\d+|md5)[-:]", re.I)


def _finder():
    try:
        import ahocorasick
    except ImportError:
        pattern = re.compile("|".join(map(re.escape, sorted(CUES, key=len, reverse=True))))
        return lambda low: [(m.start(), m.group()) for m in pattern.finditer(low)]
    automaton = ahocorasick.Automaton()
    for w in CUES:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return lambda low: [(end - len(w) + 1, w) for end, w in automaton.iter(low)]


_cues = _finder()


def named(name: str) -> int:
    """2: the name says that it holds a credential, 1: it may, 0: it does not."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    while parts and (parts[-1].isdigit() or parts[-1] in NEUTRAL):
        parts.pop()
    if not parts:
        return 0
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last[-1] == "s" and (last[:-1] in STRONG or last in ("keys", "tokens")):
        last = last[:-1]
    if before == "public" or "min" in parts or "max" in parts:
        return 0
    if last in STRONG or before + last in STRONG or "".join(parts[-3:]) == "motdepasse":
        if last == "pass" and len(parts) == 1 or last == "pin" or last == "clave":
            return 1
        return 2
    if last == "key":
        return 2 if before in WEAK_KEY else 0
    if last == "token":
        return 2 if before in TOKEN_KIND or len(parts) == 1 else 1
    if last in ("auth", "authorization"):
        return 1
    return 0


def secret_like(value: str, trust: int) -> bool:
    """May this be a value that grants access? ``trust`` is what its name tells."""
    v = value.strip()
    if len(v) < 6 or (_PLACEHOLDER.match(v) or _UPPER_NAME.match(v)) and not _PREFIXED.match(v):
        return False
    if any(c.isspace() for c in v):
        h = _HEADER.match(v)
        return bool(h and secret_like(h[1], 2))
    if _PREFIXED.match(v):
        return True
    if _PLACE.match(v) and not re.search(r"[!*=?~^]", v) or _ID.match(v):
        return False
    letters, digits = any(c.isalpha() for c in v), any(c.isdigit() for c in v)
    upper, lower = any(c.isupper() for c in v), any(c.islower() for c in v)
    marks = any(not c.isalnum() for c in v)
    if not letters or re.search(r"[(){}\[\];<>]", v) and not digits:
        return False
    kinds = digits + upper + lower + (marks and not re.fullmatch(r"[\w.-]+", v))
    if trust >= 2:
        return digits or kinds >= 3 or len(v) >= 16 and upper and lower or len(v) >= 24 and not marks
    return digits and (kinds >= 3 or len(v) >= 10) or len(v) >= 20 and upper and lower


def _expression(tokens: Tokens, i: int, walked: dict[int, tuple[list, int, int, int]]) -> list[tuple[int, int, str, str]]:
    """The string literals of the expression whose first token is ``i``, to its end: (start, end,
    content, name of the call or the index that holds it). ``walked`` keeps what every bracket held
    (literals from, to, token after it or -1 if the expression ends within), so that none is read again
    for the names inside it."""
    n, text = len(tokens), tokens.text
    out: list[tuple[int, int, str, str]] = []
    opened: list[tuple[int, int]] = []
    calls: list[str] = []
    word, last = "", tokens.value(i - 1)[-1:] if 0 < i <= n else ""
    first = i
    while i < n:
        kind = tokens.kind[i]
        c = tokens.value(i) if kind == OPERATOR else ""
        if not opened and i > first and kind != COMMENT and last not in ("=", "+", "?", "|", ":", "(", ",", ".", "&") and c[:1] not in ("+", "?", "|", ".") and tokens.fresh(i):
            break  # goes on only if an operator ends this line or begins the next
        if kind == STRING:
            out.append((tokens.a[i], tokens.b[i], text[tokens.a[i] : tokens.b[i]], calls[-1] if calls else ""))
            word, last = "", '"'
            if not opened and not (i + 1 < n and tokens.kind[i + 1] == OPERATOR and tokens.value(i + 1)[0] in "+.?|&"):
                break
        elif kind in (NAME, NUMBER):
            word = tokens.value(i)
            last = word[-1]
        elif kind == OPERATOR:
            if c in ("(", "[", "{"):
                if c == "{" and not opened:
                    break
                if i in walked:
                    literals, a, b, after = walked[i]
                    out += literals[a:b]
                    if after < 0:
                        break
                    i, word, last = after, "", ")"
                    continue
                calls.append(word if c == "(" else "[" + word if c == "[" and word else "")
                opened.append((i, len(out)))
            elif c in (")", "]", "}"):
                if not opened:
                    break
                calls.pop()
                place, a = opened.pop()
                walked[place] = out, a, len(out), i + 1
                word = ""
            elif c == ";" or c == "," and not opened:
                break
            else:
                word = ""
            last = c[-1]
        i += 1
    for place, a in opened:
        walked[place] = out, a, len(out), -1
    return out


class _Frame:
    """An open bracket of an argument list: ``call`` is the call whose arguments it holds, if any;
    ``first``: nothing but first places lead from there to here."""

    __slots__ = ("bracket", "call", "index", "first", "filled", "key", "word", "literals")

    def __init__(self, bracket: str, call: str, first: bool):
        self.bracket, self.call, self.first = bracket, call, first
        self.index, self.filled, self.key, self.word = 0, False, "", ""
        self.literals: list[tuple[int, int, int, bool, str, str]] | None = None


def _arguments(tokens: Tokens, openings: dict[int, str], done: set[int]) -> Iterator[tuple[str, int, list[tuple[int, int, int, bool, str, str]]]]:
    """(call, number of arguments, literals) of each call whose bracket is among the tokens and in
    ``openings`` (place: name), each to its closing bracket, over any number of lines. A literal is
    (start, end, argument it stands in, whether it begins that argument list, key, call that holds
    it). One pass; ``done`` takes the places met."""
    n = len(tokens)
    for place in sorted(openings):
        i = tokens.at(place)
        if place in done or i >= n or tokens.start[i] != place or tokens.kind[i] != OPERATOR:
            continue
        stack: list[_Frame] = []
        owners: list[_Frame] = []
        word = ""
        while i < n:
            kind, at = tokens.kind[i], tokens.start[i]
            top = stack[-1] if stack else None
            c = tokens.value(i) if kind in (OPERATOR, NAME, NUMBER) else ""
            i += 1
            if kind == STRING:
                following = tokens.value(i) if i < n and tokens.kind[i] == OPERATOR else ""
                if following in ("=>", ":") and top.bracket in "{[":
                    top.key, top.word = tokens.text[tokens.a[i - 1] : tokens.b[i - 1]], ""
                elif top.call and owners:
                    owners[-1].literals.append((tokens.a[i - 1], tokens.b[i - 1], owners[-1].index, top.first and not top.index, top.key if top.key or top.bracket != "{" else "?", "" if top is owners[-1] else top.call))
                top.filled, word = True, ""
            elif kind == PIECE:
                top.filled = True
            elif kind in (NAME, NUMBER):
                top.word = "" if top.filled else c
                top.filled, word = True, c
            elif c in ("(", "[", "{"):
                f = _Frame(c, "", False)
                if at in openings:
                    done.add(at)
                    f.call, f.first, f.literals = openings[at], True, []
                    owners.append(f)
                elif top and top.call and not (c == "(" and LOOKUPS.match(word)) and not (c == "[" and word) and not (top.bracket == "{" and c != "{"):
                    f.call, f.first = word if c == "(" and word else top.call, top.first and not top.index
                if top:
                    top.filled = True
                stack.append(f)
                word = ""
            elif c in (")", "]", "}") or c == ";" and top.bracket != "{" and not (top.bracket == "(" and top.word == "for"):
                opens = {")": "(", "]": "[", "}": "{", ";": "{"}[c]
                while stack and (c == ";" and stack[-1].bracket != "{" or c != ";"):
                    f = stack.pop()
                    if f.literals is not None:
                        owners.pop()
                        yield f.call, f.index + f.filled, f.literals
                    if f.bracket == opens:
                        break
                word = ""
                if not stack:
                    break
            elif c == ",":
                top.index, top.filled, top.key, top.word, word = top.index + 1, False, "", "", ""
            elif c in (":", "=", "=>"):
                if top.word:
                    top.key, top.word = top.word, ""
                word = ""
            elif c[:1] in ("=", "!") and c:
                top.word = word = ""
        for f in reversed(owners):  # the text ends within
            yield f.call, f.index + f.filled, f.literals


class _Reading:
    """The tokens of one text, and of the insides of its literals and comments as they are asked for."""

    def __init__(self, text: str, ending: str):
        self.text, self.family = text, FAMILIES.get(ending, "plain")
        self._inner: dict[int, Tokens] = {}
        self._head = self._tail = self._said = 0

    @cached_property
    def tokens(self) -> Tokens:
        return lex(self.text, self.family)

    @cached_property
    def comments(self) -> list[tuple[int, int]]:
        return groups(self.tokens)

    @cached_property
    def _breaks(self) -> list[int]:
        return [-1, *(m.start() for m in re.finditer("\n", self.text))]

    @cached_property
    def _inside(self) -> str:
        return literal_text(self.tokens) if self.family in ("c", "php") else self.text

    def forms(self, pattern: re.Pattern) -> Iterator[re.Match]:
        """Matches inside literals and comments, or anywhere where values need no quotes."""
        return pattern.finditer(self._inside) if pattern.search(self.text) else iter(())

    def credential_name(self, place: int) -> int:
        """What the name around a place tells, read without tokens."""
        if self._head <= place < self._tail:
            return self._said
        head = place
        while head and ((c := self.text[head - 1]).isalnum() or c in "_$.-"):
            head -= 1
        self._head, self._tail = head, _NAME_TAIL.match(self.text, place).end()
        self._said = named(self.text[head : self._tail].rsplit(".", 1)[-1])
        return self._said

    def line(self, place: int) -> int:
        """Where the line of a place begins."""
        return self._breaks[bisect_left(self._breaks, place) - 1] + 1

    def comment(self, place: int) -> tuple[int, int] | None:
        k = bisect_right(self.comments, (place, len(self.text) + 1)) - 1
        return self.comments[k] if k >= 0 and place < self.comments[k][1] else None

    def around(self, place: int) -> Tokens:
        """The tokens among which a place stands: those of the comment or literal that holds it, else
        the text's own."""
        tokens = self.tokens
        while True:
            i = tokens.at(place)
            if i >= len(tokens) or tokens.kind[i] not in (COMMENT, STRING, PIECE, TEXT) or not tokens.a[i] <= place < tokens.b[i]:
                return tokens
            a, b = self.comment(place) if tokens is self.tokens and tokens.kind[i] == COMMENT else (tokens.a[i], tokens.b[i])
            if a not in self._inner:
                self._inner[a] = lex(self.text, self.family, a, b, inner=True)
            tokens = self._inner[a]

    def says_auth(self, place: int) -> bool:
        """Does the name before a literal, or the line before a place in one, speak of authorization?"""
        i = self.tokens.at(place)
        if self.family in ("c", "php") and 0 < i < len(self.tokens):
            return any("auth" in self.tokens.value(j).lower() for j in range(max(0, i - 3), i)) or "auth" in self.text[self.tokens.a[i] : place].lower()
        return "auth" in self.text[self.line(place) : place].lower()

    def name(self, place: int) -> tuple[int, int]:
        """(start, end) of the name that holds a place."""
        i = self.tokens.at(place)
        if self.family in ("c", "php") and i < len(self.tokens) and self.tokens.kind[i] == NAME and self.tokens.start[i] <= place:
            return self.tokens.start[i], self.tokens.end[i]
        low = self.tokens.a[i] if i < len(self.tokens) and self.tokens.start[i] <= place and self.tokens.kind[i] != NAME else 0
        head = place
        while head > low and ((c := self.text[head - 1]).isalnum() or c in "_$.-"):
            head -= 1
        return head, _NAME_TAIL.match(self.text, place).end()


def _passed(reading: _Reading, low: str, cues: list[tuple[int, str]], has: set[str]) -> Iterator[tuple[int, int]]:
    """The credentials passed to login calls (by place, else by what the value looks like; not the
    first of several arguments, which is a user or a host) and to calls that take a key."""
    text = reading.text
    openings: dict[int, str] = {}
    keyed: set[str] = set()
    lines: dict[tuple[str, ...], set[int]] = {}

    def cued(place: int, words: tuple[str, ...]) -> bool:
        if words not in lines:
            lines[words] = {reading.line(p) for p, w in cues if w in words}
        return reading.line(place) in lines[words]

    for pattern, words in ((_LOGIN_CALL, _LOGIN_CUES), (_KEYED_CALL, _KEYED_CUES)):
        if not has.isdisjoint(words) or pattern is _LOGIN_CALL and "log_in" in low:
            for m in pattern.finditer(text):
                call = re.sub(r"\s+", "", m.group()[:-1])
                if not _VAGUE.match(call) or cued(m.start(), words):
                    openings[m.end() - 1] = call
                    if pattern is _KEYED_CALL:
                        keyed.add(call)
    by: dict[int, tuple[Tokens, dict[int, str]]] = {}
    for place, call in openings.items():
        tokens = reading.around(place)
        by.setdefault(id(tokens), (tokens, {}))[1][place] = call
    for call, n, literals in (x for tokens, some in by.values() for x in _arguments(tokens, some, set())):
        place = _PLACE_OF.get(call.lower().lstrip("_"))
        for s, e, index, first, key, inner in literals:
            v = text[s:e]
            if key:
                if named(key) and secret_like(v, 2):
                    yield s, e
            elif call in keyed:
                if (place is None or index == place) and secret_like(v, 2) and not _ALGORITHM.match(v):
                    yield s, e
            elif place is not None and n > 1:
                if index == place and secret_like(v, 2):
                    yield s, e
            elif n > 1 or not first:
                if not first and secret_like(v, 2):
                    yield s, e
            elif "://" not in v and secret_like(v, 2) and (_ALONE.match(call) or not re.search(r"[=;:/]", v) and any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)):
                yield s, e


def _decoded(value: str) -> str:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return ""


#: Formats whose values may stand without quotes.
BARE = frozenset("yaml yml ini conf npmrc toml sh bash env md mdx dockerfile properties cfg txt envrc editorconfig".split())


def spans(text: str, ending: str = "") -> list[tuple[int, int, str]]:
    """(start, end, kind) of the credentials in a text, in order, without overlaps."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    done_names: set[int] = set()
    lines_noted: set[int] = set()
    walked: dict[int, dict[int, tuple[list, int, int, int]]] = {}
    cues = _cues(low)
    has = {w for _, w in cues}
    if not has and not any(x in text for x in _PREFIXES) and ending not in BARE and ending not in ("json", "xml"):
        return []
    reading = _Reading(text, ending)
    if "begin " in has:
        stop = 0
        ends = [m.span() for m in _KEY_BLOCK_END.finditer(text)]
        for m in _KEY_BLOCK.finditer(text):
            if m.start() < stop:
                continue  # within the block before
            k = bisect_left(ends, (m.end(), 0))
            body, after = ends[k] if k < len(ends) else [_KEY_BODY.match(text, m.end()).end()] * 2
            if _KEY_RUN.search(text, m.end(), body):
                stop = after
                found.append((m.start(), stop, "key block"))
    for m in reading.forms(_PREFIXED) if any(x in text for x in _PREFIXES) else ():
        if not _PLACEHOLDER.match(m.group()[4:]) and len(set(m.group()[4:])) > 5:
            found.append((m.start(), m.end(), "prefixed token"))
    if "://" in has:
        for m in reading.forms(_URL):
            password = m[2]
            if not _PLACEHOLDER.match(password) and not re.match(r"[${<%*]|:", password) and len(password) > 2 and not re.fullmatch(r"(?:password|passwd|pass|secret|user|x+)", password, re.I):
                found.append((m.start(2), m.end(2), "url"))
        for m in reading.forms(_PARAMETER):
            if secret_like(m[1], 2) and not re.match(r"[${<%]", m[1]):
                found.append((m.start(1), m.end(1), "url parameter"))
    if "bearer " in has or "basic " in has or "token" in has:
        for m in reading.forms(_HEADER):
            v = m[1]
            if m.group()[:5] == "Token" and not reading.says_auth(m.start()):
                continue
            if not _PLACEHOLDER.match(v) and (any(c.isdigit() for c in v) and any(c.isalpha() for c in v) or ":" in _decoded(v)) and secret_like(v, 2):
                found.append((m.start(1), m.end(1), "header"))
    if "-u " in has or "user" in has:
        for m in reading.forms(_FLAG):
            if not _PLACEHOLDER.match(m[2]) and m[2][0] not in "$<{":
                found.append((m.start(2), m.end(2), "command option"))
    for m in reading.forms(_OPTION) if " -" in text else ():
        if secret_like(m[2], 2) and m[2][0] not in "$<{":
            found.append((m.start(2), m.end(2), "command option"))
    for m in _ENCODED.finditer(text) if ending in BARE or ending in ("json", "xml", "conf") else ():
        plain = _decoded(m[1])
        if len(m[1]) % 4 == 0 and plain.isprintable() and secret_like(plain.rsplit(":", 1)[-1], 2):
            found.append((m.start(1), m.end(1), "encoded"))
    found += [(s, e, "argument") for s, e in _passed(reading, low, cues, has)]
    for place, word in cues:
        if word in ("://", "begin ", "bearer ", "basic ", "-u "):
            continue
        line = reading.line(place)
        if word in _LOGIN_CUES and line not in lines_noted:
            lines_noted.add(line)
            end = text.find("\n", line)
            comment = None
            if _NOTE.search(text, line, end if end >= 0 else len(text)) and ((comment := reading.comment(place)) or ending in ("md", "mdx", "txt")):
                end = text.find("\n", line)
                begin, end = line, end if end >= 0 else len(text)
                if comment:
                    begin, end = max(begin, comment[0]), min(end, comment[1])
                note = _NOTE.search(text, begin, end)
                said = _NOTE_IS.search(text, note.end(), end) if note else None
                for p in _NOTE_PAIR.finditer(text, said.end(), end) if said else ():
                    k = p.lastindex
                    v = p[k].rstrip(".,;)'\"`*/").lstrip("('\"`")
                    at = p.start(k) + p[k].find(v)
                    if v and secret_like(v, 2):
                        found.append((at, at + len(v), "note"))
                        break
        if not reading.credential_name(place):
            continue
        comment = reading.comment(place)
        head, tail = reading.name(place)
        if head in done_names:
            continue
        done_names.add(head)
        name = text[head:tail].rsplit(".", 1)[-1]
        trust = named(name)
        if not trust:
            continue
        a = _ASSIGN.match(text, tail)
        if not a:
            continue
        kind, at = a.lastindex, a.end()
        if kind == 3 and (text[tail : tail + 1] not in ("'", '"') or text[line : max(line, head - 1)].rstrip()[-1:] not in ("(", "[")):
            continue  # not a name passed first, with its value after it
        if kind == 4 and text[head - 1 : head] != "<":
            continue
        if kind == 6 and not text[line:head].lstrip().startswith("|"):
            continue
        if kind == 2 and text[tail : tail + 1] == "?" and ending in ("ts", "tsx"):
            continue
        if kind == 4:
            end = text.find("<", at)
            if end > at and secret_like(text[at:end], trust):
                v = text[at:end]
                found.append((at + len(v) - len(v.lstrip()), at + len(v.rstrip()), "element"))
            continue
        if kind == 6:
            end = text.find("|", at)
            v = text[at : end if end > 0 else at]
            core = v.strip().strip("`'\"")
            if core and secret_like(core, trust):
                s = at + v.find(core)
                found.append((s, s + len(core), "table"))
            continue
        quote = text[head - 1 : head]
        if kind == 1 and quote in ("'", '"') and text[tail : tail + 1] == "=":  # a setting inside one literal
            end = text.find(quote, at)
            v = text[at : end if end >= 0 else at]
            if "\n" not in v and secret_like(v, trust):
                h = _HEADER.match(v)
                found.append((at + (h.start(1) if h else 0), end, "value"))
            continue
        nl = text.find("\n", at)
        rest = text[at : nl if nl >= 0 else len(text)].rstrip("\r")
        if ending in ("yaml", "yml") and re.fullmatch(r"[|>][+-]?\d?\s*(?:#.*)?", rest):
            indent = len(text[line:]) - len(text[line:].lstrip(" "))
            block = []
            p = nl + 1
            while 0 < p < len(text):
                e = text.find("\n", p)
                e = len(text) if e < 0 else e
                row = text[p:e]
                if row.strip() and len(row) - len(row.lstrip(" ")) <= indent:
                    break
                if row.strip():
                    block.append((p + len(row) - len(row.lstrip()), p + len(row.rstrip()), row.strip()))
                p = e + 1
            joined = "".join(b[2] for b in block)
            if block and (secret_like(joined, trust) or len(block) > 1 and secret_like(block[0][2], trust)) and not joined.startswith("-----BEGIN"):
                found.append((block[0][0], block[-1][1], "block"))
            continue
        if ending in BARE and not rest.strip():
            continue
        first = rest[:1]
        remark = first not in "'\"`[{(" and kind in (1, 2) and comment is not None
        if remark:
            v = rest.split()[0].rstrip(".,;)'\"`*/") if rest.split() else ""
            if secret_like(v, trust):
                found.append((at, at + len(v), "note"))
            continue
        if ending in BARE and first not in "'\"`[{(" and rest and not re.match(r"[\w$.]+\(", rest):
            v = re.split(r"\s[#;]|(?<=\s)//", rest, maxsplit=1)[0].strip() if ending not in ("md", "mdx") else rest.strip().strip("`").split("`")[0]
            v = v.rstrip("\"'`,") if not v.startswith(("'", '"')) else v
            if v and secret_like(v, trust):
                h = _HEADER.match(v)
                s = at + rest.find(v) + (h.start(1) if h else 0)
                found.append((s, at + rest.find(v) + len(v), "value"))
            continue
        if first not in "'\"`" and kind in (2, 1) and ending in ("xml",):
            continue
        tokens = reading.around(at)
        literals = _expression(tokens, tokens.at(at), walked.setdefault(id(tokens), {}))
        usable = []
        for s, e, v, call in literals:
            if call and (LOOKUPS.match(call) or call.startswith("[")):
                continue
            if call == "from" and v.lower() in ("base64", "hex", "utf8", "utf-8", "ascii", "latin1"):
                continue
            if not v or _UPPER_NAME.match(v):
                continue
            usable.append((s, e, v))
        if not usable:
            continue
        joined = "".join(v for _, _, v in usable)
        single = [u for u in usable if secret_like(u[2], trust)]
        if "-----BEGIN" in joined:
            continue
        if len(usable) > 1 and secret_like(joined, trust) and all(re.fullmatch(r"[\w+/=~!@#$%^&*.-]+", v) for _, _, v in usable) and not re.search(r"\?\?|\|\||\?", text[usable[0][1] : usable[-1][0]]):
            for s, e, v in usable:
                found.append((s, e, "parts"))
            continue
        for s, e, v in single:
            if "${" in v:
                continue
            h = _HEADER.match(v)
            found.append((s + h.start(1) if h else s, e, "literal"))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for s, e, k in found:
        if s < e and (not out or s >= out[-1][1]):
            out.append((s, e, k))
    return out


def begins(text: str, places: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of the parts of one credential only the first: where the credential begins."""
    out: list[tuple[int, int, str]] = []
    last_part = -1
    for s, e, k in places:
        joined = k == "parts" and 0 <= last_part and re.fullmatch(r"['\"`\s,+.]*", text[last_part:s])
        last_part = e
        if not joined:
            out.append((s, e, k))
    return out


_ESCAPE = re.compile(r"\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|%[0-9a-fA-F]{2}|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);|(\\[\s\S])|[^\s'\"`\\<>{}\[\]()$,;:#&|@/]")


def redact(text: str, places: list[tuple[int, int, str]]) -> str:
    """The text with the characters of each credential replaced, at equal length: letters, digits and
    coded characters (``\\u0041``, ``\\x41``, ``\\101``, ``%41``, ``&amp;``) become as many ``x``; line
    breaks, white space, other escapes, quotes and brackets stay, and so do the opening and closing
    lines of key blocks."""
    out, at = [], 0
    for s, e, kind in places:
        if kind == "key block":
            s, whole = _KEY_BLOCK.match(text, s).end(), e
            close = [m.start() for m in _KEY_BLOCK_END.finditer(text, s, whole)]
            e = close[-1] if close else whole
        out.append(text[at:s])
        out.append(_ESCAPE.sub(lambda m: m[1] or "x" * len(m.group()), text[s:e]))
        at = e
    out.append(text[at:])
    return "".join(out)


def find_credentials(chunks: DataFrame, row: str = "chunk_row", file: str = "file", code: str = "code") -> DataFrame:
    """``row``, ``line_no`` (from 1), ``start`` and ``end`` (code points of the value in the text) and
    ``kind``: one row for each credential, at its first part.

    Null and empty code give no rows, and so does code without credentials; a null file counts as a
    file of unknown kind. Repeated rows are each searched. Each text is read whole, where it lies.
    """
    kind = dict(chunks.dtypes)[row]
    names = [row, "line_no", "start", "end", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (f, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                places = spans(text, _ending(f)) if text else ()
                rows.extend((i, text.count("\n", 0, s) + 1, s, e, k) for s, e, k in begins(text, places)) if places else None
            at, *rest = zip(*rows) if rows else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, types))], names=names)

    return chunks.select(F.col(row), F.col(file).alias("__file"), F.col(code).alias("__code")).where(F.length("__code") > 0).mapInArrow(run, f"`{row}` {kind}, line_no bigint, start bigint, end bigint, kind string")


def redact_credentials(chunks: DataFrame, row: str = "chunk_row", file: str = "file", code: str = "code") -> DataFrame:
    """``row``, ``code`` with every credential's characters replaced, and ``redacted``, how many were;
    one row for each row of ``chunks``. Null code stays null, code without credentials as it is."""
    kind = dict(chunks.dtypes)[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for f, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                places = spans(text, _ending(f)) if text else []
                texts.append(redact(text, places) if places else text)
                counts.append(len(places))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[row, "code", "redacted"])

    return chunks.select(F.col(row), F.col(file).alias("__file"), F.col(code).alias("__code")).mapInArrow(run, f"`{row}` {kind}, code string, redacted int")


def _ending(file: str | None) -> str:
    return re.split(r"[\\/.]", file)[-1].lower() if file else ""
