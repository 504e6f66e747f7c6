"""Credentials embedded in texts: finding and redacting their literals.

A text is split into tokens (``lexing``), and string literals that are assigned
or passed to a credential-named word or key are bound to it, over line breaks,
comments, types and wrapping calls (``api_key = (\n "..."``, ``WithAccessKey("...")``,
``{"password": "..."}``, also with escaped quotes within another string, and
block scalars).  Where a text isn't code, forms of lines tell the rest: unquoted
values and prose (``--bot-token ...``, ``the password is ...``), the login part or
a token parameter of a URL, connection strings and authorisation headers.
Private key blocks and known forms of tokens count anywhere.  Placeholders,
references to other places, digests, public keys, ids and labels don't count.

Redaction replaces the inside of a literal only; quotes, escapes, indents and
line breaks around and inside it stay.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._texts import per_row
from .lexing import BLOCK, COMMENT, LINE, OPERATOR, STRING, WORD, Token, tokens

# --- Names -----------------------------------------------------------------

# The endings of credential names, in words.
PASSWORD_NAMES = ("password", "passwd", "pwd", "passphrase", "passcode", "kennwort", "passwort", "pass", "pw", "psw", "contrasena", "mot de passe", "motdepasse")
TOKEN_NAMES = ("token", "bearer", "jwt", "authtoken", "accesstoken", "sessiontoken", "refreshtoken", "deploytoken", "bottoken", "sigtoken", "pat")
KEY_NAMES = (
    "api key", "apikey", "access key", "accesskey", "secret key", "secretkey", "service key", "servicekey", "signing key", "signingkey", "signing secret", "signingsecret", "client secret", "clientsecret", "app secret", "appsecret", "map key", "mapkey",
    "shared key", "sharedkey", "account key", "accountkey", "storage key", "storagekey", "encryption key", "encryptionkey", "master key", "masterkey", "license key", "auth key", "authkey", "webhook secret", "hmac secret", "secret", "secrets", "key", "private key", "privatekey", "signature", "sig", "credential", "credentials",
)
#: Short endings that also count when grown together with a word before, and words that end so by chance.
GLUED = ("pwd", "pass")
CHANCE = ("bypass", "compass", "encompass", "surpass", "trespass", "underpass", "overpass", "impasse")
#: Endings that need a value of random look, as they are common as plain names.
WEAK_NAMES = ("key", "sig", "signature", "pass", "pw", "pat", "token", "credential", "credentials", "secret", "secrets", "private key", "privatekey")
#: Words before the ending that make it something else.
HARMLESS_BEFORE = ("public", "primary", "foreign", "cache", "sort", "partition", "unique", "group", "row", "map reduce", "object", "index", "sort by", "csrf", "next page", "page", "continuation")

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_SPLIT = re.compile(r"[^A-Za-z]+")


@lru_cache(maxsize=200_000)
def name_kind(name: str) -> tuple[str, bool] | None:
    """(kind, weak) of a credential name, else None.

    Trailing digits are ignored; a name that ends in another word
    (``password_label``, ``token_kind``, ``key_id``) is none.
    """
    words = [w for part in _SPLIT.split(name) if part for w in _CAMEL.split(part)]
    words = [w.lower() for w in words if w]
    if not words:
        return None
    tail = " ".join(words[-3:])
    for kind, names in (("password", PASSWORD_NAMES), ("token", TOKEN_NAMES), ("api_key", KEY_NAMES)):
        best = ""
        for n in names:
            if (tail == n or tail.endswith(" " + n) or (len(words[-1]) > len(n) and (len(n) >= 5 or n in GLUED) and words[-1] not in CHANCE and words[-1].endswith(n.replace(" ", "")))) and len(n) > len(best):
                best = n
        if best:
            before = tail[: len(tail) - len(best)].strip()
            if before.endswith(HARMLESS_BEFORE):
                return None
            return kind, best in WEAK_NAMES
    return None


# --- Values ----------------------------------------------------------------

# Words and forms of values that stand for a secret that isn't there.
_PLACEHOLDER = re.compile(
    r"""(?xi)
    ^[\W_]*$ | ^(.)\1*$ | [<>] | \.\.\. | … | \*{3} | x{4} | ^\$ | \$\{ | \$\( | \{\{ | \}\} | ^%[({\w] .* [)}%s]$ | ^@\w+@$ | ^\#\{ | ^__\w+__$
    | \b(change[-_ ]?(me|it|this) | placeholder | dummy | redacted | todo | fixme)\b | \byour[-_ ] | ^your | ^example | example$ | ^(my|the|some|a)[-_ ]?(secret|password|token|api[-_]?key|key)$ | ^redacted | ^replace[-_ ]?(me|with|this) | ^insert[-_ ] | ^fill[-_ ]?(me|in)
    | ^(none|null|nil|true|false|undefined|empty|default|secret|password|passwort|kennwort|passwd|token|key|apikey|api[-_]key|test|sample|demo|foo|bar|baz|string|str|value|username|user|email|login|unset|required|optional|hidden|masked|n/?a)$
    | ^(os\.|process\.env|env[.:(]|getenv|system\.getenv|import\.meta|config[.\[(]|settings[.\[(]|secrets?[.:/]|vault[:/.]|ssm[:/]|arn:|op://|ref\+|file:|kms:|keyring:|/run/secrets|/etc/|/var/|\./|~/|!ref|!vault|secretsmanager)
    """
)
_NO_SECRET = re.compile(r"(?i)^(?:sha(?:1|224|256|384|512)[-:]|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)|-----BEGIN (?:\w+ )*(?:PUBLIC KEY|CERTIFICATE)")


def is_placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value))


def looks_random(value: str) -> bool:
    """Long enough, without blanks, letters and digits mixed."""
    return len(value) >= 12 and not re.search(r"\s", value) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


# Words of messages about passwords, which no passphrase is thought to hold.
_MESSAGE = re.compile(r"(?i)\b(?:pass(?:word|wort|phrase|code)s?|kennwort|must|enter|please|bitte|your|required|invalid|incorrect|wrong|missing|characters?|forgot(?:ten)?|change|confirm|should|cannot|can't|not|is|are|the|of|for|to)\b")


def is_passphrase(value: str, weak: bool) -> bool:
    """A quoted password with blanks in one line: four words or a digit or sign within one, and nothing that a message says."""
    words = value.split(" ")
    if weak or not 12 <= len(value) <= 80 or re.search(r"[\r\n\t]|[.?!:]$", value) or "" in words or _MESSAGE.search(value) or is_placeholder(value):
        return False
    return (len(words) >= 4 and all(w.isalpha() for w in words)) or (len(words) >= 2 and any(re.search(r"\d", w) and re.search(r"[A-Za-z]", w) for w in words) and all(re.fullmatch(r"[\w!$%&+*#@~^-]+", w) for w in words))


def is_secret(value: str, kind: str, weak: bool) -> bool:
    if len(value) < 4 or is_placeholder(value) or _NO_SECRET.search(value):
        return False
    if kind == "password":
        # plain numbers and words aren't passwords of weakly named fields
        return not re.search(r"\s", value) and not (weak and not re.search(r"[^a-z]", value)) and not (value.isdigit() and len(value) < 6)
    return looks_random(value)


# --- Lexical patterns ------------------------------------------------------

#: Forms of tokens that count under any name, with their kind.
SHAPES = [
    (re.compile(r"(?<![A-Za-z0-9_-])gh[pousr]_[A-Za-z0-9]{30,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9_-])glt-[A-Za-z0-9]{16,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9_-])xox[abprs]-[A-Za-z0-9-]{16,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "api_key"),
    (re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{30,}"), "api_key"),
    (re.compile(r"(?<![A-Za-z0-9_-])[a-z]{2}_live_[A-Za-z0-9]{16,}"), "api_key"),
    (re.compile(r"(?<![A-Za-z0-9_-])gl(?:pat|dt|rt|ptt|cbt)-[A-Za-z0-9_-]{20,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9_-])github_pat_[A-Za-z0-9_]{40,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9_-])npm_[A-Za-z0-9]{30,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9_-])pypi-[A-Za-z0-9_-]{40,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9_-])hf_[A-Za-z0-9]{30,}"), "token"),
    (re.compile(r"(?<![A-Za-z0-9])ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "api_key"),
    (re.compile(r"(?<![A-Za-z0-9_-])sk-(?:proj-|svcacct-|ant-)?(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{32,}"), "api_key"),
    (re.compile(r"(?<![A-Za-z0-9_.-])SG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{30,}"), "api_key"),
]
_SHAPE_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glt-", "xox", "eyj", "akia", "aiza", "_live_", "glpat-", "gldt-", "glrt-", "glptt-", "glcbt-", "github_pat_", "npm_", "pypi-", "hf_", "asia", "sk-", "sg.")

_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:(?!-----BEGIN).)*?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
_USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:([^\s/\"'`<>@]+)@[\w.\[\-]")
_PARAM = re.compile(r"[?&]([A-Za-z_][\w.-]*)=([^&\s\"'`<>#;)\]},]+)")
_CONNECTION = re.compile(r"(?i)(?<![\w])(?:password|pwd)\s*=\s*([^;\"'`\s]+)\s*(?=;|$|[\"'`\s])")
_BEARER = re.compile(r"(?i)\bbearer\s+([A-Za-z0-9_.~+/=-]{12,})")
_BASIC = re.compile(r"(?i)\bbasic\s+([A-Za-z0-9+/_-]{8,}={0,2})")
_TYPE = r"(?:\s*:\s*[A-Za-z_][\w.\[\]<>| ?]{0,40}?|\s+[A-Za-z_\[\]*][\w.\[\]*]{0,30})?"
_WRAP = r"(?:(?:\[\]byte|String|string|str|bytes|Secret|SecretStr|new\s+\w+|[a-z]{1,2})?\(\s*)?(?:[bBrRfFuU]{1,2}(?=[\"']))?"
_QUOTED = r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`)"
# What may stand between a credential name and its literal; each is matched right behind the name.
_SHUT = r"(?:\\?[\"'`\]*]){0,2}"
_BARE = r"[`*]{0,2}([^\s\"'`<>\\,;(){}\[\]|]+)"
_ASSIGNED = re.compile(_SHUT + _TYPE + r"\s*(?:=>|:=|==?|:|\()\s*" + _WRAP + _QUOTED)
_DEFAULTED = re.compile(r"\\?[\"'`]\s*,\s*" + _WRAP + _QUOTED)
_CALLED = re.compile(r"(?:get|env|environ|default|lookup|set|put|or_else|fetch)\w*\s*\(\s*\\?[\"'`]$")
_BESIDE = re.compile(_SHUT + r"\s+(?:(?:to|is|ist|lautet|was|as)\s+)?" + _QUOTED)
_ATTRIBUTE = re.compile(r"[\"']\s+value\s*=\s*" + _QUOTED)
_EQUALS = re.compile(r"\\?[\"'`]?\s*(?:=|:)\s*" + _BARE)
_FLAG = re.compile(r"[ =]" + _BARE)
_SAID = re.compile(r"[`*\"']{0,2}(?:\s+(?:on|for|of|at|in|auf|für)(?:\s+[\w.-]+){1,4}?)?\s*(?:\s(?:is|ist|lautet|to|was)|:)\s+" + _BARE)
_PLAIN = re.compile(r"\s+" + _BARE)
_ELEMENT = re.compile(r">([^<>\n]+)</")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*(?:-[\w$]+)*")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[ ]$")
_LOGIN = re.compile(r"(?i)\b(?:log-?in|account|credentials?|zugang|creds?)\b[^:\n]{0,60}:\s*[\w.@-]+\s*/\s*" + _BARE)
_ENTRY = re.compile(r"^\s*-?\s*[\"']?name[\"']?\s*:\s*[\"']?([A-Za-z_][\w.-]*)[\"']?,?\s*$")
_ENTRY_VALUE = re.compile(r"^\s*[\"']?value[\"']?\s*:\s*(?:" + _QUOTED + r"|" + _BARE + r")\s*,?\s*$")
_SETTING = re.compile(r"^\s*(?:export\s+)?[\w.\"'-]+\s*[:=]\s*\S+\s*(?:#.*)?$")
_REFERS = re.compile(r"(?i)pass|pwd|secret|token|key|user|config|value|input|args|param|self\.|this\.")

_ELEMENT_OVER = re.compile(r">\s*([^<>\s]+)\s*</")


def _shortest(words: set[str]) -> tuple[str, ...]:
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


#: The last words of all names: a credential name holds one of them. Those of three letters and less that aren't glued to others count as whole words only.
_LAST_WORDS = {n.split()[-1] for n in (*PASSWORD_NAMES, *TOKEN_NAMES, *KEY_NAMES)}
_SHORT_HINTS = tuple(sorted(w for w in _LAST_WORDS if len(w) <= 3 and w not in (*GLUED, "key", "jwt")))
# The other lower-case words, one of which stands on every line where a credential without such a name may begin.
_HINTS = _shortest({w for w in _LAST_WORDS if w not in _SHORT_HINTS} | {"bearer", "basic", "://", "login", "log-in", "account", "credential", "creds", "zugang", *_SHAPE_HINTS})


def _whole_word(text: str, at: int, word: str) -> bool:
    """Whether the word at a place ends a name of several words, by other characters or by its case."""
    end = at + len(word)
    if text[end : end + 1].isascii() and text[end : end + 1].isalpha():
        return False
    own, before = text[at:end], text[at - 1 : at] if at else ""
    joined = before.isascii() and before.isalpha()
    return not joined or own[0].isupper() and (own[1:].islower() or own.isupper() and before.islower())


class Finding(NamedTuple):
    start: int
    end: int
    kind: str


def _basic_secret(word: str) -> bool:
    try:
        plain = base64.b64decode(word + "=" * (-len(word) % 4), altchars=b"-_" if set("-_") & set(word) else None, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, colon, password = plain.partition(":")
    return bool(colon) and bool(user) and bool(password) and not is_placeholder(password)


def _group(m: re.Match, first: int) -> tuple[int, int] | None:
    """Span of the quoted value among three groups from *first*."""
    for g in range(first, first + 3):
        if m.start(g) >= 0:
            return m.span(g)
    return None


_COMPOUND = re.compile(r"(?i)://|\b(?:bearer|basic)\s|(?:password|pwd)\s*=|-----BEGIN|authorization")


# --- Binding literals to names ----------------------------------------------

_NAME_IN_STRING = re.compile(r"[A-Za-z_$][\w$]*(?:[-. ][\w$]+)*")
_ESCAPED = re.compile(r'\\"|\\\'')
# What binds a literal to the name before it, and calls whose second argument is a value for the name in the first.
_BINDS = ("=", ":=", "=>", ":", "==", "??=", "||=", "(")
_LOOKS_UP = re.compile(r"(?i)(?:get|env|environ|default|lookup|set|put|or_else|fetch)\w*$")
_WORDS_BEFORE_NAMES = ("class", "def", "case", "func", "function", "import", "from", "package", "module", "interface", "struct", "enum", "if", "return")
# Calls that stand for the literal they are given, and beginnings of calls that are never given a secret.
_MAKES = ("String", "string", "str", "bytes", "byte", "Secret", "SecretStr", "SecretString", "Text", "Some", "from", "of", "encode", "literal", "Literal", "Ptr", "ptr", "required", "trim", "strip")
_ASKS = re.compile(r"(?i)(?:get|read|ask|prompt|input|load|fetch|find|check|verify|hash|is|has|validate|parse|decode|make|new|gen|generate|create|rotate|revoke|delete|remove|lookup|resolve)(?:_|-|pass$|(?=[A-Z]))")
#: Tokens of a type between a name and its operator, and of calls around a literal, that are passed over at most.
_TYPE_TOKENS, _WRAPPERS = 12, 8


class _Binder:
    """Binds string literals of a token stream to the credential names before them.

    The stream is read as far as it is asked for.
    """

    def __init__(self, text: str, low: int):
        self.text, self.stream = text, []
        self._more = tokens(text, low)

    def _has(self, i: int) -> bool:
        while i >= len(self.stream):
            if (t := next(self._more, None)) is None:
                return False
            self.stream.append(t)
        return i >= 0

    def _is(self, i: int, *marks: str) -> bool:
        return self._has(i) and self.stream[i].kind == OPERATOR and self.text[self.stream[i].start : self.stream[i].end] in marks

    def _past(self, i: int, lines: bool) -> int:
        """The next token that says something, behind line ends (if they may be passed), continued lines and comments."""
        while self._has(i):
            t = self.stream[i]
            if t.kind == LINE and lines or t.kind == OPERATOR and self.text[t.start] == "\\" and t.end > t.start + 1:
                i += 1
            elif t.kind == COMMENT and lines and (self._first(i) or self.text[t.start] in "#/"):
                i += 1
                if self.text[t.start : t.end] == "/*":
                    while self._has(i) and not (self.stream[i].kind == COMMENT and self.text[self.stream[i].start : self.stream[i].end].endswith("*/")):
                        i += 1
                    i += 1
                elif not self._marks_line(i - 1):
                    while self._has(i) and self.stream[i].kind != LINE:
                        i += 1
            else:
                return i
        return i

    def _first(self, i: int) -> bool:
        """Whether a token is the first of its line."""
        return i == 0 or self.stream[i - 1].kind == LINE

    def _marks_line(self, i: int) -> bool:
        """Whether a comment mark begins a line, as in a comment of several lines that holds code."""
        return self._first(i)

    def _typed(self, i: int) -> int:
        """The operator behind a type that follows a name: ``: str =``, ``string =``; *i* if there is none."""
        j = i + 1 if self._is(i, ":") else i
        for _ in range(_TYPE_TOKENS):
            if not self._has(j) or self.stream[j].kind == LINE:
                return i
            if self._is(j, "="):
                return j
            if self.stream[j].kind != WORD and not self._is(j, ".", "[", "]", "<", ">", "|", "?", "*", ",", "!"):
                return i
            j += 1
        return i

    def _literal(self, i: int, lines: bool) -> int | None:
        """The literal that follows, within calls that wrap it."""
        for _ in range(_WRAPPERS):
            i = self._past(i, lines)
            if not self._has(i):
                return None
            t = self.stream[i]
            if t.kind in (STRING, BLOCK):
                return i
            if t.kind == WORD:
                word = self.text[t.start : t.end]
                if self._is(i + 1, "("):
                    if word not in _MAKES and len(word) > 2:
                        return None  # a call that looks something up, or makes another thing of its argument
                elif not self._is(i + 1, ".") and word not in ("new", "await", "byte"):
                    return None
            elif not self._is(i, "(", "[", "]", ".", "&"):
                return None
            i += 1
        return None

    def bound(self, i: int) -> int | None:
        """The token of the literal bound to the name in token *i*."""
        t, quoted = self.stream[i], self.stream[i].kind == STRING
        if not quoted and i and self.stream[i - 1].kind == WORD and self.text[self.stream[i - 1].start : self.stream[i - 1].end] in _WORDS_BEFORE_NAMES:
            return None
        j = i + 1
        while self._is(j, "]", "!", "?"):
            j += 1
        if quoted and self._looked_up(i):
            j = self._past(j, True)
            return self._literal(j + 1, True) if self._is(j, ",") else None
        if quoted and self._is(i - 1, "=") and i > 1 and self.text[self.stream[i - 2].start : self.stream[i - 2].end].lower() in ("key", "name"):
            j = self._past(j, True)
            if self._has(j + 2) and self.text[self.stream[j].start : self.stream[j].end] == "value" and self._is(j + 1, "="):
                return j + 2 if self.stream[j + 2].kind == STRING else None
        j = self._past(self._typed(j), False)
        over = self._past(j, True)
        if not self._is(j, *_BINDS) and self._is(over, "=", ":=", "=>"):
            j = over
        if not self._is(j, *_BINDS) or (self._is(j, "(") and not quoted and _ASKS.match(self.text[t.start : t.end])):
            return None
        if self.stream[j - 1].end < self.stream[j].start - 40:
            return None
        lines = not self._is(j, ":", "==") or quoted
        found = self._literal(j + 1, lines)
        if found is None and self._is(j, ":"):
            # the value of a key may stand on the next line, unless it is a key itself
            found = self._literal(j + 1, True)
            if found is not None and self.stream[found].kind == STRING and "\n" not in self.text[t.end : self.stream[found].start]:
                return None
        if found is None:
            return None
        after = self._past(found + 1, False)
        crossed = "\n" in self.text[t.end : self.stream[found].start] and not self.stream[found].kind == BLOCK
        return None if crossed and self._is(after, ":") else found

    def _looked_up(self, i: int) -> bool:
        """Whether a string is the first argument of a call that looks up or sets its name."""
        j = i - 1
        while j >= 0 and self.stream[j].kind == LINE:
            j -= 1
        return self._is(j, "(") and j > 0 and self.stream[j - 1].kind == WORD and bool(_LOOKS_UP.search(self.text[self.stream[j - 1].start : self.stream[j - 1].end]))

    def found(self, low: int, high: int, add) -> None:
        """Takes the literals of the names that begin from *low* to *high*, and those within strings there."""
        text, i = self.text, -1
        while self._has(i := i + 1) and (t := self.stream[i]).start < high:
            if t.end <= low:
                continue
            if t.kind == STRING:
                if "\\" in text[t.low : t.high]:
                    _escaped(text, t, add)
                if t.high - t.low > 64 or not _NAME_IN_STRING.fullmatch(name := text[t.low : t.high]):
                    continue
            elif t.kind == WORD:
                name = text[t.start : t.end]
            else:
                continue
            named = name_kind(name)
            if named and (t.kind != WORD or self._plain(i, name)) and (at := self.bound(i)) is not None:
                self._take(self.stream[at], named, add)

    def _plain(self, i: int, name: str) -> bool:
        """Whether a word before a name doesn't make it something else (``public key``)."""
        before = self.stream[i - 1] if i else None
        return not before or before.kind != WORD or before.end + 1 != self.stream[i].start or name_kind(f"{self.text[before.start : before.end]} {name}") is not None

    def _take(self, t: Token, named: tuple[str, bool], add) -> None:
        value = self.text[t.low : t.high]
        low, high = t.low, t.high
        if "\n" in value:
            low, high = low + len(value) - len(value.lstrip()), high - len(value) + len(value.rstrip())
            value = self.text[low:high]
        if high > low and not _COMPOUND.search(value) and (is_secret(value, *named) or (named[0] == "password" and t.kind == STRING and is_passphrase(value, named[1]))):
            add(low, high, named[0])


def _escaped(text: str, t: Token, add) -> None:
    """Names and literals in escaped quotes within a string: its quotes are read without their backslashes."""
    inside = text[t.low : t.high]
    marks = [m.start() for m in _ESCAPED.finditer(inside)]
    if len(marks) < 2:
        return
    for quote in ('\\"', "\\'"):
        own = [m for m in marks if inside.startswith(quote, m) and (m == 0 or inside[m - 1] != "\\")]
        for a, b, c, d in zip(own, own[1:], own[2:], own[3:], strict=False):
            name, between = inside[a + 2 : b], inside[b + 2 : c].strip()
            if between in (":", "=", "=>", ",") and _NAME_IN_STRING.fullmatch(name) and (named := name_kind(name)):
                low, high = t.low + c + 2, t.low + d
                if not _COMPOUND.search(text[low:high]) and is_secret(text[low:high], *named):
                    add(low, high, named[0])
        # an assignment or a call before a quoted literal
        for c, d in zip(own, own[1:], strict=False):
            m = _BEFORE_QUOTE.search(inside, max(0, c - 80), c)
            if m and (named := name_kind(m.group(1))) and is_secret(inside[c + 2 : d], *named) and not _COMPOUND.search(inside[c + 2 : d]):
                add(t.low + c + 2, t.low + d, named[0])


_BEFORE_QUOTE = re.compile(r"([A-Za-z_][\w-]*)\s*(?:=|:=|:|\()\s*\Z")


def _elements(text: str, start: int, end: int, add) -> None:
    """XML elements with a credential name, in a line, whose text stands on lines of its own."""
    for m in _TAG.finditer(text, start, end):
        if (named := name_kind(m.group(1))) and (v := _ELEMENT_OVER.match(text, m.end())) and "\n" in v.group() and is_secret(v.group(1), *named) and not _COMPOUND.search(v.group(1)):
            add(*v.span(1), named[0])


_TAG = re.compile(r"<([A-Za-z_][\w.-]*)(?=>\s*\Z)")


def _on_line(line: str, base: int, add) -> None:
    for m in _USERINFO.finditer(line):
        if is_secret(m.group(1), "password", False):
            add(base + m.start(1), base + m.end(1), "password")
    for m in _PARAM.finditer(line):
        named = name_kind(m.group(1))
        if named and is_secret(m.group(2), *named):
            add(base + m.start(2), base + m.end(2), named[0])
    for m in _BASIC.finditer(line):
        if _basic_secret(m.group(1)):
            add(base + m.start(1), base + m.end(1), "password")
    for m in _BEARER.finditer(line):
        if is_secret(m.group(1), "token", True):
            add(base + m.start(1), base + m.end(1), "token")
    if ";" in line:
        for m in _CONNECTION.finditer(line):
            if ";" in line[max(0, m.start() - 1) : m.end() + 1] and is_secret(m.group(1), "password", False):
                add(base + m.start(1), base + m.end(1), "password")

    def take(named: tuple[str, bool], start: int, end: int) -> bool:
        value = line[start:end]
        if _COMPOUND.search(value) or not is_secret(value, *named):
            return False
        add(base + start, base + end, named[0])
        return True

    for m in _IDENT.finditer(line):
        named = name_kind(m.group())
        if not named:
            continue
        start, end = m.span()
        if (before := _WORD_BEFORE.search(line, max(0, start - 24), start)) and name_kind(f"{before.group(1)} {m.group()}") is None:
            continue
        opener = line[max(0, start - 32) : start]
        for pattern in (_ASSIGNED, _BESIDE, *((_DEFAULTED,) if _CALLED.search(opener) else ()), *((_ATTRIBUTE,) if opener.endswith(('key="', 'name="', "key='", "name='")) else ())):
            if (v := pattern.match(line, end)) and take(named, *_group(v, 1)):
                break
        else:
            if opener.endswith("<") and (v := _ELEMENT.match(line, end)):
                take(named, *v.span(1))
            elif opener.endswith("-") and (v := _FLAG.match(line, end)):
                take(named, *v.span(1))
            elif (v := _EQUALS.match(line, end)) and _literal_like(v.group(1), line):
                take(named, *v.span(1))
            else:
                v = _SAID.match(line, end)
                if not v and named[0] == "password" and (v := _PLAIN.match(line, end)) and named[1] and not re.search(r"\d", v.group(1)):
                    v = None  # "the next pass Then"
                if v:
                    s, e = v.span(1)
                    if v.group(1).endswith((".", ":")):
                        e -= 1
                    if len(line[s:e]) >= 6 and re.search(r"\d|[A-Z].*[a-z]|[a-z].*[A-Z]|_", line[s:e]):
                        take(named, s, e)
    for m in _LOGIN.finditer(line):
        if len(m.group(1)) >= 6:
            take(("password", False), *m.span(1))


def _literal_like(value: str, line: str) -> bool:
    """Whether an unquoted value is rather a literal than the name of a variable."""
    if not re.fullmatch(r"[A-Za-z_][\w.]*", value) or re.search(r"\d", value):
        return True
    if _REFERS.search(value):
        return False
    return bool(re.search(r"[A-Z].*[a-z]|[a-z].*[A-Z]", value)) or ("_" in value and bool(_SETTING.match(line)))


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(text: str | None) -> list[Finding]:
    """All credential literals of a text, in order, without overlaps.

    A null or empty text has none.
    """
    if not text:
        return []
    low = _lower(text)
    found: list[Finding] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str) -> None:
        if end > start and not any(s < end and start < e for s, e in taken):
            taken.append((start, end))
            found.append(Finding(start, end, kind))

    if "private key" in low:
        for m in _PRIVATE.finditer(text):
            body = re.sub(r"\\[nrt]|[\s\"'+,\\]", "", m.group(1))
            if len(body) >= 32 and not is_placeholder(body):
                add(m.start(), m.end(), "private_key")
    spans = set()
    for hint in (*_HINTS, *_SHORT_HINTS):
        at = low.find(hint)
        while at >= 0:
            if hint in _SHORT_HINTS and not _whole_word(text, at, hint):
                at = low.find(hint, at + 1)
                continue
            start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            end = len(text) if end < 0 else end
            spans.add((start, end))
            at = low.find(hint, end)
    for start, end in sorted(spans):
        line = text[start:end]
        if any(name_kind(m.group()) for m in _IDENT.finditer(line)) or ("\\" in line and "private" not in low[start:end]):
            # from the line before, where a call may begin
            _Binder(text, text.rfind("\n", 0, max(0, start - 1)) + 1).found(start, end, add)
            if "<" in line:
                _elements(text, start, end, add)
        _on_line(line, start, add)
        if (m := _ENTRY.match(line)) and (named := name_kind(m.group(1))):
            stop = text.find("\n", end + 1)
            after = text[end + 1 : stop if stop >= 0 else len(text)]
            if v := _ENTRY_VALUE.match(after):
                s, e = _group(v, 1) or v.span(4)
                if not _COMPOUND.search(after[s:e]) and is_secret(after[s:e], *named):
                    add(end + 1 + s, end + 1 + e, named[0])
        if any(h in low[start:end] for h in _SHAPE_HINTS):
            for pattern, kind in SHAPES:
                for m in pattern.finditer(line):
                    if not is_placeholder(m.group()):
                        add(start + m.start(), start + m.end(), kind)
    return sorted(found)


def fingerprint(literal: str) -> str:
    return hashlib.sha256(literal.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def redact(text: str | None, findings: list[Finding] | None = None) -> str | None:
    """The text with the inside of each credential literal replaced.

    A literal on one line becomes ``REDACTED_<kind>_<fingerprint>``.  One that
    spans lines, or a key block, keeps its line breaks, indents, escapes, quotes
    and opening and closing lines; the runs of key material between them become
    ``REDACTED``.  Everything outside the literals stays as it is.
    """
    if not text:
        return text
    out, at = [], 0
    for f in find(text) if findings is None else findings:
        literal = text[f.start : f.end]
        out.append(text[at : f.start])
        if f.kind == "private_key":
            head, body, foot = re.match(r"(?s)(-----BEGIN [^-]*-----)(.*)(-----END [^-]*-----)$", literal).groups()
            out += [head, _KEY_RUN.sub("REDACTED", body), foot]
        else:
            out.append(f"REDACTED_{f.kind}_{fingerprint(literal)}")
        at = f.end
    out.append(text[at:])
    return "".join(out)


_KEY_RUN = re.compile(r"(?:(?<=\\[nr])|(?<![\\A-Za-z0-9+/=]))[A-Za-z0-9+/=]{2,}")


def redaction_records(df: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, start_line, end_line, kind, fingerprint, start, end), one row per credential literal.

    Lines count from 1 by line feeds; start and end are character offsets.
    Null and empty texts give no rows; other columns are ignored.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(as_col(doc_id).alias("doc_id"), as_col(text).alias("text"))

    def records(key, body):
        for f in find(body):
            line = body.count("\n", 0, f.start) + 1
            yield key, line, line + body.count("\n", f.start, f.end), f.kind, fingerprint(body[f.start : f.end]), f.start, f.end

    key_type = rows.schema["doc_id"].dataType.simpleString()
    return per_row(rows, records, f"doc_id {key_type}, start_line bigint, end_line bigint, kind string, fingerprint string, start bigint, end bigint")


def redacted(df: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc_id, text, n_redacted): every text with its credentials redacted; null stays null."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(as_col(doc_id).alias("doc_id"), as_col(text).alias("text"))

    def one(key, body):
        found = find(body)
        yield key, redact(body, found), len(found)

    key_type = rows.schema["doc_id"].dataType.simpleString()
    return per_row(rows, one, f"doc_id {key_type}, text string, n_redacted bigint")
