"""Texts that aren't valid in their language, by ``derivatives``.

A text becomes a stream of tokens (with Python's indents, Go's semicolons and
ECMAScript's newlines), and the stream is read with the language's grammar.
``failure`` tells where and how a text fails: at a token that can't follow, or
at an end that comes too early.
"""

from __future__ import annotations

import ast
import functools
import re
import warnings
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grammars
from ._texts import per_row
from .derivatives import EMPTY, Grammar


class Failure(NamedTuple):
    code: str  # unexpected_token, unexpected_end, bad_token or bad_indent
    line: int
    token: str


class Language:
    """A lexer and a grammar. Unknown words have no class (-1), so no derivative."""

    #: Lexemes that are remembered with their class.
    MOST_LEXEMES = 200_000
    #: Lines that ``prepared`` puts before a text.
    shift = 0

    def __init__(self, rules: str, start: str, pattern: str):
        self.grammar = Grammar(rules, start)
        self.tokens = self.grammar.tokens
        self.pattern = re.compile(pattern, re.S)
        self.known: dict[str, int] = {}
        #: In no grammar, so nothing may follow it.
        self.bad = -1

    def terminal(self, name: str) -> int:
        return self.tokens.get(name, self.bad)

    def classify(self, lexeme: str) -> int:
        raise NotImplementedError

    def class_of(self, lexeme: str) -> int:
        c = self.known.get(lexeme)
        if c is None:
            if len(self.known) > self.MOST_LEXEMES:
                self.known.clear()
            c = self.classify(lexeme)
            if len(lexeme) <= 64:
                self.known[lexeme] = c
        return c

    def prepared(self, text: str) -> str:
        return text

    def stream(self, text: str) -> tuple[list[int], list[int]]:
        """(classes, places): token classes and for each the number of its lexeme."""
        raise NotImplementedError

    def failure(self, text: str) -> Failure | None:
        text = self.prepared(text)
        lexemes = self.pattern.findall(text)
        at = self.read(lexemes)
        if at is None:
            return None
        # only a failing text is looked at twice
        for k, m in enumerate(self.pattern.finditer(text)):
            if k == at:
                token = m.group(1)
                line = text.count("\n", 0, m.start(1)) + 1 - self.shift
                if not token.strip():
                    return Failure("unexpected_token" if token else "unexpected_end", line, "end of line" if token else "")
                return Failure("bad_token" if self.class_of(token) == self.bad else "unexpected_token", line, token[:40])
        return Failure("unexpected_end", text.count("\n") + 1 - self.shift, "")

    def read(self, lexemes: list[str]) -> int | None:
        """None if the lexemes are a sentence, else the number of the failing one."""
        raise NotImplementedError


class Json(Language):
    def __init__(self):
        super().__init__(
            grammars.JSON,
            "value",
            r"""[ \t\r\n]*+("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?(?![0-9A-Za-z.])|true\b|false\b|null\b|[][{}:,]|\Z|.)""",
        )

    def classify(self, lexeme: str) -> int:
        c = lexeme[0]
        if c == '"' and len(lexeme) > 1:
            return self.terminal("STRING")
        if c.isdigit() or (c == "-" and len(lexeme) > 1):
            return self.terminal("NUMBER")
        return self.terminal(lexeme)

    def read(self, lexemes: list[str]) -> int | None:
        g = self.grammar
        known, class_of = self.known, self.class_of
        tokens = []
        for x in lexemes:
            if not x:
                break
            c = known.get(x)
            tokens.append(class_of(x) if c is None else c)
        if self.bad in tokens:
            cut = tokens.index(self.bad)
            at = g.read(tokens[:cut])
            return cut if at < 0 or at >= cut else at
        at = g.read(tokens)
        return None if at < 0 else at


_PY_STRING = r"""[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|.))*+"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*+')"""
_PY_NUMBER = r"""(?:0[xX](?:_?[0-9a-fA-F])++|0[oO](?:_?[0-7])++|0[bB](?:_?[01])++|(?:[0-9](?:_?[0-9])*+\.(?:[0-9](?:_?[0-9])*+)?|\.[0-9](?:_?[0-9])*+)(?:[eE][-+]?[0-9](?:_?[0-9])*+)?[jJ]?|[0-9](?:_?[0-9])*+(?:[eE][-+]?[0-9](?:_?[0-9])*+[jJ]?|[jJ])|(?:[1-9](?:_?[0-9])*+|0(?:_?0)*+))(?![\w])"""


class Python(Language):
    shift = 1
    KEYWORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
    CONSTANTS = frozenset(("None", "True", "False"))
    SOFT = frozenset(("match", "case", "type"))
    BINARY = frozenset(("//", "%", "<<", ">>", "&", "^", "<", ">", "==", ">=", "<=", "!="))
    AUGMENT = frozenset(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="))

    def __init__(self):
        newline = r"(?:\r\n|\r|\n)"
        super().__init__(
            grammars.PYTHON,
            "file",
            r"(?:[ \t\f]++|\\" + newline + r"|#[^\r\n]*+)*+("
            + newline + r"(?:[ \t\f]*+(?:#[^\r\n]*+)?" + newline + r")*+[ \t\f]*+|" + _PY_STRING + "|" + _PY_NUMBER
            + r"|[^\W\d]\w*+|\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|!=|->|:=|[-+*/%@&|^=<>]=|[-+*/%@&|^=<>~()\[\]{},:;.]|\Z|.)",
        )
        t = self.terminal
        self.newline, self.indent, self.dedent = t("NEWLINE"), t("INDENT"), t("DEDENT")
        self.open = {t(x) for x in "([{"}
        self.close = {t(x) for x in ")]}"}
        self.line = -2  # the class of newline lexemes
        self.brackets = self.open | self.close

    def prepared(self, text: str) -> str:
        return "\n" + text.removeprefix("\ufeff") + "\n"

    def classify(self, lexeme: str) -> int:
        c = lexeme[0]
        if c in "\r\n":
            return self.line
        if c.isidentifier() and lexeme.isidentifier():
            if lexeme in self.KEYWORDS or lexeme in self.SOFT:
                return self.terminal(lexeme)
            return self.terminal("CONST" if lexeme in self.CONSTANTS else "NAME")
        if len(lexeme) > 1 and lexeme[-1] in "\"'":
            return self.terminal("STRING")
        if c.isdigit() or (c == "." and lexeme[1:2].isdigit()):
            return self.terminal("NUMBER")
        if lexeme in self.BINARY:
            return self.terminal("BINARY")
        return self.terminal("AUGMENT" if lexeme in self.AUGMENT else lexeme)

    @staticmethod
    @functools.lru_cache(maxsize=4096)
    def width(lexeme: str) -> int:
        n = 0
        for c in lexeme[max(lexeme.rfind("\n"), lexeme.rfind("\r")) + 1 :]:
            n = n + 8 - n % 8 if c == "\t" else 0 if c == "\f" else n + 1
        return n

    def read(self, lexemes: list[str]) -> int | None:
        known, class_of, brackets, open_, line = self.known, self.class_of, self.brackets, self.open, self.line
        out: list[int] = []
        place: list[int] = []
        add = out.append
        depth, levels, content, wrong = 0, [0], False, None
        for k, x in enumerate(lexemes):
            if not x:
                break
            c = known.get(x)
            if c is None:
                c = class_of(x)
            if c == line:
                if depth > 0:
                    continue
                if content:
                    add(self.newline)
                    place.append(k)
                    content = False
                if k + 1 >= len(lexemes) or not lexemes[k + 1]:
                    continue  # the end of the text
                n = self.width(x)
                if n > levels[-1]:
                    levels.append(n)
                    add(self.indent)
                    place.append(k + 1)
                else:
                    while n < levels[-1]:
                        levels.pop()
                        add(self.dedent)
                        place.append(k + 1)
                    if n != levels[-1]:
                        wrong = k + 1
                        break
                continue
            if c == self.bad:
                wrong = k
                break
            if c in brackets:
                depth += 1 if c in open_ else -1
            add(c)
            place.append(k)
            content = True
        if wrong is None:
            if content:
                add(self.newline)
                place.append(len(lexemes))
            for _ in levels[1:]:
                add(self.dedent)
                place.append(len(lexemes))
        at = self.grammar.read(out)
        if wrong is not None:
            return wrong if at < 0 or at >= len(out) else place[at]
        return None if at < 0 else place[at] if at < len(out) else len(lexemes)


class Go(Language):
    KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    BINARY = frozenset(("||", "&&", "==", "!=", "<", "<=", ">", ">=", "/", "%", "<<", ">>", "&^"))
    ASSIGN = frozenset(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="))

    def __init__(self):
        number = r"(?:0[xX][0-9a-fA-F_]*+(?:\.[0-9a-fA-F_]*+)?(?:[pP][-+]?[0-9_]++)?|0[oO][0-7_]++|0[bB][01_]++|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][-+]?[0-9_]++)?)i?(?!\w)"
        super().__init__(
            grammars.GO,
            "file",
            r"(?:[ \t\f]++|\r(?=\n)|//[^\n]*+|/\*(?:[^*\n]|\*(?!/))*+\*/)*+(\n(?:\s++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+|/\*(?:[^*]|\*(?!/))*+\*/|\"(?:[^\"\\\n]|\\[^\n])*+\"|`[^`]*+`|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|" + number
            + r"|[^\W\d]\w*+|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|<<|>>|&\^|[-+*/%&|^]=|[-+*/%&|^<>=!(){}\[\],;.:~]|\Z|.)",
        )
        t = self.terminal
        self.semicolon = t(";")
        self.line = -2
        self.before_line = {t(x) for x in ("NAME", "NUMBER", "STRING", "RUNE", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}")}

    def prepared(self, text: str) -> str:
        return text.removeprefix("\ufeff") + "\n"

    def classify(self, lexeme: str) -> int:
        c = lexeme[0]
        if c == "\n" or lexeme.startswith("/*"):
            return self.line
        if c.isidentifier():
            return self.terminal(lexeme if lexeme in self.KEYWORDS else "NAME")
        if len(lexeme) > 1 and c in "\"`":
            return self.terminal("STRING")
        if len(lexeme) > 2 and c == "'":
            return self.terminal("RUNE")
        if c.isdigit() or (c == "." and lexeme[1:2].isdigit()):
            return self.terminal("NUMBER")
        if lexeme in self.BINARY:
            return self.terminal("BINARY")
        return self.terminal("ASSIGN" if lexeme in self.ASSIGN else lexeme)

    def read(self, lexemes: list[str]) -> int | None:
        known, class_of, line, before, semicolon = self.known, self.class_of, self.line, self.before_line, self.semicolon
        out: list[int] = []
        place: list[int] = []
        last, wrong = self.bad, None
        for k, x in enumerate(lexemes):
            if not x:
                break
            c = known.get(x)
            if c is None:
                c = class_of(x)
            if c == line:
                if last not in before:
                    continue
                c = semicolon
            elif c == self.bad:
                wrong = k
                break
            out.append(c)
            place.append(k)
            last = c
        at = self.grammar.read(out)
        if wrong is not None:
            return wrong if at < 0 or at >= len(out) else place[at]
        return None if at < 0 else place[at] if at < len(out) else len(lexemes)


class Ecma(Language):
    KEYWORDS = frozenset(
        "await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield".split()
    )
    BINARY = frozenset(("/", "%", "**", "<<", "<=", ">=", "==", "!=", "===", "!==", ">>", ">>>", "&", "^", "|", "&&", "||", "??"))
    ASSIGN = frozenset(("+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="))
    CONSTANTS = frozenset(("null", "true", "false"))

    def __init__(self, rules: str, typed: bool):
        self.typed = typed
        word = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*+"
        number = r"(?:0[xX][0-9a-fA-F_]++n?|0[oO][0-7_]++n?|0[bB][01_]++n?|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][-+]?[0-9_]++)?n?)(?![\w$])"
        template = self._template(4)
        regex = r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[A-Za-z]*+"
        before = r"(?:=>|[-+*%<>&|^!=]=+|&&=?|\|\|=?|\?\?=?|[(,:\[!?{};~=+*%&|^<>-]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield)\b)"
        shift = "" if typed else r">>>=|>>>|>>=|>>|"
        super().__init__(
            rules,
            "program",
            r"(?:[ \t\f\v\xa0\ufeff]++|//[^\r\n\u2028\u2029]*+|/\*(?:[^*\r\n]|\*(?!/))*+\*/)*+([\r\n\u2028\u2029](?:\s++|//[^\r\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+|/\*(?:[^*]|\*(?!/))*+\*/|"
            + before + r"\s*+" + regex + "|" + word + r"|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*+\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+'|" + template + "|" + number + r"|\#" + word
            + "|" + shift + r"\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\*\*|<<|[-+*/%&|^]=|[][{}();,<>+\-*/%&|^!~?:=.@]|\Z|.)",
        )
        t = self.terminal
        self.line, self.regexed = -2, -3
        self.inserted, self.brace = t("ASI"), t("}")
        self.restricted = {t(x) for x in ("return", "break", "continue")}
        self.steps = {t("++"), t("--")}
        self.regex = t("REGEX")
        self._regex = re.compile("(" + before + r")\s*+(" + regex + r")\Z")
        self.template = t("TEMPLATE")

    @staticmethod
    def _template(depth: int) -> str:
        """A template literal whose expressions hold braces and templates down to a depth."""
        inner, string = r"[^{}`]*+", r"'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\""
        for _ in range(depth):
            literal = rf"`(?:[^`\\$]|\\.|\$(?!\{{)|\$\{{{inner}\}})*+`"
            inner = rf"(?:[^{{}}`'\"]|{string}|['\"]|\{{{inner}\}}|{literal})*+"
        return rf"`(?:[^`\\$]|\\.|\$(?!\{{)|\$\{{{inner}\}})*+`"

    def prepared(self, text: str) -> str:
        text = text.removeprefix("\ufeff")
        return "//" + text if text.startswith("#!") else text

    def classify(self, lexeme: str) -> int:
        c = lexeme[0]
        if c in "\r\n\u2028\u2029" or lexeme.startswith("/*"):
            return self.line
        if lexeme[-1] == "/" and len(lexeme) > 2 or (len(lexeme) > 3 and self._regex.match(lexeme)):
            return self.regexed
        if c.isidentifier() or c in "$\\":
            if lexeme in self.KEYWORDS or lexeme in self.tokens and not lexeme.isupper():
                return self.terminal(lexeme)
            return self.terminal("CONST" if lexeme in self.CONSTANTS else "NAME")
        if c == "#" and len(lexeme) > 1:
            return self.terminal("PRIVATE")
        if len(lexeme) > 1 and c in "\"'":
            return self.terminal("STRING")
        if len(lexeme) > 1 and c == "`":
            return self.template if self.holes_fine(lexeme) else self.bad
        if c.isdigit() or (c == "." and lexeme[1:2].isdigit()):
            return self.terminal("NUMBER")
        if lexeme in self.BINARY and lexeme not in self.tokens:
            return self.terminal("BINARY")
        if self.typed and lexeme == "@":
            return self.terminal("@")
        return self.terminal("ASSIGN" if lexeme in self.ASSIGN else lexeme)

    def holes(self) -> list[int]:
        """What may stand in a template literal: an expression or, in types, a type."""
        return [self.grammar._rule_nodes[r] for r in (("expr", "type") if self.typed else ("expr",))]

    _HOLE = re.compile(r"\\.|\$\{", re.S)

    def holes_fine(self, template: str) -> bool:
        """Whether the expressions in a template literal can be read."""
        at = 1
        while m := self._HOLE.search(template, at):
            at = m.end()
            if m.group() != "${":
                continue
            depth, end = 1, at
            for part in re.finditer(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|[{}]", template[at:], re.S):
                depth += {"{": 1, "}": -1}.get(part.group(), 0)
                if not depth:
                    end = at + part.start()
                    break
            lexemes = self.pattern.findall(template[at:end])
            if all(self.read(lexemes, start) is not None for start in self.holes()):
                return False
            at = end + 1
        return True

    def read(self, lexemes: list[str], start: int | None = None) -> int | None:
        g = self.grammar
        if start is None:
            g.tidy()
        known, class_of, line, width, step, derive = self.known, self.class_of, self.line, g.width, g.step, g.derive
        state = g.start if start is None else start
        asi, brace, steps, restricted = self.inserted, self.brace, self.steps, self.restricted
        bracket = self.terminal("[") if self.typed else self.bad
        fresh, last = False, self.bad  # fresh: a line ended before this token
        for k, x in enumerate(lexemes):
            if not x:
                break
            c = known.get(x)
            if c is None:
                c = class_of(x)
            if c == line:
                fresh = True
                continue
            if c < 0:
                if c == self.bad:
                    return k
                m = self._regex.match(x)
                parts = [class_of(m.group(1)), self.regex]
            else:
                parts = (c,)
            for c in parts:
                if c == self.bad:
                    return k
                if fresh and (last in restricted or c in steps):
                    early = derive(state, asi)
                    state = early if early != EMPTY else state
                after = step(state * width + c)
                if after is None:
                    after = derive(state, c)
                if fresh and c == bracket and (early := derive(state, asi)) != EMPTY:
                    # no type goes on with a bracket on the next line, so a member may begin here
                    after = g.either(after, derive(early, c))
                if after == EMPTY:
                    # a semicolon may be missing before this token
                    if fresh or c == brace:
                        early = derive(state, asi)
                        after = derive(early, c) if early != EMPTY else EMPTY
                    if after == EMPTY:
                        return k
                state, last, fresh = after, c, False
        if g.nullable(state) or ((early := derive(state, asi)) != EMPTY and g.nullable(early)):
            return None
        return len(lexemes)


# --- Markup in ECMAScript ---------------------------------------------------------

# What an element may stand behind.
_BEFORE_ELEMENT = frozenset(("", "(", "[", "{", ",", ";", "=", "=>", "?", ":", "&&", "||", "??", "!", "return", "default", "else", "case", "yield", "await", "of", "in", "typeof"))
_TAG_OPENS = re.compile(r"<\s*(?:(>)|([A-Za-z_$][\w$.:-]*)(?:<[\w$.,\s|\[\]]*>)?)")
_TAG_CLOSES = re.compile(r"<\s*/\s*([A-Za-z_$][\w$.:-]*)?\s*>")
_ATTRIBUTE_NAME = re.compile(r"[A-Za-z_$][\w$:.-]*")
_ATTRIBUTE_GAP = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.S)
_ATTRIBUTE_TEXT = re.compile(r"\"[^\"]*\"|'[^']*'")
_CHILD_TEXT = re.compile(r"[^<{}>]*")


class Markup:
    """Takes the elements (JSX) out of an ECMAScript text; each becomes a template literal with as many line ends."""

    def __init__(self, reader: Ecma, text: str):
        self.reader, self.text = reader, text

    def taken_out(self) -> str:
        return self._code(0, False)[0]

    def _code(self, at: int, inner: bool) -> tuple[str, int]:
        """The text from *at* without elements, to the brace that closes it if *inner*; its end is -1 where there is none."""
        text, out, depth, last = self.text, [], 0, ""
        while at < len(text) and (m := self.reader.pattern.match(text, at)):
            lexeme, start = m.group(1), m.start(1)
            if not lexeme:
                break
            if lexeme == "<" and last in _BEFORE_ELEMENT and (end := self._element(start)) > 0:
                out += [text[at:start], "`", "\n" * text.count("\n", start, end), "`"]
                at, last = end, "`"
                continue
            if inner and lexeme == "}":
                if not depth:
                    return "".join([*out, text[at:start]]), m.end(1)
                depth -= 1
            depth += lexeme == "{"
            out.append(text[at : m.end(1)])
            at = m.end(1)
            if not lexeme.isspace() and not lexeme.startswith("/*"):
                last = lexeme
        return "".join([*out, text[at:]]), -1 if inner else len(text)

    def _hole(self, at: int, spread: bool) -> int:
        """The end of an expression in braces; -1 if it isn't one."""
        code, end = self._code(at + 1, True)
        if end < 0:
            return -1
        code = code.strip()
        if code.startswith("..."):
            code = code[3:]
        elif spread:
            return -1
        if not code.strip():
            return end
        reader = self.reader
        return end if any(reader.read(reader.pattern.findall(code), start) is None for start in reader.holes()) or not re.sub(r"/\*.*?\*/|//[^\n]*", "", code, flags=re.S).strip() else -1

    def _element(self, at: int) -> int:
        """The end of the element at a place; -1 if there is none."""
        text, open_ = self.text, []
        while at < len(text):
            if m := _TAG_CLOSES.match(text, at):
                if not open_ or open_.pop() != (m.group(1) or ""):
                    return -1
                at = m.end()
            elif m := _TAG_OPENS.match(text, at):
                at, closed = self._attributes(m.end()) if m.group(2) else (m.end(), False)
                if at < 0:
                    return -1
                if not closed:
                    open_.append(m.group(2) or "")
            elif open_ and text[at] == "{":
                at = self._hole(at, False)
                if at < 0:
                    return -1
            elif open_ and (m := _CHILD_TEXT.match(text, at)).end() > at:
                at = m.end()
            else:
                return -1
            if not open_:
                return at
        return -1

    def _attributes(self, at: int) -> tuple[int, bool]:
        """The place behind a tag's attributes, and whether the tag closes itself."""
        text = self.text
        while True:
            at = _ATTRIBUTE_GAP.match(text, at).end()
            if text.startswith("/>", at):
                return at + 2, True
            if text.startswith(">", at):
                return at + 1, False
            if text.startswith("{", at):
                at = self._hole(at, True)
            elif m := _ATTRIBUTE_NAME.match(text, at):
                at = _ATTRIBUTE_GAP.match(text, m.end()).end()
                if not text.startswith("=", at):
                    continue
                at = _ATTRIBUTE_GAP.match(text, at + 1).end()
                if m := _ATTRIBUTE_TEXT.match(text, at):
                    at = m.end()
                else:
                    at = self._hole(at, False) if text.startswith("{", at) else self._element(at)
            else:
                return -1, False
            if at < 0:
                return -1, False


# --- The operator ----------------------------------------------------------------

_MAKERS: dict[str, Callable[[], Language]] = {
    "json": Json,
    "python": Python,
    "go": Go,
    "javascript": lambda: Ecma(grammars.JAVASCRIPT, False),
    "typescript": lambda: Ecma(grammars.TYPESCRIPT, True),
}
LANGUAGES = tuple(_MAKERS)


@functools.cache
def language(name: str) -> Language:
    """The reader of a language, with its memo; one per Python worker."""
    return _MAKERS[name]()


_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}) ")


def _python_fine(text: str) -> bool:
    """The exact check of a text that failed: the grammar here is not that of one version."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def failure(text: str | None, name: str | None) -> Failure | None:
    """How a text fails in a language; None if it is valid, null or of another language.

    An empty text is valid Python, JavaScript and TypeScript, but not Go or JSON.
    """
    if text is None or name not in _MAKERS:
        return None
    reader = language(name)
    try:
        found = reader.failure(text)
        if found and isinstance(reader, Ecma) and ("</" in text or "/>" in text):
            without = Markup(reader, text).taken_out()
            found = reader.failure(without) if without != text else found
    except RecursionError:
        return Failure("nested_too_deep", 1, "")
    if found and name == "python" and _python_fine(text):
        return None
    if found and found.code == "unexpected_token" and _CONFLICT.search(text):
        return found._replace(code="merge_conflict")
    return found


def invalid(df: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", lang: str | Column = "language") -> DataFrame:
    """(doc_id, language, code, line, token), one row for each text that doesn't parse.

    code: unexpected_token, bad_token, unexpected_end, merge_conflict or
    nested_too_deep (beyond some hundred levels of markup).  Rows
    with null text or a language other than python, go, javascript, typescript
    or json are left out, as are all other columns.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(as_col(doc_id).alias("doc_id"), as_col(lang).alias("language"), as_col(text).alias("text"))
    rows = rows.where(F.col("language").isin(*LANGUAGES) & F.col("text").isNotNull())

    def look(key, name, body):
        if f := failure(body, name):
            yield key, name, f.code, f.line, f.token

    key_type = rows.schema["doc_id"].dataType.simpleString()
    return per_row(rows, look, f"doc_id {key_type}, language string, code string, line bigint, token string")


def rates(df: DataFrame, broken: DataFrame, repository: str = "repository_id", doc_id: str = "doc_id", lang: str = "language") -> DataFrame:
    """(repository, language, files, invalid, rate) over the texts of known languages.

    *broken*: the result of ``invalid``; ids are taken to be unique.
    """
    files = df.where(F.col(lang).isin(*LANGUAGES)).select(F.col(doc_id).alias("doc_id"), F.col(repository).alias("repository_id"), F.col(lang).alias("language"))
    joined = files.join(broken.select("doc_id", F.lit(1).alias("bad")), "doc_id", "left")
    out = joined.groupBy("repository_id", "language").agg(F.count("*").alias("files"), F.count("bad").alias("invalid"))
    return out.withColumn("rate", F.col("invalid") / F.col("files"))
