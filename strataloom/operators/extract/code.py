"""Source code: Python by its syntax tree, Go by its tokens, ECMAScript by its top-level forms and the tokens of its classes."""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexing import GO_WORDS, Source, ecma_source, go_source
from .rows import flat_map

_SCHEMA = "kind string, name string, qualified_name string, signature string, visibility string, start_line bigint, end_line bigint, edge string, target string"


def module_name(path: str) -> str:
    bare = re.sub(r"\.pyi?$", "", path).replace("/", ".")
    return bare.removesuffix(".__init__")


def _visible(name: str) -> str:
    return "private" if name.startswith("_") and not (name.startswith("__") and name.endswith("__")) else "public"


def python_symbols(doc_id, path: str | None, text: str | None):
    """Modules, classes, functions, methods and tests, their imports, calls and bases. A call belongs to the innermost function around it. A file that doesn't parse gives only a diagnostic."""
    path, text = path or "", text or ""
    module = module_name(path)
    lines = text.count("\n") + 1
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        at = min(getattr(e, "lineno", None) or 1, lines)
        yield doc_id, "diagnostic", type(e).__name__, module, "", "public", at, at, None, None
        return
    yield doc_id, "module", module.rpartition(".")[2], module, "", "public", 1, lines, None, None
    todo = [(tree, module, False)]
    while todo:
        at, scope, in_class = todo.pop()
        for x in ast.iter_child_nodes(at):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "test" if x.name.startswith("test_") else "method" if in_class else "function"
                full = f"{scope}.{x.name}"
                yield doc_id, kind, x.name, full, f"{x.name}({ast.unparse(x.args)})", _visible(x.name), x.lineno, x.end_lineno, None, None
                for c in _own(x):
                    if isinstance(c, ast.Call) and (target := _dotted(c.func)):
                        yield doc_id, None, None, full, None, None, c.lineno, c.end_lineno, "calls", target
                todo.append((x, full, False))
            elif isinstance(x, ast.ClassDef):
                full = f"{scope}.{x.name}"
                yield doc_id, "class", x.name, full, x.name, _visible(x.name), x.lineno, x.end_lineno, None, None
                for b in x.bases:
                    if target := _dotted(b):
                        yield doc_id, None, None, full, None, None, x.lineno, x.lineno, "inherits", target
                todo.append((x, full, True))
            elif isinstance(x, ast.Import):
                for a in x.names:
                    yield doc_id, None, None, module, None, None, x.lineno, x.end_lineno, "imports", a.name
            elif isinstance(x, ast.ImportFrom):
                yield doc_id, None, None, module, None, None, x.lineno, x.end_lineno, "imports", "." * x.level + (x.module or "")
            elif not isinstance(x, ast.expr):
                todo.append((x, scope, in_class))


def _own(function: ast.AST):
    """What stands in a function, but for what stands in functions within it."""
    todo = [*ast.iter_child_nodes(function)]
    while todo:
        x = todo.pop()
        yield x
        if not isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            todo += ast.iter_child_nodes(x)


def _dotted(x: ast.expr) -> str:
    parts = []
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    return ".".join([x.id, *reversed(parts)]) if isinstance(x, ast.Name) else ""


_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_ECMA = re.compile(
    r"^(?P<export>export[ \t]+(?:default[ \t]+)?)?(?:(?:declare|abstract)[ \t]+)*(?:async[ \t]+)?(?:function[ \t]*\*?[ \t]*(?P<func>[\w$]+)[ \t]*(?P<sig>[(<][^\n{]*)|(?P<what>class|interface|enum|type)[ \t]+(?P<type>[\w$]+)|(?P<decl>const|let|var)[ \t]+(?P<name>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?P<fn>(?:async[ \t]*)?(?:function\b|\([^()\n]*\)[ \t]*(?::[^=\n]+)?=>|[\w$]+[ \t]*=>))?)", re.M
)
_ECMA_IMPORT = re.compile(r"^[ \t]*import\b[^\n'\"]*['\"]([^'\"\n]+)['\"]", re.M)
_ROUTE = re.compile(r"\b(?:app|router|server)\.(get|post|put|patch|delete|head|options|all)\([ \t]*['\"`](/[^'\"`\n]*)['\"`]")


def _quiet(text: str) -> str:
    """The text with comments and literals blanked, lines and places kept."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def go_symbols(doc_id, path: str | None, text: str | None):
    """Packages, types, fields, interface members, values, functions, methods and tests, imports and the calls in bodies, nested functions included."""
    text = text or ""
    src = go_source(text)
    tokens, n = src.tokens, len(src.tokens)
    name = next((tokens[i + 1].text for i in range(n - 1) if src.is_(i, "package") and tokens[i + 1].kind == "name"), "")
    yield doc_id, "package", name, name, "", "public", 1, text.count("\n") + 1, None, None

    def symbol(kind: str, own: str, full: str, signature: str, start: int, end: int):
        return doc_id, kind, own, full, signature, "public" if own[:1].isupper() else "private", src.first_line(start), src.line(end - 1), None, None

    for start, end in src.split(0, n):
        word = tokens[start].text if tokens[start].kind == "name" else ""
        if word == "func":
            yield from _go_function(doc_id, path or "", src, name, start, end, symbol)
        elif word in ("import", "type", "const", "var") and start + 1 < end:
            grouped = src.is_(start + 1, "(")
            for s, e in src.split(start + 2, src.other[start + 1]) if grouped else [(start + 1, end)]:
                if word == "import":
                    for i in range(s, e):
                        if tokens[i].kind == "text":
                            yield doc_id, None, None, name, None, None, src.first_line(i), src.first_line(i), "imports", tokens[i].text[1:-1]
                elif word == "type":
                    yield from _go_type(src, name, s if grouped else start, s, e, symbol)
                else:
                    for own in _go_names(src, s, e):
                        yield symbol("constant" if word == "const" else "variable", own, f"{name}.{own}", own, s if grouped else start, e)


def _go_names(src: Source, start: int, end: int) -> list[str]:
    """The names of a list that begins at *start*."""
    out = []
    while start < end and src.tokens[start].kind == "name":
        out.append(src.tokens[start].text)
        if not src.is_(start + 1, ","):
            break
        start += 2
    return out


def _go_function(doc_id, path: str, src: Source, package: str, start: int, end: int, symbol):
    tokens, i, recv = src.tokens, start + 1, None
    if i < end and src.is_(i, "("):
        for j in range(i + 1, min(src.other[i], end)):
            if src.is_(j, "["):
                break
            recv = tokens[j].text if tokens[j].kind == "name" else recv
        i = src.other[i] + 1
    if i + 1 >= end or tokens[i].kind != "name":
        return
    own, body = tokens[i].text, i + 1
    while body < end and not (src.is_(body, "{") and tokens[body - 1].text not in ("struct", "interface")):
        body = src.after(body)
    kind = "test" if not recv and re.match(r"(?:Test|Benchmark|Fuzz|Example)", own) and path.endswith("_test.go") else "method" if recv else "function"
    full = ".".join(filter(None, (package, recv, own)))
    yield symbol(kind, own, full, f"{own}{src.part(i + 1, min(body, end))}", start, end)
    for k, spelling in _go_calls(src, body + 1, end):
        yield doc_id, None, None, full, None, None, src.first_line(k), src.line(src.other[k]), "calls", spelling


def _go_type(src: Source, package: str, first: int, start: int, end: int, symbol):
    """A type and the members of a struct or an interface; *first* is where its lines begin."""
    tokens = src.tokens
    if tokens[start].kind != "name":
        return
    own, i = tokens[start].text, start + 1
    if i + 2 < end and src.is_(i, "[") and tokens[i + 1].kind == "name" and (tokens[i + 2].kind == "name" or tokens[i + 2].text in (",", "[", "~", "*")) and src.other[i] + 1 < end:
        i = src.other[i] + 1
    if i < end and src.is_(i, "="):
        i += 1
    what = tokens[i].text if i < end else ""
    full = f"{package}.{own}"
    yield symbol({"struct": "class", "interface": "interface"}.get(what, "type"), own, full, own, first, end)
    if what not in ("struct", "interface") or not src.is_(i + 1, "{"):
        return
    for s, e in src.split(i + 2, src.other[i + 1]):
        if what == "interface":
            if tokens[s].kind == "name" and src.is_(s + 1, "("):
                member = tokens[s].text
                yield symbol("method", member, f"{full}.{member}", f"{member}{src.part(s + 1, e)}", s, e)
            else:
                member = src.part(s, e)
                yield symbol("method", member, f"{full}.{member}", f"{member} {member}", s, e)
            continue
        last = e - 1 if tokens[e - 1].kind == "text" and e - 1 > s else e  # without its tag
        embedded = tokens[s].kind != "name" or s + 1 == last or src.is_(s + 1, ".") or (src.is_(s + 1, "[") and src.other[s + 1] + 1 >= last)
        names = [src.part(s, last)] if embedded else _go_names(src, s, last)
        at = s if embedded else s + 2 * len(names) - 1
        kind = "method" if src.is_(at, "func") else "field"
        for member in names:
            yield symbol(kind, member, f"{full}.{member}", f"{member} {src.part(at, last)}", s, e)


def _go_calls(src: Source, start: int, end: int):
    """(place of the bracket, spelling) of the calls in [start, end); what a declared interface lists isn't called."""
    tokens, i = src.tokens, start
    while i < end:
        if src.is_(i, "interface") and src.is_(i + 1, "{"):
            i = src.other[i + 1] + 1
            continue
        if src.is_(i, "(") and i > start and (spelling := _go_callee(src, i - 1)[0]):
            yield i, spelling
        i += 1


def _go_callee(src: Source, k: int) -> tuple[str | None, int]:
    """The dotted spelling of what ends at *k* and where it begins: '' without a name, None for an element type."""
    tokens = src.tokens
    names: list[str] = []
    while k >= 0:
        t = tokens[k]
        if t.kind == "name" and t.text not in GO_WORDS:
            names.append(t.text)
            if src.is_(k - 1, "."):
                k -= 2
                continue
            if src.is_(k - 1, "]") or src.is_(k - 1, "chan"):
                return None, k
            break
        if t.text == "]" and t.kind == "mark" and k in src.other and _go_ends(src, src.other[k] - 1):
            k = src.other[k] - 1
            continue
        if t.text == ")" and t.kind == "mark" and k in src.other:
            opened = src.other[k]
            if not _go_ends(src, opened - 1) and not src.is_(opened - 1, "func") and not src.is_(opened - 1, "."):
                spelling, began = _go_callee(src, k - 1)
                if spelling and began == opened + 1:
                    names.append(spelling)
            k = opened
        elif not names:
            return "", k
        break
    return ".".join(reversed(names)), k


def _go_ends(src: Source, k: int) -> bool:
    """Whether an operand may end at *k*."""
    if k < 0:
        return False
    t = src.tokens[k]
    return t.kind == "name" and t.text not in GO_WORDS or t.kind == "text" or t.kind == "mark" and t.text in (")", "]", "}")


def ecma_symbols(doc_id, path: str | None, text: str | None):
    """Functions, classes with their methods, types, constants, imports and the routes that calls like ``app.get('/x', ...)`` declare."""
    text = text or ""
    quiet = _quiet(text)
    module = re.sub(r"\.[cm]?[jt]sx?$", "", path or "")
    yield doc_id, "module", module.rpartition("/")[2], module, "", "public", 1, text.count("\n") + 1, None, None
    for m in _ECMA.finditer(quiet):
        own = m.group("func") or m.group("type") or m.group("name")
        kind = "function" if m.group("func") or m.group("fn") else m.group("what") or "variable"
        kind = "constant" if kind == "variable" and m.group("decl") == "const" else kind
        signature = f"{own}{text[m.start('sig') : m.end('sig')].strip()}" if m.group("sig") else own
        yield doc_id, kind, own, f"{module}.{own}", signature, "public" if m.group("export") else "private", _line(text, m.start()), _line(text, m.start()), None, None
    yield from _ecma_methods(doc_id, module, ecma_source(text))
    for m in _ECMA_IMPORT.finditer(text):
        if quiet[m.start() : m.end()].lstrip().startswith("import"):
            yield doc_id, None, None, module, None, None, _line(text, m.start()), _line(text, m.start()), "imports", m.group(1)
    for m in _ROUTE.finditer(text):
        if quiet[m.start() : m.start(1)].strip():
            yield doc_id, "api_endpoint", f"{m.group(1).upper()} {m.group(2)}", f"{module}#{m.group(1).upper()} {m.group(2)}", "", "public", _line(text, m.start()), _line(text, m.start()), None, None


# What may stand before a method's name, and the words that show its visibility.
_MODIFIERS = frozenset(("async", "abstract", "accessor", "declare", "public", "private", "protected", "readonly", "static", "override", "get", "set"))


def _ecma_methods(doc_id, module: str, src: Source):
    """Methods and constructors of the classes that are declared at the top level."""
    tokens, i = src.tokens, 0
    while i < len(tokens):
        if not (src.is_(i, "class") and i + 1 < len(tokens) and tokens[i + 1].kind == "name" and not src.is_(i - 1, ".")):
            i = src.after(i)
            continue
        owner, body = tokens[i + 1].text, i + 2
        while body < len(tokens) and not src.is_(body, "{") and not src.is_(body, ";"):
            body = _after_angles(src, body, len(tokens)) if src.is_(body, "<") else src.after(body)
        if src.is_(body, "{"):
            yield from _ecma_members(doc_id, f"{module}.{owner}", src, body + 1, min(src.other[body], len(tokens)))
            i = src.after(body)
        else:
            i = body


def _ecma_members(doc_id, owner: str, src: Source, i: int, end: int):
    tokens = src.tokens
    while i < end:
        start, visibility = i, "public"
        if tokens[i].text[:1] == "@":  # a decorator
            i += 1
            while i < end and src.is_(i, "."):
                i += 2
            i = src.after(i) if i < end and src.is_(i, "(") else i
            continue
        while i + 1 < end and tokens[i].text in _MODIFIERS and tokens[i + 1].text not in ("(", "=", ":", ";", "?", "!", "<"):
            visibility = "private" if tokens[i].text in ("private", "protected") else visibility
            i += 1
        i += src.is_(i, "*")
        if i >= end:
            return
        at = i
        named = tokens[i].kind in ("name", "text", "number") or src.is_(i, "[")
        i = src.after(i)
        name = src.part(at, i) if src.is_(at, "[") else tokens[at].text.strip("'\"")
        i += i < end and tokens[i].text in ("?", "!")
        if named and i < end and src.is_(i, "<"):
            i = _after_angles(src, i, end)
        if named and i < end and src.is_(i, "("):
            i = src.after(i)
            if src.is_(i, ":"):
                i = _type_end(src, i + 1, end)
            visibility = "private" if name.startswith("#") else visibility
            signature = src.part(at, i)
            i = src.after(i) if i < end and src.is_(i, "{") else i
            yield doc_id, "constructor" if name == "constructor" else "method", name, f"{owner}.{name}", signature, visibility, src.first_line(start), src.line(min(i, end) - 1), None, None
        elif not src.is_(at, ";"):
            i = _field_end(src, at, end)
        while i < end and src.is_(i, ";"):
            i += 1


def _after_angles(src: Source, i: int, end: int) -> int:
    depth = 0
    while i < end:
        depth += src.is_(i, "<") - src.is_(i, ">")
        i = src.after(i)
        if depth == 0:
            break
    return i


# Marks after or before which an expression or a type goes on over a line end.
_OPEN_ENDED = frozenset("= + - * / % & | ^ ? : , . < => ! ~ ( [ { ...".split())
_GOES_ON = frozenset("+ - * / % & | ^ ? : . , = => < > ( [ `".split()) - {"*", "["}


def _type_end(src: Source, i: int, end: int) -> int:
    """Where a return type ends: at the body, a semicolon or the end of the line."""
    tokens, begin = src.tokens, i
    while i < end and not src.is_(i, ";"):
        wanted = i == begin or tokens[i - 1].text in _OPEN_ENDED or tokens[i - 1].text in ("is", "keyof", "extends", "readonly", "typeof", "asserts")
        if src.is_(i, "{") and not wanted:
            break
        if tokens[i].fresh and not wanted and tokens[i].text not in ("|", "&", "=>", ".", ">"):
            break
        i = _after_angles(src, i, end) if src.is_(i, "<") else src.after(i)
    return min(i, end)


def _field_end(src: Source, i: int, end: int) -> int:
    """Where a field ends: at a semicolon, or at a line end over which its value doesn't go on."""
    tokens, begin = src.tokens, i
    while i < end and not src.is_(i, ";"):
        before = tokens[i - 1].text if i > begin else "="
        if tokens[i].fresh and before not in _OPEN_ENDED and tokens[i].text not in _GOES_ON:
            break
        i = src.after(i)
    return max(min(i, end), begin + 1)


def _symbols(fn, docs: DataFrame) -> DataFrame:
    key = docs.schema["doc_id"].dataType.simpleString()
    return flat_map(docs.select("doc_id", "path", "text"), fn, f"doc_id {key}, {_SCHEMA}")


def python_table(docs: DataFrame) -> DataFrame:
    """Symbol rows (edge null) and edge rows (kind null) of Python files. docs: (doc_id, path, text)."""
    return _symbols(python_symbols, docs)


def go_table(docs: DataFrame) -> DataFrame:
    return _symbols(go_symbols, docs)


def ecma_table(docs: DataFrame) -> DataFrame:
    return _symbols(ecma_symbols, docs)


def enclosing(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """The innermost definition around each occurrence, both ends included: (doc_id, occurrence, symbol), '' without any.

    A range join by buckets: definitions go to every bucket of 64 lines they
    span, an occurrence looks into one, so pairs are those of one file and bucket.
    """
    size = 64
    spans = definitions.select("doc_id", "symbol", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.explode(F.sequence((F.col("start_line") / size).cast("bigint"), (F.greatest("end_line", "start_line") / size).cast("bigint"))).alias("b"))
    asked = occurrences.withColumn("b", (F.col("line") / size).cast("bigint"))
    met = asked.join(spans, ["doc_id", "b"]).where((F.col("s") <= F.col("line")) & (F.col("line") <= F.col("e")))
    best = met.groupBy("doc_id", "occurrence").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("w"), F.col("s"), F.col("symbol"))).alias("m"))
    return occurrences.join(best, ["doc_id", "occurrence"], "left").select("doc_id", "occurrence", F.coalesce("m.symbol", F.lit("")).alias("symbol"))

