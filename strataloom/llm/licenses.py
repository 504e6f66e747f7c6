"""The license of each file and of each tree.

Statement templates with optional (``[[...]]``) and replaceable (``<<...>>``)
sections are compiled with the license catalogue into backtracking grammars.  A
comment paragraph or line states a license only if a grammar matches it
completely, so mere talk about a license states nothing.  Statements of a file
(tags, notices, sentences, full terms, metadata values) are aggregated; a file
without any takes the license of the nearest directory that states one.
"""

from __future__ import annotations

import json
import posixpath
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ._texts import per_row
from .fileclass import CODE_ENDINGS, ending

CONFLICT, UNKNOWN = "CONFLICT", "UNKNOWN"
#: A statement of terms that the catalogue doesn't have.
OUTSIDE = "<outside>"
#: An expression that multiplies out to more alternatives counts as one of no catalogue.
MOST_ALTERNATIVES = 256

# --- Templates -----------------------------------------------------------------

# Sentence forms. NAME is a license by title, short name or id, VERSION its version.
SENTENCES = (
    "[[this <<thing>> is ]][[and may be ]](offered|distributed|licensed|licenced|released|available|made available|provided|published|shared) under [[the ]][[terms of ]][[the ]][[version VERSION of the ]]NAME[[ VERSION]][[ licen[cs]e]][[; the full terms travel with <<thing>>]]",
    "you may (use|copy|share|redistribute|distribute) this[[ <<thing>>]] under [[the terms of ]][[version VERSION of ]][[the ]]NAME[[ VERSION]]",
    "(licen[cs]e|lizenz|licencia|licenza)[[ ]]: [[the ]]NAME[[ VERSION]]",
    "(use|use of this <<thing>>) is governed by [[the ]]NAME[[ VERSION]]",
)
#: Forms that state terms which no catalogue names.
OUTSIDE_SENTENCES = (
    "all rights reserved[[[.;,] use is subject to <<rest>>]]",
    "(proprietary and confidential|proprietary|confidential)[[ <<rest>>]]",
)
COPYRIGHT = "(copyright|copr.)[[ \\(c\\)| ©]][[ <<years>>]] <<holder>>[[. all rights reserved]]"

_UNITS = re.compile(r"\[\[|\]\]|<<\w+>>|VERSION|NAME")
_VERSION = r"(?:,?\s*(?:version|vers\.|fassung|draft|release|v\.?)?\s*(?P<version_N>\d+(?:\.\d+)*))"
_REPLACED = {"thing": r"[\w'-]+(?:\s+[\w'-]+){0,3}?", "rest": r".+?", "years": r"\d{4}(?:\s*[-,–]\s*\d{4})*", "holder": r"[^.;]{1,80}?"}


def compiled(template: str, name: str) -> str:
    """The regular expression of a template; versions are numbered groups ``version_<k>``, the name ``name``."""
    out, at, k = [], 0, 0
    for m in _UNITS.finditer(template):
        out.append(re.sub(r" +", r"\\s+", template[at : m.start()]))
        word, at = m.group(), m.end()
        if word == "[[":
            out.append("(?:")
        elif word == "]]":
            out.append(")?")
        elif word == "VERSION":
            k += 1
            if out and out[-1].endswith(r"\s+"):  # the version brings its own blanks and comma
                out[-1] = out[-1].removesuffix(r"\s+") + r"(?:\s*)"
            out.append(_VERSION.replace("_N", f"_{k}"))
        elif word == "NAME":
            out.append(f"(?P<name>{name})")
        else:
            out.append(f"(?:{_REPLACED[word[2:-2]]})")
    out.append(re.sub(r" +", r"\\s+", template[at:]))
    return "".join(out)


class License(NamedTuple):
    license_id: str
    title: str
    version: str
    notice: str
    body: str


_ITEM = r"(?:\(?\d{1,2}[.)]\s*|[-*•]\s+)?"


#: Letters of a first word by which terms and notices are looked up.
START = 6
_ITEM_HERE = re.compile(_ITEM)


def _first_word(text: str) -> str:
    for line in text.split("\n"):
        bare = re.sub(r"^\s*(?:\(?\d{1,2}[.)]|[-*•])\s+", "", line.strip())
        if bare:
            return bare.split()[0].lower()
    return ""


def _flexible(text: str) -> str:
    """A text with any blanks between its words, and any or no marks before its items."""
    out = []
    for line in re.split(r"\n\s*\n|\n", text):
        line = re.sub(r"^\s*(?:\(?\d{1,2}[.)]|[-*•])\s+", "", line.strip())
        if line:
            out.append(_ITEM + r"\s+".join(map(re.escape, line.split())))
    return r"\s*".join(out)


#: What may stand between two words of a statement in a raw text: blanks, comment marks and item numbers.
_BETWEEN = r"[\W\d_]+"
# Lower-case patterns, one of which every sentence form, tag and form without a catalogue name holds, whatever license it names.
_HINTS = (
    "licen", "lizenz", "spdx", "proprietary", "confidential", f"rights{_BETWEEN}reserved", f"governed{_BETWEEN}by",
    rf"(?:offered|distributed|released|available|provided|published|shared){_BETWEEN}under\b", rf"you{_BETWEEN}may{_BETWEEN}(?:use|copy|share|redistribute|distribute){_BETWEEN}this",
)


def _opening(text: str) -> str:
    """A lower-case pattern of the first two words of a notice or of terms, item marks apart."""
    bare = re.sub(r"^\s*(?:\(?\d{1,2}[.)]|[-*•])\s+", "", text.strip())
    return _BETWEEN.join(map(re.escape, bare.lower().split()[:2]))


class Grammar:
    """The catalogue's statements."""

    def __init__(self, catalogue: list[License]):
        self.ids = {c.license_id.lower(): c.license_id for c in catalogue}
        self.by_title: dict[tuple[str, str], str] = {}
        titles: dict[str, set] = {}
        for c in catalogue:
            short = re.sub(r"-[\d.]+$", "", c.license_id)
            for t in {c.title.lower(), short.lower()}:
                self.by_title[t, c.version] = c.license_id
                titles.setdefault(t, set()).add(c.license_id)
        self.alone = {t: next(iter(s)) for t, s in titles.items() if len(s) == 1}
        known = sorted({*titles, *self.ids}, key=len, reverse=True)
        names = "|".join(r"\s+".join(map(re.escape, n.split())) for n in known)
        name = rf"(?:{names})\b|(?:[a-z][\w.'-]*\s+){{0,5}}?[a-z][\w'-]*\s+(?:public\s+)?(?:licen[cs]e|terms|grant)\b"
        flags = re.I | re.S
        self.copyright = re.compile(compiled(COPYRIGHT, name) + r"[.,;]?\s*", flags)
        self.sentences = [re.compile(compiled(s, name) + r"[.!]?\s*", flags) for s in SENTENCES]
        self.outside = [re.compile(compiled(s, name) + r"[.!]?\s*", flags) for s in OUTSIDE_SENTENCES]
        self.tag = re.compile(r"(?:spdx-license-identifier\s*:|@licen[cs]e\b\s*:?)\s*(?P<expr>(?:\(\s*)*[\w.+-]+(?:\s*\))*(?:\s+(?:and|or|with)\s+(?:\(\s*)*[\w.+-]+(?:\s*\))*)*)\s*", re.I)
        self.notices = [(re.compile(_flexible(c.notice) + r"\s*", flags), c.license_id) for c in catalogue if c.notice]
        self.bodies = [(re.compile(_flexible(c.body) + r"\s*", flags), c.license_id) for c in catalogue if c.body]
        self.by_start: dict[str, list[int]] = {}
        self.texts = (*self.bodies, *self.notices)
        for i, text in enumerate([c.body for c in catalogue if c.body] + [c.notice for c in catalogue if c.notice]):
            self.by_start.setdefault(_first_word(text)[:START], []).append(i)
        title = "|".join(r"\s+".join(map(re.escape, t.split())) for t in sorted({c.title for c in catalogue}, key=len, reverse=True))
        self.title = re.compile(rf"(?:the\s+)?(?P<name>{title})(?:{_VERSION.replace('_N', '_1')})?(?:\s*\((?P<id>[\w.+-]+)\))?[.:]?\s*", flags)
        words = {max(c.title.lower().split(), key=len) for c in catalogue} | {k.split("-")[0] + "-" for k in self.ids}
        self.starts = [(re.compile(_opening(c.body)), pattern) for c, (pattern, _) in zip([c for c in catalogue if c.body], self.bodies, strict=True)]
        openings = {_opening(t) for c in catalogue for t in (c.notice, c.body) if t and t.strip()}
        self.hint = re.compile("|".join((*_HINTS, *sorted(map(re.escape, words)), *sorted(openings))))

    def resolve(self, name: str, versions: list[str]) -> str | None:
        plain = " ".join(name.lower().split())
        if plain in self.ids:
            return self.ids[plain]
        plain = re.sub(r"\s+licen[cs]e$", "", plain) if (plain, versions[0] if versions else "") not in self.by_title and plain not in self.alone else plain
        for v in versions:
            if (plain, v) in self.by_title:
                return self.by_title[plain, v]
        return self.alone.get(plain) if not versions else None

    def expression(self, text: str) -> str | None:
        """An expression of ids in catalogue spelling; OUTSIDE with an unknown id or exception; None if it states nothing.

        AND binds closer than OR.  What stands in parentheses is multiplied out,
        so that the expression is written without any: ids of one alternative
        are joined by AND, alternatives by OR, both in alphabetical order.
        """
        words = re.findall(r"[\w.+-]+|[()]", text)
        if not words or words[0].lower() in ("noassertion", "none", "see"):
            return None
        at = 0

        def ahead(word: str) -> bool:
            return at < len(words) and words[at].lower() == word

        def either() -> list[frozenset]:
            nonlocal at
            out = both()
            while ahead("or"):
                at += 1
                out += both()
            return out

        def both() -> list[frozenset]:
            nonlocal at
            out = one()
            while ahead("and"):
                at += 1
                right = one()
                if len(out) * len(right) > MOST_ALTERNATIVES:
                    raise ValueError
                out = [a | b for a in out for b in right]
            return out

        def one() -> list[frozenset]:
            nonlocal at
            word = words[at] if at < len(words) else ")"
            at += 1
            if word == "(":
                out = either()
                if not ahead(")"):
                    raise ValueError
                at += 1
                return out
            if word == ")" or word.lower() in ("and", "or", "with"):
                raise ValueError
            if ahead("with"):
                word, at = " ".join(words[at - 1 : at + 2]), at + 2
            return [frozenset([self.ids.get(word.lower(), OUTSIDE)])]

        try:
            found = either()
        except ValueError:
            return OUTSIDE
        if at < len(words) or any(OUTSIDE in a for a in found):
            return OUTSIDE
        # an alternative that asks for more than another adds nothing
        least = {a for a in found if not any(b < a for b in found)}
        return " OR ".join(sorted(" AND ".join(sorted(a)) for a in least))

    def _versions(self, m: re.Match) -> list[str]:
        return [v for k, v in m.groupdict().items() if k.startswith("version_") and v]

    def _beginning(self, unit: str, at: int) -> list[tuple[re.Pattern, str]]:
        """The terms and notices, in order, whose first word's beginning stands at a place of a unit, item mark apart."""
        some: set[int] = set()
        for place in {at, _ITEM_HERE.match(unit, at).end()}:
            word = unit[place : place + START].lower()
            for n in range(len(word) + 1):
                some.update(self.by_start.get(word[:n], ()))
        return [self.texts[i] for i in sorted(some)]

    def complete(self, unit: str) -> list[str]:
        """What a unit states, if statements and copyright lines make up all of it; else nothing."""
        out, at, n = [], 0, len(unit)
        while at < n:
            best: tuple[int, list[str]] | None = None
            if m := self.tag.match(unit, at):
                best = (m.end(), [e] if (e := self.expression(m.group("expr"))) else [])
            if not best:
                for pattern, found in self._beginning(unit, at):
                    if m := pattern.match(unit, at):
                        best = (m.end(), [found])
                        break
            if not best:
                for pattern in self.sentences:
                    # the longest reading that a sentence end or the unit's end follows
                    if (m := pattern.match(unit, at)) and (m.end() == n or unit[m.end() - 1] in ".! " or m.group().rstrip().endswith(".")):
                        best = (m.end(), [self.resolve(m.group("name"), self._versions(m)) or OUTSIDE])
                        break
            if not best:
                for pattern in self.outside:
                    if m := pattern.match(unit, at):
                        best = (m.end() if "rest" not in pattern.pattern else n, [OUTSIDE])
                        if m.end() < n and not re.match(r"[A-Z(]|$", unit[m.end() :]):
                            best = (n, [OUTSIDE])
                        break
            if not best and (m := self.title.match(unit, at)):
                # a title line says something only before terms or for itself in a license file
                follows = any(p.match(unit, m.end()) for p, _ in self.bodies)
                if follows or m.end() == n:
                    best = (m.end(), [] if follows else [f"<title>{(self.ids.get((m.group('id') or '').lower()) or self.resolve(m.group('name'), self._versions(m)) or OUTSIDE)}"])
            if not best:
                for cut_at in self._copyright_ends(unit, at):
                    best = (cut_at, [])
                    break
            if not best:
                return []
            at = best[0]
            out += best[1]
        return out

    def _copyright_ends(self, unit: str, at: int):
        m = self.copyright.match(unit, at)
        if not m:
            return
        # a holder ends at a full stop, a line end or the unit's end
        stop = re.compile(r"[.\n]\s*|$").search(unit, m.end() - 1 if unit[m.end() - 1 : m.end()] in (".", "\n", " ") else m.end())
        yield max(m.end(), stop.end()) if stop else m.end()


@lru_cache(maxsize=4)
def _grammar(catalogue: tuple[License, ...]) -> Grammar:
    """The grammar of a catalogue, compiled once in a Python worker."""
    return Grammar(list(catalogue))


# --- Files -----------------------------------------------------------------------

_LICENSE_FILE = re.compile(r"(?i)^(?:un)?(?:licen[cs]es?|copying)(?:[._-][\w.-]*)?$")
# Names of manifests whose license value counts.
MANIFESTS = ("package.json", "composer.json", "bower.json", "pyproject.toml", "cargo.toml", "setup.cfg", "pom.xml")
_PREFIX = re.compile(r"^[ \t]*(?://+!?|#+!?|\*+/?|/\*+!?|--+|;+|<!--+|\"\"\"|'''|>|%+)?[ \t]?")
_SUFFIX = re.compile(r"[ \t]*(?:\*+/|-->|\"\"\")?[ \t\r]*$")
_JSON_LICENSE = re.compile(r'"licen[cs]e"\s*:\s*"((?:[^"\\]|\\.)*)"')
_TOML_LICENSE = re.compile(r"(?im)^\s*licen[cs]e\s*=\s*(?:\{[^}\n]*?\btext\s*=\s*)?[\"']([^\"'\n]+)[\"']")
_PY_LICENSE = re.compile(r"(?m)^__licen[cs]e__\s*=\s*[\"']([^\"'\n]+)[\"']")
_POINTER = re.compile(r"(?i)^\s*(?:see|siehe|voir|terms are|the terms are|refer to|file:|licen[cs]e file)\b")


def is_license_file(path: str) -> bool:
    name = posixpath.basename(path)
    return bool(_LICENSE_FILE.match(name)) and ending(name) not in CODE_ENDINGS


def is_manifest(path: str) -> bool:
    return posixpath.basename(path).lower() in MANIFESTS


def _value(grammar: Grammar, value: str) -> str | None:
    value = value.strip()
    if not value or _POINTER.match(value):
        return None
    if value.lower() in ("unlicensed", "proprietary"):
        return OUTSIDE
    m = grammar.title.fullmatch(value)
    if m:
        return grammar.resolve(m.group("name"), grammar._versions(m)) or OUTSIDE
    return grammar.expression(value)


def _manifest_value(path: str, text: str) -> str | None:
    name = posixpath.basename(path).lower()
    if name.endswith(".json"):
        try:
            held = json.loads(text)
            got = held.get("license", held.get("licence")) if isinstance(held, dict) else None
            return got.get("type") if isinstance(got, dict) else got if isinstance(got, str) else None
        except ValueError:
            m = _JSON_LICENSE.search(text)
            return m.group(1) if m else None
    m = _TOML_LICENSE.search(text)
    return m.group(1) if m else None


def paragraphs(text: str):
    """Comment text without comment marks, by paragraphs and code breaks; lines are kept apart by line feeds."""
    kept: list[str] = []
    for line in text.split("\n"):
        bare = _SUFFIX.sub("", _PREFIX.sub("", line, count=1)).strip()
        if bare:
            kept.append(bare)
        elif kept:
            yield kept
            kept = []
    if kept:
        yield kept


def _run(grammar: Grammar, blocks: list[list[str]], i: int) -> tuple[int, list[str]] | None:
    """Full terms that begin in block *i* and go on in the next ones: (the block behind, what the run of blocks states)."""
    first = "\n".join(blocks[i])
    low, rest = first.lower(), None
    for start, pattern in grammar.starts:
        for m in start.finditer(low):
            if rest is None:
                rest, ends, at = "\n".join("\n".join(b) for b in blocks[i:]), {}, -1
                for j, b in enumerate(blocks[i:], i + 1):
                    at += sum(map(len, b)) + len(b)
                    ends[at] = j
            found = pattern.match(rest, m.start())
            end = len(rest[: found.end()].rstrip()) if found else -1
            if end in ends and (got := grammar.complete(rest[:end])):
                return ends[end], got
    return None


def statements(grammar: Grammar, path: str, text: str) -> set[str]:
    """The expressions (and OUTSIDE) that a file states about itself."""
    said: set[str] = set()
    own = is_license_file(path)
    if is_manifest(path) and (value := _manifest_value(path, text)) and (e := _value(grammar, value)):
        said.add(e)
    if ending(path) in ("py", "pyi"):
        said |= {e for v in _PY_LICENSE.findall(text) if (e := _value(grammar, v))}
    if own or grammar.hint.search(text.lower()):
        blocks = list(paragraphs(text))
        if own:
            # a license file as a whole: titles, copyright lines and terms
            whole = grammar.complete("\n".join("\n".join(b) for b in blocks))
            found = {w.removeprefix("<title>") for w in whole}
            if not found:
                found = {w.removeprefix("<title>") for b in blocks for w in grammar.complete("\n".join(b))}
                pointer = all(_POINTER.match(b[0]) for b in blocks)
                if not found and blocks and not pointer:
                    found = {OUTSIDE}
            return said | found
        behind = 0
        for i, block in enumerate(blocks):
            if i < behind:
                continue
            joined = "\n".join(block)
            if not grammar.hint.search(joined.lower()):
                continue
            got = grammar.complete(joined)
            if not got and (run := _run(grammar, blocks, i)):
                behind, got = run
            if not got:
                got = [w for line in block for w in grammar.complete(line)]
            said |= {w for w in got if not w.startswith("<title>")}
    return said


def settled(said: set[str]) -> str | None:
    """The expression of a set of statements; None if there are none."""
    if not said:
        return None
    if len(said) > 1:
        return CONFLICT
    one = next(iter(said))
    return UNKNOWN if one == OUTSIDE else one


# --- The operator ----------------------------------------------------------------

#: A catalogue of more rows isn't taken as one.
MOST_LICENSES = 10_000


def license_of(documents: DataFrame, catalogue: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text", tree: str = "snapshot_id", salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(files, trees): (doc_id, license_expression) and (tree, license_expression).

    One row for each document and for each tree (null trees give none).  An expression is an id of
    the catalogue, ids joined by AND or OR, CONFLICT or UNKNOWN.  Null paths
    count as files of the top directory, null texts as empty.  Rows with a
    repeated doc_id are judged one by one.  Other columns are ignored.
    """
    rows = catalogue.select("license_id", "title", "terms_version", "notice", "body").where(F.col("license_id").isNotNull()).limit(MOST_LICENSES + 1).collect()
    if len(rows) > MOST_LICENSES:
        raise ValueError(f"a catalogue of more than {MOST_LICENSES} licenses")
    held = tuple(sorted(License(r.license_id, r.title or r.license_id, r.terms_version or "", r.notice or "", r.body or "") for r in rows))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(tree).alias("tree"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(text, F.lit("")).alias("text"))

    def judge(key, root, where, body, grammar: Grammar):
        said = statements(grammar, where, body)
        where = posixpath.normpath(where).lstrip("/") if where else ""
        holds = is_license_file(where) or (is_manifest(where) and bool(said))
        yield key, root, posixpath.dirname(where), settled(said), sorted(said), holds

    key_type, tree_type = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "tree"))
    judged = cut(per_row(docs, judge, f"doc_id {key_type}, tree {tree_type}, folder string, own string, said array<string>, holds boolean", lambda: {"grammar": _grammar(held)}))

    # a directory's license; only license files and manifests of one directory meet
    holding = judged.where("holds")
    folders = (
        holding.select("tree", "folder", F.explode_outer("said").alias("s"))
        .groupBy("tree", "folder")
        .agg(F.count_distinct("s").alias("n"), F.max("s").alias("s"))
        .select("tree", "folder", F.when(F.col("n") > 1, CONFLICT).when((F.col("n") == 0) | (F.col("s") == OUTSIDE), UNKNOWN).otherwise(F.col("s")).alias("license"))
    )
    salted = folders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = F.split("folder", "/")
    upwards = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    asking = judged.where(F.col("own").isNull()).withColumn("row", F.monotonically_increasing_id())
    asked = asking.select("row", "doc_id", "tree", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.posexplode(upwards).alias("deep", "folder"))
    given = asked.join(salted, ["tree", "folder", "salt"], "left").groupBy("row").agg(F.max_by("doc_id", "deep").alias("doc_id"), F.max(F.when(F.col("license").isNotNull(), F.struct("deep", "license"))).alias("best"))
    files = judged.where(F.col("own").isNotNull()).select("doc_id", F.col("own").alias("license_expression")).unionByName(given.select("doc_id", F.coalesce("best.license", F.lit(UNKNOWN)).alias("license_expression")))
    top = folders.where(F.col("folder") == "").select("tree", "license")
    trees = judged.where(F.col("tree").isNotNull()).select("tree").distinct().join(top, "tree", "left").select("tree", F.coalesce("license", F.lit(UNKNOWN)).alias("license_expression"))
    return files, trees
