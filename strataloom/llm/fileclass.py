"""Generated, minified and vendored files, and data saved as code.

Declared paths come first: attribute files (``.gitattributes``) are parsed once
each, their rules meet the paths below their directory in a join on (tree,
directory), and deeper files and later lines win.

Equivalent patterns are mined from what is declared: directories and name
endings under which nearly all files of several repositories are declared
generated (or vendored) hold for the repositories that declare nothing.  A tool
header, numbered definitions or a lock mark in a file's own text is such a
declaration too, so patterns for generated files come from both.  The layout of
minified code and the share of one literal are looked up in each text.
Vendored files are those declared, in vendor directories, or with a header that
names their origin, and files most of whose runs of lines stand in such a file.
"""

from __future__ import annotations

import posixpath
import re
from functools import lru_cache
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ._texts import per_row

# --- Attribute files ---------------------------------------------------------

# Attribute names that mark paths.
ATTRIBUTES = {"linguist-generated": "generated", "gitlab-generated": "generated", "generated": "generated", "linguist-vendored": "vendored", "vendored": "vendored"}


class Rule(NamedTuple):
    pattern: str
    kind: str  # generated or vendored
    state: str  # set, unset or unspecified


@lru_cache(maxsize=65_536)
def glob_regex(pattern: str) -> re.Pattern:
    """A path pattern as a regular expression over paths below its directory, by git's rules.

    A pattern without a slash matches names at any depth.  ``**`` spans
    directories where slashes or the pattern's ends stand around it, and is ``*``
    elsewhere.  A backslash takes the next character as it is.  A pattern that
    ends in a slash names a directory, which has no attributes, so no file matches.
    """
    if pattern.endswith("/") or not pattern.strip("/"):
        return re.compile(r"(?!)")
    anchored = "/" in pattern
    body = pattern.removeprefix("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        starts = i == 0 or body[i - 1] == "/"
        if starts and body.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif starts and body[i:] == "**":
            out.append(".+")
            i += 2
        elif c == "*":
            while body[i : i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        elif c == "[" and (m := _BRACKET.match(body, i)):
            out.append(_bracket(m.group(1), m.group(2)))
            i = m.end()
        else:
            out.append(re.escape(c))
            i += 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z", re.S)
    except re.error:  # a range that runs backwards matches nothing
        return re.compile(r"(?!)")


_BRACKET = re.compile(r"\[([!^]?)(\]?(?:\[:[a-z]+:\]|\\.|[^\]\\])*)\]")
# Named classes of characters in brackets.
_NAMED = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "xdigit": "0-9a-fA-F"}


def _bracket(negated: str, inner: str) -> str:
    members = []
    for m in re.finditer(r"\[:([a-z]+):\]|\\(.)|(.)-(?!\Z)(?:\\(.)|(.))|(.)", inner, re.S):
        named, escaped, low, high_escaped, high, one = m.groups()
        if named:
            members.append(_NAMED.get(named, ""))
        elif low:
            members.append(f"{re.escape(low)}-{re.escape(high_escaped or high)}")
        else:
            members.append(re.escape(escaped or one))
    return f"(?:(?!/)[{'^' if negated else ''}{''.join(members)}])" if members else "(?!)"


_WORDS = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))(.*)', re.S)


def parse_attributes(text: str) -> list[Rule]:
    """The rules of an attribute file that matter, in order.

    Macros (``[attr]name ...``) are replaced by what they stand for; negative
    patterns, which git forbids, and comments are left out.
    """
    out: list[Rule] = []
    macros: dict[str, list[tuple[str, str]]] = {}

    def meaning(words: list[str]) -> list[tuple[str, str]]:
        said = []
        for word in words:
            state = "set"
            if word[0] in "-!" and len(word) > 1:
                state, word = ("unset" if word[0] == "-" else "unspecified"), word[1:]
            name, _, value = word.partition("=")
            if value.lower() in ("false", "0", "no"):
                state = "unset"
            if name in ATTRIBUTES:
                said.append((ATTRIBUTES[name], state))
            elif state == "set" and name in macros:
                said += macros[name]
        return said

    for line in text.split("\n"):
        m = _WORDS.match(line.rstrip("\r"))
        if not m or (m.group(2) or "").startswith("#"):
            continue
        quoted, plain, rest = m.groups()
        words = rest.split()
        if plain and plain.startswith("[attr]"):
            macros[plain.removeprefix("[attr]")] = meaning(words)
            continue
        pattern = re.sub(r'\\(["\\])', r"\1", quoted) if quoted is not None else plain
        if pattern and not pattern.startswith("!"):
            out += [Rule(pattern, kind, state) for kind, state in meaning(words)]
    return out


def decided(below: str, rules: list[Rule]) -> dict[str, str]:
    """The state of each class that one attribute file gives a path below its directory; later lines win."""
    said: dict[str, str] = {}
    for pattern, kind, state in rules:
        if glob_regex(pattern).match(below):
            said[kind] = state
    return said


# --- What a text shows -------------------------------------------------------

# Directories that hold copies of other projects or written files.
VENDOR_DIRS = ("vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "external", "externals", "deps", "godeps", "pods", "carthage", "site-packages")
CODE_ENDINGS = ("py", "pyi", "go", "js", "jsx", "mjs", "cjs", "ts", "tsx", "java", "kt", "c", "h", "cc", "cpp", "hpp", "cs", "rs", "rb", "php", "sh", "bash", "sql", "swift", "scala", "lua", "css")
SQUEEZED_ENDINGS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "css")

_VENDOR_DIR = re.compile(r"(?i)(?:^|/)(?:" + "|".join(re.escape(d) for d in VENDOR_DIRS) + r")/(?=.*[^/]$)")
_COMMENT = r"^[ \t]*(?://+|#+|--|/?\*+!?|;+|<!--|\"\"\")[ \t]*"
_TOOL_HEADER = re.compile(
    _COMMENT
    + r"""(?x:.{0,40}\bcode\ generated\ (?:by|from)\b.* | auto-?\s?generated\b.* | <auto-?generated\b.* | .{0,30}\bproduced\ automatically\ by\b.* | @generated\b.* | .{0,30}\bautomatisch\ (?:erzeugt|generiert)\b.*
    | .{0,40}\b(?:is|was|been)\ (?:automatically\ |auto-?)generated\b.* | generated\ (?:by|from|with)\ (?!hand\b).*\b(?:do\ not|don't)\ (?:edit|modify)\b.* | source:\s*\S+\.(?:idl|proto|thrift|avsc|fbs|g4|graphql|wsdl|xsd)\b.*\bgenerator:.* | .{0,40}\b(?:fichier|archivo)\ (?:généré|generado)\b.*)$""",
    re.I | re.M,
)
_BY_HAND = re.compile(r"(?i)maintained by hand|hand-?written|no longer generated|stopped using generated")
_ORIGIN = re.compile(_COMMENT + r"(?:[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\S* (?:--|-|\|) (?:upstream|an? |copyright|released|https?:).*|upstream-(?:name|version|url)\s*:.*|copied (?:verbatim )?from [\w./@-]+@v?\d.*|vendored (?:from|copy of)\b.*)$", re.I | re.M)
_BANNER = re.compile(r"\A\s*/\*![ \t]*[\w.@/-]+[ \t]+v?\d+\.\d+\.\d+")
_LOCK = re.compile(r'"(?:lockVersion|lockfileVersion)"\s*:|^# (?:yarn lockfile|This file is automatically @generated by)|^GEM\n|"(?:_meta|content-hash)"\s*:', re.M)
_PINNED = re.compile(r'"integrity"\s*:\s*"sha\d+-')
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.*?-----END (?:[A-Z]+ )*PRIVATE KEY-----", re.S)
_DATA = re.compile(r"[A-Za-z0-9+/=\\]{40,}|(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[ \t]*,[ \t\r\n]*){20,}")
_QUIET = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_DEFINED = re.compile(r"^(?:export\s+|public\s+|default\s+|async\s+|static\s+)*(?:class|type|const|var|let|function|func(?:\s*\([^)]*\))?|def|struct|interface|enum|CREATE\s+\w+|INSERT\s+INTO|(?=[A-Za-z_]\w*\s*(?:=|:\s*$)))\s*\"?([A-Za-z_]\w*)", re.M)
_NUMBERED = re.compile(r"\d+$")


def ending(path: str) -> str:
    name = posixpath.basename(path)
    return name.rpartition(".")[2].lower() if "." in name else ""


def numbered(text: str) -> bool:
    """Whether nearly all definitions are one family counted through."""
    names = _DEFINED.findall(text)
    numbers = [int(m.group()) for n in names if (m := _NUMBERED.search(n))]
    kinds = len(set(numbers))
    # imports, loggers and tables of contents may stand beside them
    return kinds >= 5 and len(numbers) >= 0.8 * (len(names) - 3) and max(numbers) + 1 <= 1.5 * kinds and numbers[:1] <= [1]


def data_share(text: str) -> float:
    bare = _PRIVATE.sub("", text)
    return sum(m.end() - m.start() for m in _DATA.finditer(bare)) / len(text) if len(bare) == len(text) and text else 0.0


def squeezed(text: str, path: str) -> bool:
    """Code without the blanks and line breaks that people write."""
    if max(map(len, text.split("\n"))) <= 200:
        return False
    code = _QUIET.sub(lambda m: "" if m.group().startswith("/") else '""', text)
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return False
    blank = sum(map(code.count, " \t\n\r")) / len(code)
    return blank < 0.2 and len(code) / len(lines) > 100 and (max(map(len, lines)) > 400 or ".min." in path)


#: Blank lines and comments, as many as begin a text; marks of hand work and origin may stand there or soon after.
_LEADING = re.compile(r"\s*+(?:(?:(?:#|//|--|;)[^\n]*+|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"\"\".*?(?:\"\"\"|\Z)|<\?(?:php|xml[^\n>]*\?>))\s*+)*+", re.S)


def leading(text: str) -> int:
    """Where the leading comments of a text end, at 4 000 characters at least."""
    return max(4000, _LEADING.match(text).end())


def shown(path: str, text: str) -> tuple[bool, bool, bool, bool]:
    """(generated, minified, declares another origin, data blob) by a file's path and text alone."""
    end = ending(path)
    head = leading(text)
    hand = bool(_BY_HAND.search(text, 0, head))
    code = end in CODE_ENDINGS
    generated = False
    if end != "md":
        generated = bool(_TOOL_HEADER.search(text)) and not hand
        if not generated and end in ("json", "lock", "yaml", "sum", ""):
            generated = bool(_LOCK.search(text)) or (end in ("json", "lock") and len(_PINNED.findall(text)) >= 5)
        if not generated and (code or end in ("yaml", "yml")) and not hand:
            generated = numbered(text)
    blob = code and data_share(text) >= 0.8
    minified = end in SQUEEZED_ENDINGS and not blob and squeezed(text, path)
    origin = bool(_VENDOR_DIR.search(path)) or (code and bool(_ORIGIN.search(text, 0, head) or _BANNER.search(text)))
    return generated, minified, origin, blob


def path_patterns(path: str) -> list[str]:
    """Directories (single and in pairs) and name endings, from which rules are mined."""
    folder, name = posixpath.split(path)
    parts = [p for p in folder.split("/") if p]
    out = {f"dir:{p}" for p in parts} | {f"dir:{a}/{b}" for a, b in zip(parts, parts[1:], strict=False)}
    stem, _, _ = name.rpartition(".")
    if "." in stem:
        out.add("mid:." + stem.rpartition(".")[2])
    if "_" in stem:
        out.add("mid:_" + stem.rpartition("_")[2])
    return sorted(out)


#: Lines in a run whose hash stands for it.
RUN_LINES = 3
#: Beginnings of lines that say nothing about a file's origin.
_COMMON_LINES = ("//", "#", "*", "/*", "--", "import ", "from ", "package ", "using ", "use ", "include ", '"use strict"', "'use strict'", "log =", "logger =")


def line_runs(text: str) -> list[int]:
    """Hashes of all runs of RUN_LINES lines with something on them, without blanks around."""
    lines = [s for x in text.split("\n") if len(s := x.strip()) > 1 and not s.startswith(_COMMON_LINES)]
    if len(lines) < RUN_LINES and lines:
        # a squeezed file: its statements stand for lines
        lines = [s for x in re.split(r"(?<=[;}])", " ".join(lines)) if len(s := x.strip()) > 1]
    elif lines and sum(map(len, lines)) / len(lines) > 200:
        lines = [s for x in re.split(r"(?<=[;}])", "\n".join(lines)) if len(s := x.strip()) > 1]
    runs = {"\n".join(lines[i : i + RUN_LINES]) for i in range(len(lines) - RUN_LINES + 1)}
    return sorted(xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass")) - 2**63 for r in runs)


# --- The operator ------------------------------------------------------------

#: A mined path pattern holds from so many files on, in so many repositories, with such a share of generated (or vendored) ones.
MINED_FILES, MINED_REPOSITORIES, MINED_SHARE = 8, 3, 0.8
#: A file is a copy when this share of its runs of lines, and at least so many, stand in vendored files, or when its runs are just those of one of them.
COPIED_SHARE, COPIED_RUNS = 0.5, 4
#: Copies of the small side of a join on a key that many rows may share.
SALTS = 16
#: Runs of lines that take more than this part of a sample are spread over so many join keys; there are fewer than the inverse. It affects speed only.
HOT_SHARE, HOT_SALTS, SAMPLED = 0.001, 64, 64


def _semi(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows of *left* with a partner in *right*, whose keys are distinct; rows of one key are spread by the column *by*."""
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.hash(by), F.lit(SALTS))).join(many, [*keys, "_salt"], "left_semi").drop("_salt")


def declared_paths(seen: DataFrame) -> DataFrame:
    """(doc_id, said_generated, said_vendored) of the paths that attribute files decide; undecided ones have no row.

    seen: (doc_id, tree, path, rules); rules: those of an attribute file.  Only
    an attribute file's own rules meet a path of its directory and below.
    """
    folder = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    held = seen.where(F.size("rules") > 0).groupBy("tree", folder(F.col("path")).alias("folder")).agg(F.max("rules").alias("rules"))
    held = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = F.split(folder(F.col("path")), "/")
    upwards = F.when(folder(F.col("path")) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    asked = seen.where(F.col("path") != "").select("doc_id", "tree", "path", F.pmod(F.hash("path"), F.lit(SALTS)).alias("_salt"), F.explode(upwards).alias("folder"))
    met = asked.join(held, ["tree", "folder", "_salt"]).select("doc_id", "path", "folder", "rules")

    def decide(key, path, where, rules):
        for kind, state in decided(path[len(where) + 1 :] if where else path, [Rule(r["pattern"], r["kind"], r["state"]) for r in rules]).items():
            yield key, kind, where.count("/") + bool(where), state

    key_type = seen.schema["doc_id"].dataType.simpleString()
    rows = per_row(met, decide, f"doc_id {key_type}, kind string, deep int, state string")
    # the deepest file that says something about a class decides it
    said = lambda k: F.max_by(F.col("state"), F.when(F.col("kind") == k, F.col("deep")))
    final = rows.groupBy("doc_id").agg(said("generated").alias("g"), said("vendored").alias("v"))
    as_bool = lambda c: F.when(F.col(c) == "set", True).when(F.col(c) == "unset", False)
    return final.select("doc_id", as_bool("g").alias("said_generated"), as_bool("v").alias("said_vendored"))


def _mined(labelled: DataFrame, label: str) -> DataFrame:
    """Patterns under which nearly all files have the label, in several repositories; first summed up by repository, so that no pattern is hot."""
    by_repository = labelled.groupBy("pattern", "repository").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("hits"))
    return (
        by_repository.groupBy("pattern")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.count("repository").alias("repositories"))
        .where((F.col("n") >= MINED_FILES) & (F.col("repositories") >= MINED_REPOSITORIES) & (F.col("hits") >= MINED_SHARE * F.col("n")))
        .select("pattern")
    )


def _copies(seen: DataFrame) -> DataFrame:
    """doc_id of the files that are copies of files with another origin."""
    library = seen.where("origin").select(F.explode("runs").alias("run")).distinct()
    own = seen.where(~F.col("origin") & (F.size("runs") > 0)).select("doc_id", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    part = own.where(F.pmod(F.hash("doc_id"), F.lit(SAMPLED)) == 0)
    every = part.count()
    hot = [r.run for r in part.groupBy("run").count().where((F.col("count") > HOT_SHARE * every) & (F.col("count") > 100)).select("run").collect()]
    spread = F.col("run").isin(*hot) if hot else F.lit(False)
    many = library.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(spread, HOT_SALTS - 1).otherwise(0))))
    salted = own.withColumn("_salt", F.when(spread, F.pmod(F.hash("doc_id"), F.lit(HOT_SALTS))).otherwise(0))
    hits = salted.join(many, ["run", "_salt"]).groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("n").alias("n"))
    partly = hits.where((F.col("hits") >= COPIED_SHARE * F.col("n")) & (F.col("hits") >= COPIED_RUNS)).select("doc_id")
    # files of fewer runs are copies when their runs, which are sorted, are all those of a vendored file
    few = seen.where((F.size("runs") > 0) & (F.size("runs") < COPIED_RUNS)).select("doc_id", "origin", F.concat_ws(",", F.col("runs").cast("array<string>")).alias("all_runs"))
    wholly = _semi(few.where(~F.col("origin")).drop("origin"), few.where("origin").select("all_runs").distinct(), ["all_runs"], "doc_id").select("doc_id")
    return partly.unionByName(wholly).distinct()


def classify(documents: DataFrame, doc_id: str = "doc_id", path: str = "path", text: str = "text", tree: str = "snapshot_id", repository: str = "repository_id") -> DataFrame:
    """(doc_id, file_class), one row for each class of each file.

    Classes: ``generated``, ``minified``, ``vendored``, ``data_blob``; files
    without a row are hand-written.  *tree* tells which attribute files hold
    for a path; a null tree is a tree of its own.  Null or empty paths or texts
    have no class but what their path declares; repeated rows count once; other
    columns are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("tree"), F.col(repository).cast("string").alias("repository"))
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def look(key, tree_, repo, where, body):
        generated, minified, origin, blob = shown(where, body)
        end = ending(where)
        code = end in CODE_ENDINGS
        rules = parse_attributes(body) if posixpath.basename(where) == ".gitattributes" else []
        yield key, tree_, repo, where, generated, minified, origin, blob, code or end in ("yaml", "yml"), path_patterns(where) if body else [], line_runs(body), [r._asdict() for r in rules]

    seen = cut(
        per_row(
            docs.select("doc_id", "tree", "repository", "path", "text"),
            look,
            f"doc_id {key_type}, tree string, repository string, path string, generated boolean, minified boolean, origin boolean, blob boolean, code boolean, patterns array<string>, runs array<bigint>, rules array<struct<pattern:string,kind:string,state:string>>",
        )
    )

    base = seen.drop("rules", "path", "tree")
    nothing = {f"{p}_{c}": F.lit(None if p == "said" else False).cast("boolean") for p in ("said", "declares") for c in ("generated", "vendored")}
    if seen.where(F.size("rules") > 0).take(1):
        base = base.join(declared_paths(seen.select("doc_id", "tree", "path", "rules")), "doc_id", "left")
        # repositories that declare something about a class need no patterns for it
        kinds = F.transform("rules", lambda r: r["kind"])
        owners = seen.where(F.size("rules") > 0).groupBy("repository").agg(*[F.max(F.array_contains(kinds, c)).alias(f"declares_{c}") for c in ("generated", "vendored")])
        owners = owners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        base = base.withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(owners, ["repository", "_salt"], "left").drop("_salt")
        base = cut(base.na.fill(False, ["declares_generated", "declares_vendored"]))
    else:
        base = base.withColumns(nothing)

    # path patterns of generated files, by declarations and by the files' own texts, and of vendored ones, by declarations
    named = base.where("code").select("doc_id", "repository", F.coalesce("said_generated", "generated").alias("is_generated"), F.coalesce("said_vendored", F.lit(False)).alias("is_vendored"), "declares_generated", "declares_vendored", F.explode("patterns").alias("pattern"))
    taught = _mined(named, "is_generated").unionByName(_mined(named.where("declares_generated"), "is_generated")).distinct()
    generated = _semi(named.where(~F.col("is_generated") & ~F.col("declares_generated")), taught, ["pattern"], "doc_id").select("doc_id", F.lit(True).alias("mined_generated")).distinct()
    vendored = _semi(named.where(~F.col("is_vendored") & ~F.col("declares_vendored")), _mined(named.where("declares_vendored"), "is_vendored"), ["pattern"], "doc_id").select("doc_id", F.lit(True).alias("mined_vendored")).distinct()

    out = base.drop("patterns", "runs").join(generated, "doc_id", "left").join(vendored, "doc_id", "left").join(_copies(seen).withColumn("copied", F.lit(True)), "doc_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    classes = F.array_compact(
        F.array(
            F.when(F.coalesce("said_generated", yes("generated") | yes("mined_generated")), "generated"),
            F.when(yes("minified"), "minified"),
            F.when(F.coalesce("said_vendored", yes("origin") | yes("copied") | yes("mined_vendored")), "vendored"),
            F.when(yes("blob"), "data_blob"),
        )
    )
    return out.select("doc_id", F.explode(classes).alias("file_class")).distinct()
