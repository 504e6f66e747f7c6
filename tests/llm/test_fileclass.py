import pytest

from strataloom.llm import fileclass as C


def test_globs():
    ok = lambda p, path: bool(C.glob_regex(p).match(path))
    assert ok("*.js", "a/b/c.js") and not ok("/*.js", "a/c.js") and ok("/*.js", "c.js")
    assert ok("gen/**", "gen/a/b.go") and not ok("gen/**", "x/gen/a.go") and ok("**/gen/*.go", "x/gen/a.go") and ok("**/gen/*.go", "gen/a.go")
    # a directory pattern has no attributes to give, as in git
    assert not ok("docs/", "docs/a.md") and not ok("a/gen/", "a/gen/x.py") and not ok("/", "a")
    assert ok("a/**/b.c", "a/b.c") and ok("a/**/b.c", "a/x/y/b.c") and not ok("a**b", "ax/yb") and ok("a**b", "axyb")
    assert ok(r"\[x\].py", "[x].py") and not ok(r"\[x\].py", "x.py") and ok(r"a\*.py", "a*.py") and not ok(r"a\*.py", "ab.py") and ok("[[:digit:]]x", "7x") and ok("[a-c]]", "b]") and ok("[]x]", "]")
    assert not ok("[z-a]", "b") and ok("[", "[") and ok("[\\]]", "]") and not ok("a[/]b", "a/b")
    assert ok("a?[bc].t", "axb.t") and not ok("a?[!bc].t", "axb.t")


def said(path, files):
    """What attribute files (directory, text) say about a path, the deepest file last."""
    out = {}
    for folder, text in sorted(files, key=lambda f: (f[0].count("/"), bool(f[0]))):
        if not folder or path.startswith(folder + "/"):
            out |= C.decided(path[len(folder) + 1 :] if folder else path, C.parse_attributes(text))
    return {k: v == "set" for k, v in out.items() if v != "unspecified"}


def test_macros_quotes_and_forbidden_lines():
    rules = C.parse_attributes('[attr]machine linguist-generated -diff\n*.pb.go machine\n"a b.go" linguist-generated\n!x.go linguist-generated\n#c linguist-generated\n\\#d linguist-vendored\r\n\n   \n*.txt text eol=lf\n"open linguist-generated')
    assert [tuple(r) for r in rules] == [("*.pb.go", "generated", "set"), ("a b.go", "generated", "set"), ("\\#d", "vendored", "set"), ('"open', "generated", "set")]
    assert C.decided("#d", rules) == {"vendored": "set"}


def test_attribute_precedence():
    root = ("", "*.go linguist-generated\nvendor/** linguist-vendored\n/lib/x.go -linguist-generated\n# c\n")
    deeper = ("lib", "x.go linguist-generated=true\ny.go linguist-generated=false linguist-vendored\nz.go !linguist-generated")
    assert said("a.go", [root]) == {"generated": True}
    assert said("lib/x.go", [root]) == {"generated": False}
    assert said("lib/x.go", [deeper, root]) == {"generated": True}
    assert said("lib/y.go", [deeper, root]) == {"generated": False, "vendored": True}
    assert said("lib/z.go", [deeper, root]) == {}
    assert said("vendor/a/b.c", [root]) == {"vendored": True}


GENERATED = "\n\n".join(f"class Msg_a_{i}(Message):\n    x = {i}" for i in range(9))
HAND = "import os\n\ndef f(x):\n    return x + 1\n\ndef g(y):\n    return f(y) * 2\n"
MIN = "!function(e,t){" + "".join(f'var a{i}=t("{i}");a{i}.b=!0;if(e>{i})throw new Error("x");' for i in range(30)) + "}();"
BLOB = "var table = []float64{\n" + "    0.1234, 0.5678, 0.9123, 0.4567, 0.8912,\n" * 60 + "}\n"


@pytest.mark.parametrize(
    "path,text,expected",
    [
        ("a.py", "# Code generated by tool v1. DO NOT EDIT.\n" + HAND, "g"),
        ("a.py", HAND + "\n# automatisch erzeugt von tool, bitte nicht bearbeiten\n", "g"),
        ("a.py", GENERATED, "g"),
        ("a.py", 'BANNER = "# Code generated by our own tool. DO NOT EDIT."\n' + HAND, ""),
        ("a.py", "# We stopped using generated stubs here; this is maintained by hand\n# Code generated by x\n" + HAND, ""),
        ("code_generator.py", HAND, ""),
        ("package-lock.json", '{\n "lockfileVersion": 3,\n "packages": {}}', "g"),
        ("x.js", MIN, "m"),
        ("x.js", HAND, ""),
        ("x.go", "package a\n\n" + BLOB, "b"),
        ("third_party/x/y.py", HAND, "o"),
        ("lib/y.py", "# y v1.2.3 -- upstream release, see the y project\n" + HAND, "o"),
        ("vendors.py", HAND, ""),
        ("README.md", "Code generated by x. DO NOT EDIT.", ""),
        ("", "", ""),
    ],
)
def test_shown(path, text, expected):
    assert "".join(k for k, v in zip("gmob", C.shown(path, text), strict=True) if v) == expected


def test_classify(spark):
    lib = "\n".join(f"def lib_{w}(x):\n    y = x.{w}\n    return y * {i}" for i, w in enumerate("abcdefghij"))
    patched = lib.replace("y = x.c", "y = x.cc")
    rows = [
        (1, "vendor/w/w.py", lib, "s1", "r1"),
        (2, "lib/w.py", patched, "s1", "r1"),
        (3, "lib/own.py", HAND, "s1", "r1"),
        (3, "lib/own.py", HAND, "s1", "r1"),
        (4, ".gitattributes", "lib/own.py linguist-generated\n", "s2", "r2"),
        (5, "lib/own.py", HAND, "s2", "r2"),
        (6, None, None, None, None),
        (7, "", "", "s1", "r1"),
        (8, "x.js", MIN, "s1", "r1"),
    ]
    # nine written files under stubs/ teach the pattern, the tenth shows nothing itself
    rows += [(20 + i, f"stubs/f{i}.py", "# <auto-generated/>\n" + HAND, f"t{i}", f"q{i % 4}") for i in range(9)] + [(40, "stubs/last.py", HAND, "t1", "q1")]
    df = spark.createDataFrame(rows, "doc_id int, path string, text string, snapshot_id string, repository_id string").selectExpr("*", "'x' as generated", "1 as runs")
    got = {(r.doc_id, r.file_class) for r in C.classify(df).collect()}
    want = {(1, "vendored"), (2, "vendored"), (5, "generated"), (8, "minified"), (40, "generated")} | {(20 + i, "generated") for i in range(9)}
    assert got == want
    assert C.classify(df.limit(0)).collect() == []


def declaring(n, folder="made", kind="linguist-generated"):
    """Repositories that declare a directory, each with three files in it and one beside it."""
    for i in range(n):
        yield (1000 + 10 * i, ".gitattributes", f"{folder}/** {kind}\n", f"d{i}", f"d{i}")
        for k in range(3):
            yield (1001 + 10 * i + k, f"{folder}/f{k}.py", HAND.replace("x", f"x{i}{k}"), f"d{i}", f"d{i}")
        yield (1004 + 10 * i, "src/own.py", HAND.replace("y", f"y{i}"), f"d{i}", f"d{i}")


SCHEMA = "doc_id int, path string, text string, snapshot_id string, repository_id string"


@pytest.mark.parametrize("kind,name", [("linguist-generated", "generated"), ("linguist-vendored", "vendored")])
def test_patterns_are_mined_from_declarations(spark, kind, name):
    rows = list(declaring(3, "made", kind))
    rows += [(1, "made/a.py", HAND, "u", "undeclared"), (2, "src/a.py", HAND + "z = 1\n", "u", "undeclared"), (3, "made/x/.gitattributes", "a.py -" + kind, "w", "other"), (4, "made/x/a.py", HAND + "z = 2\n", "w", "other"), (5, "made/b.py", HAND + "z = 3\n", "w", "other")]
    got = {(r.doc_id, r.file_class) for r in C.classify(spark.createDataFrame(rows, SCHEMA)).collect()}
    declared = {(1001 + 10 * i + k, name) for i in range(3) for k in range(3)}
    # 5 stands in a repository that declares for itself, and declares nothing there
    assert got == declared | {(1, name)}
    # two repositories are too few to teach
    few = [*declaring(2, "made", kind), (1, "made/a.py", HAND, "u", "undeclared")]
    assert (1, name) not in {(r.doc_id, r.file_class) for r in C.classify(spark.createDataFrame(few, SCHEMA)).collect()}


def test_declarations_of_deep_and_equal_paths(spark):
    rows = [
        (1, ".gitattributes", "*.py linguist-generated\n", "s", "r"),
        (2, "a/.gitattributes", "b/*.py -linguist-generated\n", "s", "r"),
        (3, "a/b/.gitattributes", "x.py !linguist-generated linguist-vendored\n", "s", "r"),
        (4, "a/b/x.py", HAND, "s", "r"), (5, "a/b/y.py", HAND, "s", "r"), (6, "a/z.py", HAND, "s", "r"), (7, "a/b/x.py", HAND, "t", "r"),
    ]
    got = {(r.doc_id, r.file_class) for r in C.classify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(4, "vendored"), (6, "generated")}
