import pytest

from strataloom.llm import fileclass as C

LICENSE = "".join(f"# Line {i} of a long license, with permission and without warranty.\n" for i in range(120))
CODE = "\n".join(f"def f{w}(x):\n    y = x.{w}\n    return y * {i}" for i, w in enumerate("abcdefghij"))
STUB = "# Code generated by tool v1. DO NOT EDIT.\n" + CODE


@pytest.mark.parametrize(
    "path,text,expected",
    [
        ("a.py", LICENSE + "# maintained by hand\n# Code generated by x\n" + CODE, ""),
        ("a.py", LICENSE + "# y v1.2.3 -- upstream release, see the y project\n" + CODE, "o"),
        ("npm-shrinkwrap.json", '{\n "dependencies": {' + ",".join(f'"p{i}": {{"version": "1.{i}"}}' for i in range(200)) + '},\n "lockfileVersion": 1}', "g"),
        ("a.py", "/* not closed " + LICENSE, ""),
    ],
)
def test_marks_behind_long_headers(path, text, expected):
    assert "".join(k for k, v in zip("gmob", C.shown(path, text), strict=True) if v) == expected


def test_copies_of_every_kind(spark):
    table = "var table = []float64{\n" + "".join(f"    0.{i}234, 0.{i}678, 0.{i}123, 0.{i}567, 0.{i}912,\n" for i in range(60)) + "}\n"
    config = "\n".join(f"option-{w}: {i}" for i, w in enumerate("abcdefghij"))
    short = "def one(x):\n    y = x.first\n    return y * 3\n"
    rows = [
        (1, "vendor/w/stub.py", STUB),
        (2, "lib/stub.py", STUB.replace("y = x.c", "y = x.cc")),
        (3, "vendor/w/t.go", "package a\n\n" + table),
        (4, "lib/t.go", "package a\n\n" + table),
        (5, "vendor/w/conf.ini", config),
        (6, "lib/conf.ini", config),
        (7, "vendor/w/short.py", short),
        (8, "lib/short.py", short),
        (9, "lib/longer.py", short + "    z = 1\n"),
        (10, "lib/other.py", "def two(x):\n    return 4 + x\n    # end\n    pass\n"),
    ]
    df = spark.createDataFrame([(*r, "s", "r") for r in rows], "doc_id int, path string, text string, snapshot_id string, repository_id string")
    vendored = {r.doc_id for r in C.classify(df).where("file_class = 'vendored'").collect()}
    assert vendored == {1, 2, 3, 4, 5, 6, 7, 8}
    assert {r.file_class for r in C.classify(df).where("doc_id = 2").collect()} == {"generated", "vendored"}
