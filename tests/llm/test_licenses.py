import pytest

from strataloom.llm import licenses as L

CAT = [
    L.License("AL-1.0", "Apple Tree License", "1.0", "This file is offered under the Apple Tree License, version 1.0; the full terms travel with the project.", "1. Share the fruit.\n\n2. Keep the tree for ten years."),
    L.License("AL-2.0", "Apple Tree License", "2.0", "This file is offered under the Apple Tree License, version 2.0; the full terms travel with the project.", "1. Share the fruit.\n\n2. Keep the tree for good."),
    L.License("PT-0.9", "Pear Terms", "0.9", "This file is offered under the Pear Terms, version 0.9; the full terms travel with the project.", "1. Eat it all.\n\n2. Nothing is promised."),
]
G = L.Grammar(CAT)


@pytest.mark.parametrize(
    "path,text,said",
    [
        ("a.py", "# SPDX-License-Identifier: al-1.0\nx = 1", {"AL-1.0"}),
        ("a.go", "/*\n * SPDX-License-Identifier:(PT-0.9 or al-1.0)\n */", {"AL-1.0 OR PT-0.9"}),
        ("a.go", "// SPDX-License-Identifier: LicenseRef-x\n", {L.OUTSIDE}),
        ("a.py", "# Copyright (c) 2020 The X Guild.\n# This file is offered under the Apple Tree\n# License, version 2.0; the full terms travel\n# with the project.\n\nx = 1", {"AL-2.0"}),
        ("a.sql", "-- You may use this under version 0.9 of the Pear Terms.\nSELECT 1;", {"PT-0.9"}),
        ("a.py", "x = 1\n# Lizenz: Pear Terms, Fassung 0.9\n", {"PT-0.9"}),
        ("a.py", "# License: Apple Tree License v1.0\n", {"AL-1.0"}),
        ("a.js", "// Released under the AL 2.0 licence.\nx", {"AL-2.0"}),
        ("a.js", "// Distributed under the terms of the Apple Tree License 1.0.\r\nx", {"AL-1.0"}),
        ("a.sh", "# All rights reserved; use is subject to your signed agreement.\n", {L.OUTSIDE}),
        ("a.sh", "# Licensed under the Gravel Public Terms, draft 4.\n", {L.OUTSIDE}),
        ("a.sh", "# Licensed under the Apple Tree License 7.7.\n", {L.OUTSIDE}),
        ("a.py", '__license__ = "pt-0.9"\n', {"PT-0.9"}),
        ("a.py", "# Apple Tree License Share the fruit. Keep the tree\n# for ten years.\n", {"AL-1.0"}),
        ("a.py", "# SPDX-License-Identifier: AL-1.0\n\n# SPDX-License-Identifier: PT-0.9\n", {"AL-1.0", "PT-0.9"}),
        ("LICENSE", "The Apple Tree License (AL-2.0)\n\nCopyright (c) 2020 The X Guild\n\n(1) Share the fruit.\n\n(2) Keep the tree\nfor good.\n", {"AL-2.0"}),
        ("COPYING", "APPLE TREE LICENSE VERSION 1.0\n\n- SHARE THE FRUIT.\n- KEEP THE TREE FOR TEN YEARS.\n", {"AL-1.0"}),
        ("LICENSE.txt", "House terms of use\n\n1. Knock first.", {L.OUTSIDE}),
        ("package.json", '{"name": "x", "license": "AL-1.0"}', {"AL-1.0"}),
        ("package.json", '{"name": "x", "license": "SEE LICENSE IN COPYING"}', set()),
        ("pyproject.toml", '[project]\nlicense = { text = "PT-0.9" }\n', {"PT-0.9"}),
        ("pyproject.toml", '[project]\nlicense = { file = "LICENSE" }\n', set()),
        # nothing
        ("a.py", "# The Apple Tree License was discussed for the x module and turned down.\n", set()),
        ("README.md", "# Hi\n\n## License\n\nSee the license file.\n", set()),
        ("license_check.py", "def check():\n    return 1\n", set()),
        ("LICENSE", "", set()),
        ("", "", set()),
    ],
)
def test_statements(path, text, said):
    assert L.statements(G, path, text) == said


def test_inheritance(spark):
    cat = spark.createDataFrame([tuple(c) for c in CAT], "license_id string, title string, terms_version string, notice string, body string")
    body = CAT[1].body
    rows = [
        (1, "s1", "LICENSE", f"Apple Tree License 2.0\n\n{body}"),
        (2, "s1", "src/a.py", "x = 1"),
        (3, "s1", "src/lib/LICENSE", "House terms"),
        (4, "s1", "src/lib/deep/b.py", "x = 1"),
        (5, "s1", "src/lib/c.py", "# SPDX-License-Identifier: PT-0.9"),
        (6, "s1", "pkg/package.json", '{"license": "PT-0.9"}'),
        (7, "s1", "pkg/COPYING", f"Apple Tree License 2.0\n\n{body}"),
        (8, "s1", "pkg/x/d.js", "let x;"),
        (9, "s1", "web/package.json", "{}"),
        (10, "s2", "e.py", None),
        (11, None, None, None),
        (12, "s1", "srcs/f.py", "# SPDX-License-Identifier: PT-0.9\n\n# SPDX-License-Identifier: AL-1.0\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, snapshot_id string, path string, text string").selectExpr("*", "'x' as license_id", "1 as salt")
    files, trees = L.license_of(docs, cat, salts=3)
    got = {r.doc_id: r.license_expression for r in files.collect()}
    assert got == {1: "AL-2.0", 2: "AL-2.0", 3: "UNKNOWN", 4: "UNKNOWN", 5: "PT-0.9", 6: "PT-0.9", 7: "AL-2.0", 8: "CONFLICT", 9: "AL-2.0", 10: "UNKNOWN", 11: "UNKNOWN", 12: "CONFLICT"}
    assert {r.tree: r.license_expression for r in trees.collect()} == {"s1": "AL-2.0", "s2": "UNKNOWN"}
    empty = L.license_of(docs.limit(0), cat)
    assert empty[0].collect() == [] and empty[1].collect() == []
    assert {r.license_expression for r in L.license_of(docs, cat.limit(0))[0].where("doc_id = 2").collect()} == {"UNKNOWN"}


@pytest.mark.parametrize(
    "text,expected",
    [
        ("(al-1.0 OR PT-0.9) AND AL-2.0", "AL-1.0 AND AL-2.0 OR AL-2.0 AND PT-0.9"),
        ("PT-0.9 OR AL-1.0 AND AL-2.0", "AL-1.0 AND AL-2.0 OR PT-0.9"),
        ("AL-1.0 AND (AL-1.0 OR PT-0.9)", "AL-1.0"),
        ("((PT-0.9))", "PT-0.9"),
        ("PT-0.9 AND AL-1.0", "AL-1.0 AND PT-0.9"),
        ("PT-0.9 WITH Core-exception", L.OUTSIDE),
        ("PT-0.9 OR Other-1", L.OUTSIDE),
        ("(PT-0.9 OR AL-1.0", L.OUTSIDE),
        ("NOASSERTION", None),
        ("", None),
    ],
)
def test_expressions(text, expected):
    assert G.expression(text) == expected


def test_a_choice_stays_a_choice():
    assert L.statements(G, "a.py", "# SPDX-License-Identifier: (AL-1.0 OR PT-0.9) AND AL-2.0\n") == {"AL-1.0 AND AL-2.0 OR AL-2.0 AND PT-0.9"}
    assert L.statements(G, "package.json", '{"license": "(AL-1.0 OR PT-0.9)"}') == {"AL-1.0 OR PT-0.9"}


def test_many_alternatives_are_of_no_catalogue():
    assert G.expression(" AND ".join(["(AL-1.0 OR PT-0.9)"] * 30)) == L.OUTSIDE
