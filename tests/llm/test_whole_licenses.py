import pytest
from test_licenses import CAT, G

from strataloom.llm import licenses as L


@pytest.mark.parametrize(
    "path,text,said",
    [
        ("a.sh", "# Released under the Gravel Public Terms, draft 4.\n", {L.OUTSIDE}),
        ("a.sh", "# Offered under the Gravel Public Grant.\n", {L.OUTSIDE}),
        ("a.go", "// Shared\n// under the Gravel Public Terms.\n", {L.OUTSIDE}),
        ("a.sh", "# Confidential\n", {L.OUTSIDE}),
        ("a.sh", "# All rights\n# reserved.\n", {L.OUTSIDE}),
        ("a.sh", "# You may use this under the Gravel Terms.\n", {L.OUTSIDE}),
        ("a.sh", "# Use of this file is governed by the Gravel Grant.\n", {L.OUTSIDE}),
        ("a.js", "// Distributed under AL 1.0.\nx", {"AL-1.0"}),
        ("a.py", "# Released under the Gravel Public Terms.\n\n# SPDX-License-Identifier: AL-1.0\n", {L.OUTSIDE, "AL-1.0"}),
        # full terms with blank comment lines between items, a title before and other text behind
        ("a.py", "# 1. Share the fruit.\n#\n# 2. Keep the tree\n#    for good.\n#\n# Helpers of the module.\nx = 1", {"AL-2.0"}),
        ("a.go", "/*\n * Apple Tree License, version 1.0\n *\n * Copyright (c) 2020 The X Guild\n * 1. Share the fruit.\n *\n * 2. Keep the tree for ten years.\n */\npackage a\n", {"AL-1.0"}),
        ("a.py", "# 1. Eat it all.\n#\n# 2. Nothing is promised.\n\n# SPDX-License-Identifier: AL-1.0\n", {"PT-0.9", "AL-1.0"}),
        # nothing
        ("a.py", "# 1. Share the fruit.\n#\n# 2. Keep the tree for good, they said.\nx = 1", set()),
        ("a.py", "# The build was released under pressure.\n", set()),
    ],
)
def test_whole_files(path, text, said):
    assert L.statements(G, path, text) == said


def test_every_notice_and_body_passes_the_hint():
    for c in CAT:
        for text in (c.notice, c.body):
            assert G.hint.search("# " + text.lower().replace(" ", "\n#  "))
