"""The column functions of ``functions.text`` for values on the driver, where queries are parsed."""

from __future__ import annotations

import unicodedata


def tokens(text: str) -> list[str]:
    """As ``tokenize``: words split at case changes, lower-case, of more than one byte or beginning with a digit."""
    spaced = []
    for i, c in enumerate(text):
        if i and c.isupper() and (text[i - 1].islower() or (i + 1 < len(text) and text[i + 1].islower())):
            spaced.append(" ")
        spaced.append(c)
    out, word = [], ""
    for c in [*"".join(spaced), " "]:
        if c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            word += c
            continue
        low = word.lower()
        if word and (len(low.encode()) > 1 or unicodedata.category(word[0]) == "Nd"):
            out.append(low)
        word = ""
    return out
