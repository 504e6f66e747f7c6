import random

import pytest

from strataloom.llm import splitting as S
from strataloom.llm import tokens

PATH = tokens.default_path()


def check(text, most, overlap):
    out = S.split(text, most, overlap, PATH)
    assert "".join(text[p.core : p.end] for p in out) == text
    for i, p in enumerate(out):
        n = tokens.count(text[p.start : p.end], PATH)
        assert n == p.n_tokens and (n <= most or p.end - p.core == 1)
        assert p.start <= p.core < p.end
        if i:
            assert p.start >= out[i - 1].start
            assert tokens.count(text[p.start : p.core], PATH) <= overlap + 2
    return out


def texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    yield "\n\n".join("## Part\n\n" + " ".join(word() for _ in range(60)) + "." for _ in range(12))
    yield "\n".join("def f():\n    x = " + word() for _ in range(80))
    yield "x" * 5000
    yield "".join(word() + rnd.choice([" ", ",", "\r\n", "\t"]) for _ in range(900))
    yield "日本語のテキスト。" * 150
    yield "👩‍👩‍👧‍👦" * 80
    yield "".join(chr(rnd.randrange(0x100, 0x2FFF)) for _ in range(600))


@pytest.mark.parametrize("most,overlap", [(64, 8), (40, 0), (33, 32), (20, 50)])
def test_round_trip_and_limits(most, overlap):
    for text in texts():
        out = check(text, most, overlap)
        if overlap and overlap < most // 4:
            full = [p for p in out[1:] if tokens.count(text[p.start : p.core], PATH) >= overlap - 2]
            assert len(full) >= 0.8 * (len(out) - 1)


def test_token_starts():
    for text in [*texts(), "é\n" * 9, "a\ud800b", ""]:
        ids = tokens.encoding(PATH).encode_ordinary(text)
        assert tokens.starts(text, ids, PATH) == tokens.encoding(PATH).decode_with_offsets(ids)[1]


def test_natural_boundaries():
    text = next(texts())
    out = S.split(text, 64, 8, PATH)
    assert sum(text[p.core :].startswith("## Part") for p in out[1:]) >= 5


def test_pieces(spark):
    long = next(texts())
    rows = [(1, "short", "go"), (2, long, "markdown"), (3, long, None), (4, None, "go"), (5, "", "go"), (6, long, "huge"), (6, long, "huge")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "0 as piece", "1 as max_tokens")
    limits = spark.createDataFrame([("default", 100, 10), ("markdown", 50, 5), ("huge", 100000, 0), ("bad", None, 1)], "lang string, max_tokens int, overlap_tokens int")
    got = S.pieces(d, limits).collect()
    assert {r.doc_id for r in got} == {2, 3}
    assert max(r.n_tokens for r in got if r.doc_id == 2) <= 50 < max(r.n_tokens for r in got if r.doc_id == 3) <= 100
    for k in (2, 3):
        assert "".join(r.text[r.core_start - r.start :] for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)) == long
    assert {r.doc_id for r in S.pieces(d, limits, keep_short=True).collect()} == {1, 2, 3, 6}
    assert S.pieces(d.limit(0), limits).collect() == [] and S.pieces(d, limits.limit(0)).collect() == []


def test_boundaries_are_those_of_the_whole_text():
    # a heading line longer than any look-ahead, and long runs of blanks and line ends
    body = "word " * 60
    title = "T" * 900
    text = f"{body}\n\n{body}\n\n{title}\n{'=' * 900}\n\n{body}\n{body}"
    ends = S.Boundaries(text).strongest(1, len(text))
    assert ends == [text.index(title)]
    gap = "\n" * 60_000 + " " * 60_000
    assert S.Boundaries(f"a{gap}\n\n# b").strongest(1, 200_000) == [len(gap) + 3]
    parts = S.split(f"{body}{gap}{body}", 64, 0, PATH)
    assert "".join(f"{body}{gap}{body}"[p.start : p.end] for p in parts) == f"{body}{gap}{body}"
