"""artifact_inventory over texts beyond the sizes of the data folders."""

from strataloom.plans import all_queries
from strataloom.sources.tree import MOST_TEXT


def test_long_texts_keep_their_lines(spark, tmp_path):
    texts = [(1, "a.txt", "x" * 59_999 + "\n"), (2, "b.txt", "line\n" * 20_000), (3, "c.txt", "y" * (MOST_TEXT - 1) + "\n"), (4, "d.txt", "z" * MOST_TEXT + "\n"), (5, "e.txt", "é" * 40_000)]
    spark.createDataFrame(texts, "doc_id bigint, path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: (r.status, r.line_count, r.size_bytes) for r in all_queries()["artifact_inventory"](spark, str(tmp_path)).collect()}
    assert got == {
        "1/a.txt": ("text", 1, 60_000),
        "2/b.txt": ("text", 20_000, 100_000),
        "3/c.txt": ("text", 1, MOST_TEXT),
        "4/d.txt": ("oversized", -1, MOST_TEXT + 1),
        "5/e.txt": ("text", 1, 80_000),
    }
