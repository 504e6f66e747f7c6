import os

import pytest
from oracle import FOLDER, rows_by_sql, rows_of

from strataloom.llm.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_by_sql(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_alike(spark, name):
    """Some rows, and the same ones when rows lie elsewhere."""
    first = rows_of(QUERIES[name](spark, FOLDER))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows_of(QUERIES[name](spark, FOLDER)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(first[1].values()) > 0


def test_found_columns(spark):
    want = {
        "p1_found": [("doc_id", "bigint"), ("start_line", "bigint"), ("kind", "string"), ("fingerprint", "string")],
        "p2_found": [("doc_id", "bigint"), ("file_class", "string")],
        "p3_found": [("subject_kind", "string"), ("subject_id", "string"), ("license_expression", "string")],
        "p6_found": [("doc_id", "bigint")],
        "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, FOLDER).dtypes == columns


def test_pieces_join_to_the_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    parts: dict = {}
    for r in QUERIES["p9_pieces"](spark, FOLDER).collect():
        parts.setdefault(r.doc_id, []).append(r)
    assert parts
    for k, rows in parts.items():
        rows.sort(key=lambda r: r.piece)
        assert "".join(r.text[r.core_start - r.start :] for r in rows) == texts[k]


def test_redaction_removes_all_findings(spark):
    from strataloom.llm import secrets

    out = QUERIES["p1_redacted"](spark, FOLDER)
    left = secrets.redaction_records(out).collect()
    assert left == []
