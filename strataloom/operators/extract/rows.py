"""A Python function over each file, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def flat_map(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str, flush: int = 4096) -> DataFrame:
    """Rows that *fn* yields for each row, its columns as arguments; files stream through, nothing is kept."""
    kind = _parse_datatype_string(schema)
    arrow, names = to_arrow_schema(kind), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            columns = [b.column(n) for n in names]
            for i in range(b.num_rows):
                out.extend(fn(*[c[i].as_py() for c in columns]))
                if len(out) >= flush:
                    yield batch()
        if out:
            yield batch()

    return df.mapInArrow(run, kind)
