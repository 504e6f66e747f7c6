"""Running a Python function over the texts of a DataFrame, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of output that are gathered before a batch is handed on.
FLUSH_ROWS = 4096


def per_row(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str | StructType, setup: Callable[[], dict] | None = None, together: int = 0) -> DataFrame:
    """Rows that *fn* yields for each row of *df* (its columns as arguments).

    *setup* runs once per task and gives keyword arguments.  Inputs stream
    through in Arrow batches; nothing is kept across rows.  With *together*, fn
    takes a list of rows instead, of about so many characters in the last column.
    """
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = setup() if setup else {}
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        held: list[tuple] = []
        weight = 0
        for batch in batches:
            columns = [batch.column(n) for n in names]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in columns)
                if not together:
                    out.extend(fn(*row, **extra))
                else:
                    held.append(row)
                    weight += len(row[-1] or "")
                    if weight >= together or len(held) >= FLUSH_ROWS:
                        out.extend(fn(held, **extra))
                        held, weight = [], 0
                if len(out) >= FLUSH_ROWS:
                    yield flush()
        if held:
            out.extend(fn(held, **extra))
        if out:
            yield flush()

    return df.mapInArrow(run, kind)
