"""Row-wise Python over Arrow batches, for logic with sequential state inside one text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame


def expand_rows(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``fn(row dict) -> iterable of tuples`` of the columns in ``ddl``; one row in, any number out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema, names = to_arrow_schema(_parse_datatype_string(ddl)), df.columns

    def run(batches):
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
                rows += fn(dict(zip(names, values)))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return df.mapInArrow(run, ddl)
