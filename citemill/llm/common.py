"""Small helpers shared by the operators: tables, batch sizes, and the shared folder of ``functions.staging``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from citemill.functions.staging import dropped, scope, scratch_dir, shared_dir, stored  # noqa: F401  (the operators take them from here)

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound Arrow batches by their bytes, as one text may be long.  The number of rows in a batch stays what
    the session says, so other queries of it keep their batches of short rows."""
    now = spark.conf.get(BATCH_BYTES).removesuffix("b")
    if not now.isdecimal() or int(now) > most:
        spark.conf.set(BATCH_BYTES, f"{most}b")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the frame has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string (made on the driver)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def record_batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def give_back() -> None:
    """Return what a task has freed to the system: a worker lives on, and the next stage's tasks need the room."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # where the C library has it
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, fn, ddl: str, done=give_back) -> DataFrame:
    """``fn(dict of Python lists) -> dict of columns`` over each Arrow batch; ``done`` at the task's end."""
    names, out = df.columns, arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = fn({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
                yield record_batch(out, [got[f.name] for f in out])
                del got
        done()

    return df.mapInArrow(run, ddl)
