"""Tables on their way through several steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_FILE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder; only on one machine (a local master, as in
    tests) a temporary folder is taken and set as checkpoint folder where it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="citemill-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_made: dict[str, SparkSession] = {}  # folders that are left to delete
_path = "__citemill_path"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh shared path that is deleted with the driver at the latest."""
    if not _made:
        atexit.register(_drop_paths, _made)
    path = shared_dir(spark)
    _made[path] = spark
    return path


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and a lost
    executor costs no recomputation of what came before.  The folder goes when it is
    dropped, with its scope, or with the driver.  Of ``rows`` short rows at most, some thousands go to a
    file, so a small table isn't a file for each shuffle partition."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _path, path)
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what was stored, once nothing will be read from it again."""
    _drop_paths({p: _made.pop(p) for f in frames if (p := getattr(f, _path, None)) in _made})


def _drop_paths(paths: dict) -> None:
    try:
        for path, spark in list(paths.items()):
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    except (Py4JError, OSError, AttributeError):
        pass  # the driver's end may come first; the folder is the cluster's to clear then


@contextmanager
def scope():
    """Folders stored inside are deleted at its end, but for those of frames that are kept by ``keep``."""
    before, kept = set(_made), []
    yield kept.append
    keep = {getattr(f, _path, None) for f in kept}
    _drop_paths({p: _made.pop(p) for p in list(_made) if p not in before and p not in keep})
