"""Names of queries, and the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register ``fn(t) -> DataFrame`` under a name.  ``t(view)`` gives a table or a
    derived view; ``views`` are those that ``sql``, over the same names, needs."""
    from citemill.plans.views import Tables, with_views

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return put
