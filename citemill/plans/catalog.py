"""All queries of the engine's own operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citemill.plans import q_checks, q_more, q_procedural, q_relational, q_text  # noqa: F401  (they register)
from citemill.plans.registry import ORACLES, QUERIES
from citemill.plans.views import Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per manuscript: citations by outcome, uncited references and the headline."""
    return q_relational.document_summary(Tables(spark, sf_dir))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
