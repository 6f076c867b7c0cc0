"""The corpus pipeline: documents through four operators, each stage written and
read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citemill.llm import jaccard, language_id, packing, quality
from citemill.llm.common import dropped, scope, stored, table


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.  Blank texts go; rows without a key or label are judged by text and
    site; repeated rows are each judged; an empty table stays empty; columns may have any names."""
    return quality.reject_poor(docs, table(spark, sf_dir, "labels"))


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined.  Texts without a letter go; rows without a key or language are judged alike
    and teach nothing; repeated rows are each judged; an empty table stays empty; columns may have any names."""
    return language_id.reject_unidentified(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; shingles of five
    words and a similarity of 0.8 or more.  Repeated rows become one; rows without a key stay, as do texts without
    words; very long texts are compared whole; an empty table stays empty; columns may have any names."""
    return jaccard.keep_representatives(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents, tokenised and packed.  A null text is packed as an empty one; repeated rows are packed each;
    a null key is kept; an empty table gives no rows; other columns are left out."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", of_quality), ("language ID", of_known_language), ("n-gram Jaccard join", without_near_copies), ("packing", packed)]

#: Tokenisation and training can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as keep:  # what a stage stored on its way goes with it
            after = stored(stage(spark, docs, sf_dir))
            keep(after)
        dropped(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
