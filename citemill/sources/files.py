"""Manuscripts, corpora and stored service answers as DataFrames; sinks for reports and records."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Extracted manuscripts, one file a row: (doc_id, name, suffix, text)."""
    raw = spark.read.text(path, wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return raw.select(F.xxhash64("name").alias("doc_id"), "name", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).alias("suffix"), F.col("value").alias("text"))


#: How a file is read, by its suffix: extracted text as it is, or paragraphs of a word processor's text.
READERS = {".txt": "text", ".md": "text", ".docx": "paragraphs"}


def dispatched(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, name, text) read by their suffix, in any case: (doc_id, reader, k, part).  Paragraphs are parted by
    line ends; other suffixes are unsupported and have no text."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    reader = F.lit("unsupported")
    for s, how in READERS.items():
        reader = F.when(suffix == s, how).otherwise(reader)
    parts = F.when(F.col("reader") == "paragraphs", F.split("text", "\n")).when(F.col("reader") == "text", F.array("text")).otherwise(F.array(F.lit(None).cast("string")))
    return texts.withColumn("reader", reader).select("doc_id", "reader", F.posexplode(parts).alias("k", "part"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases: one JSON file a style, its cases exploded."""
    return spark.read.json(path, multiLine=True).select("style", F.explode("cases").alias("case")).select("style", "case.*")


def adapt_parsed(rows: DataFrame, column: str = "json") -> DataFrame:
    """Stored JSON of a line parser: first title, date and DOI of each, authors with a family name."""
    kind = "struct<title: array<string>, date: array<string>, doi: array<string>, author: array<struct<family: string, given: string>>>"
    x = F.from_json(column, kind)
    first = lambda c: F.try_element_at(c, F.lit(1))
    return rows.withColumn("x", x).select("doc_id", first(F.col("x.title")).alias("title"), first(F.col("x.date")).alias("year"), first(F.col("x.doi")).alias("doi"), F.filter(F.transform("x.author", lambda a: a.family), lambda f: f.isNotNull()).alias("surnames"))


SECTIONS = ("summary", "references", "outlets", "topics")


def report(title: str, tables: dict[str, DataFrame], included: dict[str, bool] | None = None, most_rows: int = 1_000) -> str:
    """An HTML report of small result tables; every value is escaped.  Tables are aggregates, and at
    most ``most_rows`` rows of each are shown, with a note where there are more."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        if included is not None and not included.get(name, True):
            continue
        rows = df.limit(most_rows + 1).collect()
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{html.escape('—' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows[:most_rows]]
        out.append("</table>" + "<p>More rows are in the table.</p>" * (len(rows) > most_rows))
    return "\n".join([*out, "</body></html>"])


def write_bibtex(records: DataFrame, path: str) -> None:
    records.select("record").write.mode("overwrite").text(path)
