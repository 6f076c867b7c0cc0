"""Synthetic citations and defects, as column expressions over bibliographies."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def citation_plan(entries: DataFrame, by: str = "n") -> DataFrame:
    """Forms in a cycle over entries in order: narrative, parenthetical, locator, grouped (two
    entries, one marker); a short tail is parenthetical.  (doc_id, n, form, marker)"""
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(by)) - 1
    total = F.count("*").over(Window.partitionBy("doc_id"))
    rows = entries.withColumn("k", k).withColumn("total", total)
    place = F.pmod(F.col("k"), F.lit(5))
    form = F.when(place == 0, "narrative").when(place == 1, "parenthetical").when(place == 2, "locator").when((place == 3) & (F.col("k") == F.col("total") - 1), "parenthetical").otherwise("grouped")
    marker = F.floor(F.col("k") / 5) * 4 + F.least(place, F.lit(3))
    return rows.select("doc_id", "n", form.alias("form"), marker.cast("bigint").alias("marker"))


def mixed_numbering(text: Column, i: Column) -> Column:
    return F.when(i % 3 == 0, F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), text)).when(i % 3 == 1, F.concat((i + 1).cast("string"), F.lit(". "), text)).otherwise(text)


def smart_punctuation(text: Column) -> Column:
    """Straight pairs of quotes become curly, a hyphen between digits an en dash."""
    return F.regexp_replace(F.regexp_replace(text, '"([^"]*)"', "“$1”"), r"(\d)-(?=\d)", "$1–")


def truncate(text: Column, share: float) -> Column:
    return F.substring(text, F.lit(1), F.floor(F.length(text) * share).cast("int"))


def author_typo(name: Column) -> Column:
    """The middle character and the next change places (three characters or more)."""
    m = F.floor(F.length(name) / 2).cast("int")
    swapped = F.concat(F.substring(name, F.lit(1), m), F.substring(name, m + 2, F.lit(1)), F.substring(name, m + 1, F.lit(1)), F.substring(name, m + 3, F.length(name)))
    return F.when((F.length(name) >= 3) & (m + 1 < F.length(name)), swapped).otherwise(name)


def year_swap(year: Column) -> Column:
    """The second and third digit of a year of four change places."""
    y = year.cast("string")
    return F.when(F.length(y) == 4, F.concat(*(F.substring(y, k, 1) for k in (1, 3, 2, 4)))).otherwise(y)


def doi_typo(doi: Column) -> Column:
    """The last digit one higher, 9 to 0."""
    head, digit, tail = (F.regexp_extract(doi, r"(?s)^(.*)(\d)(\D*)\z", k) for k in (1, 2, 3))
    return F.when(digit == "", doi).otherwise(F.concat(head, F.pmod(digit.try_cast("int") + 1, F.lit(10)).cast("string"), tail))


def journal_abbreviation(name: Column) -> Column:
    """Initials of capitalised words, each with a stop; the name itself without such words."""
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    return F.coalesce(F.nullif(F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), ""), F.lit("")), name)


def doi_variants(rows: DataFrame, doi: str = "doi") -> DataFrame:
    """The four spellings of a DOI in print."""
    d = F.col(doi)
    spelt = F.array(d, *(F.concat(F.lit(p), d) for p in ("doi:", "https://doi.org/", "http://dx.doi.org/")))
    return rows.select("*", F.posexplode(spelt).alias("variant", "spelling"))


def page_swap(rows: DataFrame, value: str) -> DataFrame:
    """Neighbours (first and second, third and fourth ...) exchange a value."""
    w = Window.partitionBy("doc_id").orderBy("n")
    k = F.row_number().over(w)
    other = F.when(k % 2 == 1, F.lead(value).over(w)).otherwise(F.lag(value).over(w))
    return rows.withColumn("swapped", F.coalesce(other, F.col(value)))


def bibtex(rows: DataFrame) -> DataFrame:
    """One record per row, fields in fixed order, empty ones left out, & and _ escaped but in doi."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("\\&")), F.lit("_"), F.lit("\\_"))
    field = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), c, F.lit("},")))
    body = F.concat_ws("\n", F.concat(F.lit("@article{"), "key", F.lit(",")), field("author", esc(F.col("author"))), field("title", esc(F.col("title"))), field("journal", esc(F.col("outlet"))), field("year", F.col("year").cast("string")), field("doi", F.col("doi")), F.lit("}"))
    return rows.select("key", body.alias("record"))


# -- whole lists -------------------------------------------------------------------------
def merged_entries(text: Column) -> Column:
    """Every run of white space one blank, so no line starts an entry."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def seeded_order(entries: DataFrame, seed: int = 42) -> DataFrame:
    """Each list in an order that its seed fixes: ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("n", F.lit(seed)), "n"))
    return entries.withColumn("place", place.cast("bigint"))


def mixed_styles(prose: DataFrame, numbered: DataFrame) -> DataFrame:
    """(doc_id, place, text): the first half of a list in prose, then the first half of another, numbered from 1."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    half = lambda df: df.withColumn("i", place).withColumn("k", F.floor(F.count("*").over(Window.partitionBy("doc_id")) / 2)).where(F.col("i") <= F.col("k"))
    first = half(prose).select("doc_id", F.lit(0).alias("part"), "i", F.col("raw_text").alias("text"))
    second = half(numbered).select("doc_id", F.lit(1).alias("part"), "i", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.col("raw_text")).alias("text"))
    return first.unionByName(second).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "i")).cast("bigint").alias("place"), "text")


def running_headers(lines: DataFrame, header: str, every: int) -> DataFrame:
    """Lines (doc_id, line_no, text) with a header alone between blank lines after each ``every`` lines."""
    page = (F.col("line_no") + 1) % every == 0
    shown = F.when(page, F.array(F.col("text"), F.lit(""), F.lit(header), F.lit(""))).otherwise(F.array(F.col("text")))
    rows = lines.select("doc_id", "line_no", F.posexplode(shown).alias("k", "text"))
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "k")) - 1).cast("bigint").alias("line_no"), "text")


# -- entries ------------------------------------------------------------------------------
def author_order(authors: Column) -> Column:
    """Two authors or more in reverse."""
    return F.when(F.size(authors) >= 2, F.reverse(authors)).otherwise(authors)


def family_given(family: Column, given: Column) -> Column:
    return F.concat_ws(", ", F.nullif(family, F.lit("")), F.nullif(given, F.lit("")))


def without_volume(entries: DataFrame) -> DataFrame:
    """Entries whose volume and number are lost."""
    return entries.withColumns({c: F.lit(None).cast(entries.schema[c].dataType) for c in ("volume", "number") if c in entries.columns})


def duplicated(entries: DataFrame, key: str = "key") -> DataFrame:
    """Every row and a copy whose key says so."""
    return entries.unionByName(entries.withColumn(key, F.concat(F.col(key), F.lit("_dup"))))


def corrupted_at(entries: DataFrame, at: Column, **columns: Column) -> DataFrame:
    """Entries of which the ``at``-th of each document alone has other values."""
    return entries.withColumns({name: F.when(F.col("n") == at, new).otherwise(F.col(name)) for name, new in columns.items()})


def as_gold(entries: DataFrame) -> DataFrame:
    """What a catalogue would say of entries: title, year, first author, normalized DOI."""
    from citemill.functions.text import normal_doi

    return entries.select("doc_id", "n", "title", F.col("year").cast("string").alias("year"), F.get("authors", F.lit(0)).alias("first_author"), F.when(F.coalesce("doi", F.lit("")) != "", normal_doi(F.col("doi"))).alias("doi"))


def as_extracted(entries: DataFrame) -> DataFrame:
    """What a faultless reader would say of what is printed."""
    from citemill.functions.text import normal_doi

    return entries.select("doc_id", "n", "title", F.col("year").cast("string").alias("year"), F.col("authors").alias("surnames"), F.when(F.coalesce("doi", F.lit("")) != "", normal_doi(F.col("doi"))).alias("doi"))


def content_scores(original: DataFrame, printed: DataFrame, similarity, least: float = 0.85) -> DataFrame:
    """Whether each entry is still found in spite of its defect, by its DOI and by its title."""
    gold, read = as_gold(original), as_extracted(printed)
    both = gold.select("doc_id", "n", F.col("title").alias("g"), F.col("doi").alias("gd")).join(read.select("doc_id", "n", F.col("title").alias("r"), F.col("doi").alias("rd")), ["doc_id", "n"])
    titled = (F.coalesce("g", F.lit("")) != "") & (F.coalesce("r", F.lit("")) != "")
    return both.select("doc_id", "n", F.coalesce(F.col("gd") == F.col("rd"), F.lit(False)).alias("doi_match"), (titled & (similarity(F.col("g"), F.col("r")) >= least)).alias("title_match"))


#: Names of defects that a list or an entry may have, the stage each strikes; and how it is made here.
DEFECTS = (
    ("merged_entries", "split", "merged_entries"),
    ("mixed_numbering_styles", "split", "mixed_numbering"),
    ("unsorted_reference_list", "split", "seeded_order"),
    ("mixed_citation_styles", "split", "mixed_styles"),
    ("smart_quotes_and_dash_variants", "split", "smart_punctuation"),
    ("truncated_reference_list", "split", "truncate"),
    ("running_header_injection", "layout", "running_headers"),
    ("author_typo", "content", "author_typo"),
    ("year_transposition", "content", "year_swap"),
    ("page_range_swap", "content", "page_swap"),
    ("doi_digit_typo", "content", "doi_typo"),
    ("author_order", "content", "author_order"),
    ("journal_abbreviation", "content", "journal_abbreviation"),
    ("missing_fields", "content", "without_volume"),
    ("diacritics_lost", "content", "without_marks"),
    ("doi_url_variants", "merge", "doi_variants"),
    ("duplicate_reference", "merge", "duplicated"),
    ("duplicate_doi_different_works", "merge", "corrupted_at"),
)


def catalogue(spark) -> DataFrame:
    """The defects as a table (defect, stage, generator)."""
    return spark.createDataFrame(DEFECTS, "defect string, stage string, generator string")


def without_marks(text: Column) -> Column:
    """Letters without the marks that Unicode can part from them."""
    return F.regexp_replace(_decomposed(text), r"\p{M}+", "")


@F.pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))
