"""Counts, histograms and notes over check results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# The year ages are counted from, and the bins.
CURRENT_YEAR = 2026
AGE_BINS = [(0, 2, "0–2"), (3, 5, "3–5"), (6, 10, "6–10"), (11, 15, "11–15"), (16, 25, "16–25"), (26, 999, "25+")]
CITATION_BINS = [(0, 0, "0"), (1, 9, "1–9"), (10, 49, "10–49"), (50, 199, "50–199"), (200, 999, "200–999"), (1000, 10**12, "1000+")]
TOPIC_BARS, OUTLET_FLOOR = 8, 1


def metrics(results: DataFrame) -> DataFrame:
    """Counters of a document; review counts unchecked rows too, retracted counts TRUE only."""
    s = F.col("status")
    return results.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(s == "verified").alias("verified"),
        F.count_if(s.isin("review", "unchecked")).alias("review"),
        F.count_if(s == "halluc").alias("halluc"),
        F.count_if(s == "dup").alias("dup"),
        F.count_if(s == "unchecked").alias("unchecked"),
        F.count_if(F.col("retracted")).alias("retracted"),
    )


def percent_note(part, whole):
    """Whole percents, halves to even."""
    return F.when(whole > 0, F.concat(F.bround(100.0 * part / whole, 0).cast("int").cast("string"), F.lit("%"))).otherwise(F.lit("—"))


def first_per(rows: DataFrame, key) -> DataFrame:
    """Rows without a key, and of each key in a document the row of the smallest n."""
    w = Window.partitionBy("doc_id", key).orderBy("n")
    return rows.withColumn("__rn", F.when(key.isNull(), 1).otherwise(F.row_number().over(w))).where("__rn = 1").drop("__rn")


def outlet_breakdown(results: DataFrame, floor: int = OUTLET_FLOOR) -> DataFrame:
    rows = results.where(F.col("status").isin("verified", "dup") & (F.coalesce("outlet", F.lit("")) != ""))
    return first_per(rows, F.lower("doi")).groupBy("doc_id", "outlet").agg(F.count("*").alias("works")).where(F.col("works") > floor)


def topic_breakdown(results: DataFrame, bars: int = TOPIC_BARS) -> DataFrame:
    """The ``bars`` most frequent topics of each document."""
    rows = first_per(results.where(F.coalesce("topics", F.lit("")) != ""), F.lower("doi"))
    counts = rows.select("doc_id", F.explode(F.split("topics", ",")).alias("topic")).groupBy("doc_id", "topic").agg(F.count("*").alias("works"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("works"), F.desc("topic")))
    return counts.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= bars)


def binned(rows: DataFrame, value, bins) -> DataFrame:
    """(bin, label, rows) with empty bins; values outside all bins are in none."""
    spark = rows.sparkSession
    case = F.lit(None).cast("int")
    for k, (lo, hi, _) in enumerate(bins):
        case = F.when(value.between(lo, hi), k).otherwise(case)
    counts = rows.select(case.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("works"))
    frame = spark.createDataFrame([(k, label) for k, (_, _, label) in enumerate(bins)], "bin int, label string")
    return F.broadcast(frame).join(counts, "bin", "left").select("bin", "label", F.coalesce("works", F.lit(0)).alias("works"))


def age_bins(results: DataFrame) -> DataFrame:
    return binned(results.where(F.coalesce("year", F.lit(0)) != 0), CURRENT_YEAR - F.col("year"), AGE_BINS)


def unique_citations(results: DataFrame) -> DataFrame:
    """Citation counts of verified and duplicate rows, once per DOI as spelt."""
    return first_per(results.where(F.col("status").isin("verified", "dup") & F.col("citations").isNotNull()), F.col("doi"))


def citation_bins(results: DataFrame) -> DataFrame:
    return binned(unique_citations(results), F.col("citations"), CITATION_BINS)


def cited_by_text(crossref, openalex):
    text = lambda c, name: F.when(c.isNotNull(), F.concat(F.format_number(c, 0), F.lit(f" ({name})")))
    return F.coalesce(F.nullif(F.concat_ws(" / ", text(crossref, "Crossref"), text(openalex, "OpenAlex")), F.lit("")), F.lit("—"))


def cited_by_cell(status, crossref, openalex, merged):
    """What a table shows of a work's citations: nothing but for a match; by source, else the merged count."""
    either = crossref.isNotNull() | openalex.isNotNull()
    return F.when(~status.isin("verified", "dup"), "—").when(either, cited_by_text(crossref, openalex)).otherwise(F.coalesce(F.format_number(merged, 0), F.lit("—")))


def sub_line(name, count):
    """A document's name and how many references it has."""
    return F.concat(name, F.lit(" · "), count.cast("string"), F.when(count == 1, " reference").otherwise(" references"))


def recall_precision(extracted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per document, over distinct DOIs: hits, recall, precision and F1 (NaN where undefined)."""
    e, g = extracted.select("doc_id", "doi").where("doi is not null").distinct(), gold.select("doc_id", "doi").where("doi is not null").distinct()
    counts = e.groupBy("doc_id").agg(F.count("*").alias("found")).join(g.groupBy("doc_id").agg(F.count("*").alias("gold")), "doc_id", "full_outer")
    hits = e.join(g, ["doc_id", "doi"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = counts.join(hits, "doc_id", "left").select("doc_id", zero("found").alias("found"), zero("gold").alias("gold"), zero("hits").alias("hits"))
    nan = F.lit(float("nan"))
    rows = rows.withColumn("recall", F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(nan)).withColumn("precision", F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(nan))
    fine = ~F.isnan("recall") & ~F.isnan("precision") & (F.col("recall") > 0) & (F.col("precision") > 0)
    return rows.withColumn("f1", F.when(fine, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(nan))


def mean_of_numbers(rows: DataFrame, column: str) -> DataFrame:
    """Mean of what isn't NaN, and how many were left out."""
    c = F.col(column)
    return rows.agg(F.avg(F.when(~F.isnan(c), c)).alias("mean"), F.count_if(F.isnan(c)).alias("excluded"))


def list_note(numbers, most: int = 6):
    """Up to ``most`` numbers, then how many more."""
    shown = F.array_join(F.transform(F.slice(numbers, 1, most), lambda x: x.cast("string")), ", ")
    rest = F.size(numbers) - most
    return F.when(rest > 0, F.concat(shown, F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(shown)
