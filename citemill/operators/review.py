"""Manual review as an event log folded to the latest decision of each reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ACTIONS = ("confirm", "correct", "reject", "reopen")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each (doc_id, n); events have a total order in ``at``."""
    fields = [c for c in events.columns if c not in ("doc_id", "n")]
    newest = F.max_by(F.struct(*fields), F.struct("at", "action"))
    return events.groupBy("doc_id", "n").agg(newest.alias("e")).select("doc_id", "n", *[F.col(f"e.{c}").alias(c) for c in fields])


def apply_decisions(results: DataFrame, events: DataFrame) -> DataFrame:
    """Results with decisions applied: a confirmed candidate or a correction makes a row
    verified (only fields given override), a rejected one is not findable and loses its
    match, a reopened one is as it was."""
    e = latest(events).select("doc_id", "n", "action", F.col("title").alias("new_title"), F.col("doi").alias("new_doi"), F.col("year").alias("new_year"), F.col("at").cast("bigint").alias("decided_at"))
    rows = results.join(e, ["doc_id", "n"], "left")
    act = F.col("action")
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    rejected, kept = act == "reject", act.isin("confirm", "correct")
    year = F.when(F.col("new_year").rlike(r"^[0-9]+\z"), F.col("new_year").try_cast("bigint"))
    return rows.select(
        "doc_id",
        "n",
        F.when(rejected, "—").when(kept, F.coalesce(given(F.col("new_title")), "raw")).otherwise(F.col("raw")).alias("title"),
        F.when(rejected, "no match").when(kept, F.coalesce(given(F.col("new_doi")), "doi")).otherwise(F.col("doi")).alias("doi"),
        F.when(kept, F.coalesce(year, "year")).otherwise(F.col("year")).alias("year"),
        F.when(rejected, F.lit(None)).otherwise(F.col("citations")).alias("citations"),
        F.when(rejected, F.lit(None)).otherwise(F.col("retracted")).alias("retracted"),
        F.when(rejected, "halluc").when(kept, "verified").otherwise(F.col("status")).alias("status"),
        F.when(rejected | kept, F.col("decided_at")).alias("decided_at"),
    )


def open_queue(results: DataFrame, events: DataFrame) -> DataFrame:
    """Review and unchecked rows without a decision that stands."""
    decided = latest(events).where(F.col("action") != "reopen").select("doc_id", "n")
    return results.where(F.col("status").isin("review", "unchecked")).select("doc_id", "n", "status").join(decided, ["doc_id", "n"], "left_anti")


def recategorize(status, to, dup_of):
    """dup_of is kept only when the new status is ``dup``."""
    return F.when(to == "dup", dup_of), F.when((status.isin("verified", "dup")) & (to != "verified"), F.lit(True)).otherwise(F.lit(False))


def stamp(at):
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def next_open(decided: DataFrame, queue: DataFrame) -> DataFrame:
    """After each decided (doc_id, n) the open item that comes next: the first later one, else the first left."""
    left = queue.groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("open"))
    rows = decided.join(left, "doc_id", "left")
    later, others = F.filter("open", lambda x: x > F.col("n")), F.filter("open", lambda x: x != F.col("n"))
    return rows.select("doc_id", "n", F.coalesce(F.get(later, F.lit(0)), F.get(others, F.lit(0))).alias("next_n"))


def confirm(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Results verified by a chosen candidate (doc_id, n, title, doi, score, source, outlet, year, retracted).  Its
    retraction isn't taken over, but told."""
    c = candidates.select("doc_id", "n", *[F.col(x).alias(f"c_{x}") for x in ("title", "doi", "score", "source", "outlet", "year", "retracted")])
    given = lambda x: F.nullif(F.col(x), F.lit(""))
    return results.join(c, ["doc_id", "n"]).select("doc_id", "n", F.lit("verified").alias("status"), F.col("c_title").alias("title"), F.col("c_doi").alias("doi"), F.col("c_score").alias("confidence"), F.coalesce(given("c_source"), F.lit("Manual review")).alias("source"), F.coalesce(given("c_outlet"), F.col("outlet")).alias("outlet"), F.col("c_year").alias("year"), F.col("c_retracted").alias("candidate_retracted"))


def not_findable(results: DataFrame) -> DataFrame:
    """Results marked as found nowhere, without what a match had given."""
    kind = lambda c: results.schema[c].dataType
    lost = {c: F.lit(None).cast(kind(c)) for c in ("citations", "retracted", "dup_of")}
    return results.select("doc_id", "n", F.lit("halluc").alias("status"), F.lit("—").alias("title"), F.lit("no match").alias("doi"), lost["citations"].alias("citations"), lost["retracted"].alias("retracted"), F.lit("").alias("retraction_doi"), lost["dup_of"].alias("dup_of"))


def watermark(mode, bundled):
    """Whether a page says that it shows a demonstration: in demo mode, of the document that comes with it."""
    return (mode == "demo") & bundled
