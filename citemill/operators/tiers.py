"""Arbitration between a structured parser's reading (tier 1) and the text's own (tier 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from citemill.operators.matching import AMBIGUOUS, RESOLVED, UNRESOLVED


def preferred_entries(tier1: DataFrame, tier0: DataFrame) -> DataFrame:
    """Tier-1 entries of documents that have any, tier-0 entries of the others, with ``tier``."""
    own = tier0.join(tier1.select("doc_id").distinct(), "doc_id", "left_anti")
    return tier1.withColumn("tier", F.lit(1)).unionByName(own.withColumn("tier", F.lit(0)))


def contexts_in_use(contexts: DataFrame, tier1: DataFrame) -> DataFrame:
    """A parse without references gives no citations either."""
    return contexts.join(tier1.select("doc_id").distinct(), "doc_id", "left_semi")


def extraction_status(documents: DataFrame, tier1: DataFrame, tier0: DataFrame) -> DataFrame:
    """A missing bibliography is fatal only where tier 1 found nothing either."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = documents.select("doc_id").join(n(tier1, "a"), "doc_id", "left").join(n(tier0, "b"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("a") > 0, "tier1").when(F.col("b") > 0, "tier0").otherwise("no_bibliography").alias("status"), F.coalesce("a", "b", F.lit(0)).alias("entries"))


def display_entry(source_text, raw_text):
    """The printed text if there is one, else what was rebuilt."""
    return F.coalesce(F.nullif(source_text, F.lit("")), raw_text)


def widest_entry(source_text, raw_text):
    """Both readings of an entry, for what must only be found in it."""
    return F.concat_ws(" ", F.nullif(source_text, F.lit("")), raw_text)


def first_source(asked: DataFrame, sources: dict[str, DataFrame], closed=frozenset()) -> DataFrame:
    """Point look-ups (doc_id, n, asked: a DOI) in catalogues (doi, ...) in order: the first that knows it answers.  A catalogue
    whose door is closed isn't asked."""
    out, found, source = asked.withColumn("__k", F.lower("asked")), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, works) in enumerate(sources.items()):
        if name not in closed:
            out = out.join(works.select(F.lower("doi").alias("__k"), F.col("doi").alias(f"__{i}")).dropDuplicates(["__k"]), "__k", "left")
            source = F.coalesce(source, F.when(F.col(f"__{i}").isNotNull(), name))
            found = F.coalesce(found, F.col(f"__{i}"))
    return out.select("doc_id", "n", "asked", source.alias("source"), found.alias("found"))


def engine_of(preference, reachable):
    """``engine`` as an expression."""
    return F.when((preference == "text") | ~reachable, "tier0").otherwise("tier1")


def combined_matches(contexts: DataFrame, own: DataFrame) -> DataFrame:
    """Matches of tier-1 contexts, supplemented by the text's own.

    contexts (doc_id, seq, start, stop, status, reference_n), start null where the marker wasn't
    located; own (doc_id, seq, start, stop, status, reference_n).  Own matches supplement a document
    only if each of its contexts is located, and one that overlaps a context is dropped unless it
    resolves to a reference that no overlapping context claims.  An unresolved context that a kept own match covers is dropped.
    """
    located = contexts.groupBy("doc_id").agg(F.bool_and(F.col("start").isNotNull()).alias("all_located"))
    may = own.join(located, "doc_id", "left").where(F.coalesce("all_located", F.lit(True))).drop("all_located")
    claim = contexts.where("start is not null").select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("stop").alias("b"), F.col("reference_n").alias("claimed"))
    over = (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("b")) & (F.col("a") < F.col("stop"))
    answered = over & ((F.col("status") != RESOLVED) | (F.col("claimed") == F.col("reference_n")))
    kept = may.join(claim, answered, "left_anti")
    spans = kept.select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("stop").alias("b"))
    unread = contexts.where((F.col("status") == UNRESOLVED) & F.col("start").isNotNull()).join(spans, over, "left_semi").select("doc_id", "seq")
    first = contexts.join(unread, ["doc_id", "seq"], "left_anti").withColumn("tier", F.lit(1))
    both = first.unionByName(kept.withColumn("tier", F.lit(0)))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("start").asc_nulls_last(), "stop", F.desc("tier"), "seq"))
    return both.withColumn("pos", pos.cast("bigint"))


def citation_places(matches: DataFrame) -> DataFrame:
    """Anchored places of each reference: resolved ones are certain, candidates aren't; certain ones first."""
    certain = F.col("status") == RESOLVED
    named = F.when(certain, F.array("reference_n")).when(F.col("status") == AMBIGUOUS, F.col("candidates"))
    both = matches.where("start is not null").select("doc_id", F.explode(named).alias("n"), "start", certain.alias("certain"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "n").orderBy(F.desc("certain"), "start"))
    return both.withColumn("rank", rank.cast("bigint"))


def passage_html(text, start, stop, lo, hi):
    """Before, marked span and after, escaped; an ellipsis only where the passage was cut."""

    def esc(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    part = lambda a, b: esc(F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.concat(F.when(lo > 0, "…").otherwise(""), part(lo, start), F.lit("<mark>"), part(start, stop), F.lit("</mark>"), part(stop, hi), F.when(hi < F.length(text), "…").otherwise(""))


# -- catalogue records -------------------------------------------------------------------
def record_year(print_year, online_year, issued_year):
    return F.coalesce(print_year, online_year, issued_year)


def record_retraction(updates):
    """DOI of the first update typed retraction; a correction isn't one."""
    return F.get(F.transform(F.filter(updates, lambda u: F.lower(u.type) == "retraction"), lambda u: u.doi), F.lit(0))


def record_outlet(kind, institution, container, publisher):
    given = lambda c: F.nullif(c, F.lit(""))
    return F.when(kind == "preprint", given(institution)).otherwise(F.coalesce(given(container), given(publisher)))


def gold_entries(items: DataFrame) -> DataFrame:
    """Titles of a gold list: the article's, else the unstructured string; DOI normalized."""
    from citemill.functions.text import normal_doi

    return items.select("doc_id", "pos", F.coalesce(F.nullif("article_title", F.lit("")), F.nullif("unstructured", F.lit(""))).alias("title"), F.when(F.col("doi").isNotNull(), normal_doi(F.col("doi"))).alias("doi"))


def doi_link(doi):
    return F.when(doi.startswith("10."), F.concat(F.lit("https://doi.org/"), doi))


def lookup_note(source, queried):
    return F.concat_ws(" · ", F.nullif(source, F.lit("")), F.nullif(queried, F.lit("")))


def report_path_error(path: str) -> str | None:
    """Why a path can't take a report, or None: absolute, .html or .htm, its folder there."""
    import os

    if not os.path.isabs(path):
        return "not absolute"
    if not path.lower().endswith((".html", ".htm")):
        return "not an HTML file"
    if not os.path.isdir(os.path.dirname(path)):
        return "no such folder"
    return None


def engine(preference: str, reachable: bool) -> str:
    """The tier that a run uses: what is preferred, tier 0 where tier 1 can't be reached."""
    return "tier0" if preference == "text" or not reachable else "tier1"
