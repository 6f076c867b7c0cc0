"""Verification against a catalogue: look-ups, search, merging and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from citemill.functions.text import containment, tokens

# Thresholds.
MATCH, HALLUCINATION, IMPLAUSIBLE, CANDIDATES = 0.85, 0.3, 0.84, 3


def status(error, matched, confidence):
    return F.when(error.isNotNull(), "unchecked").when(matched, "verified").when(confidence < HALLUCINATION, "halluc").otherwise("review")


def doi_label(error, matched, doi):
    return F.when(error.isNotNull(), "not checked (lookup failed)").when(matched, F.coalesce(F.nullif(doi, F.lit("")), F.lit("—"))).otherwise("no match")


def plausible(title, candidate):
    """Anything empty, or a whole token in common."""
    a, b = tokens(F.coalesce(title, F.lit(""))), tokens(F.coalesce(candidate, F.lit("")))
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def search(queries: DataFrame, works: DataFrame, *, k: int = CANDIDATES, most_postings: int = 200) -> DataFrame:
    """The k works that share most title tokens with each query: (doc_id, n, rank, doi, score).

    An inverted index joins query tokens to works; ties go to the smaller DOI, score is the
    token containment.  ``most_postings`` parts rare tokens from common ones and has no
    bearing on the result.  Works that share a rare token are joined to the query by it.
    The others share common tokens alone, so works of equal common tokens rank by DOI,
    and the first k of each such class stand for it (see ``best_of_classes``).
    """
    w = works.select("doi", tokens(F.col("title")).alias("wt")).distinct()
    # equal titles are searched once
    q = queries.select("title").where("title is not null").distinct().withColumn("qt", tokens(F.col("title")))
    held, asked = w.withColumn("t", F.explode("wt")), q.withColumn("t", F.explode("qt"))
    common = held.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") > most_postings).select("t")
    by_rare = asked.join(held.join(common, "t", "left_anti"), "t").select("title", "qt", "doi", "wt")
    class_of = lambda d, *keys: d.join(common, "t").groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("c"))
    qc = class_of(asked, "title", "qt")
    by_common = qc.join(best_of_classes(qc.select("c").distinct(), class_of(held, "doi", "wt"), k), "c").select("title", "qt", "doi", "wt")
    pairs = by_rare.unionByName(by_common).distinct().withColumn("shared", F.size(F.array_intersect("qt", "wt")))
    found = first_k(pairs, "title", k).select("title", F.col("rank").cast("bigint").alias("rank"), "doi", containment(F.col("qt"), F.col("wt")).alias("score"))
    return queries.select("doc_id", "n", "title").join(found, "title").select("doc_id", "n", "rank", "doi", "score")


def first_k(pairs: DataFrame, key: str, k: int) -> DataFrame:
    """Of each key the k rows with most ``shared``, then the smallest DOI."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("shared"), "doi", "wt"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def best_of_classes(asked: DataFrame, works: DataFrame, k: int) -> DataFrame:
    """The k works (doi, wt) that share most of each token set c in ``asked``: (c, doi, wt, shared, rank).

    Works (doi, wt, c) of equal c share alike, so k of them stand for all.  The tokens
    of a set are read from the rarest on: the first gives a k-th shared count s, and
    a work that shares s tokens or more has one of the first ``size(c) - s + 1``,
    so no more are read.
    """
    rank = F.row_number().over(Window.partitionBy("c").orderBy("doi", "wt"))
    held = works.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("c").agg(F.collect_list(F.struct("doi", "wt")).alias("reps"))
    held = held.select(F.col("c").alias("h"), "reps", F.explode("c").alias("t"))
    read = asked.select("c", F.explode("c").alias("t")).join(held.groupBy("t").agg(F.count("*").alias("df")), "t")
    # tokens by rising number of classes, then the place of each
    read = read.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x.t).alias("o"))
    places = read.select("c", "o", F.posexplode("o").alias("place", "t"))

    def met(tokens_read: DataFrame) -> DataFrame:
        # a pair is met at the first token it shares
        both = F.array_intersect("o", "h")
        met_at = tokens_read.join(held, "t").withColumn("both", both).where(F.get("both", F.lit(0)) == F.col("t"))
        return met_at.select("c", F.size("both").alias("shared"), F.explode("reps").alias("r")).select("c", "shared", "r.doi", "r.wt")

    first = first_k(met(places.where("place = 0")), "c", k)
    least = first.groupBy("c").agg(F.when(F.count("*") == k, F.min("shared")).otherwise(1).alias("s"))
    rest = places.where("place > 0").join(least, "c").where(F.col("place") <= F.size("c") - F.col("s")).select("c", "o", "t")
    return first_k(first.select("c", "shared", "doi", "wt").unionByName(met(rest)), "c", k)


def merge_by_doi(candidates: DataFrame) -> DataFrame:
    """Candidates of one DOI (in lower case) become the best with its blanks filled from
    the others in order; retracted is true if any says so, null if none says anything;
    citations the most any knows.  Candidates without a DOI stay.

    Input: doc_id, n, pos (order: score, then source, then place), doi, title, year,
    outlet, citations, retracted, score.
    """
    key = F.coalesce(F.lower(F.nullif("doi", F.lit(""))), F.concat(F.lit("#"), F.col("pos").cast("string")))
    safe = lambda c: F.get(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v"))))), lambda x: x.v), F.lit(0))
    return candidates.groupBy("doc_id", "n", key.alias("key")).agg(
        F.min("pos").alias("pos"), *[safe(c).alias(c) for c in ("doi", "title", "year", "outlet", "score")], F.max("citations").alias("citations"), F.bool_or("retracted").alias("retracted")
    )


def verify(entries: DataFrame, works: DataFrame, *, searched: DataFrame | None = None, failed=None) -> DataFrame:
    """Entries (doc_id, n, title, doi) against works: by DOI first, and only the rest by title.

    A known DOI with a plausible title is verified at 1.0, with an implausible one left at
    0.84; a title match of 0.85 or more is verified at its score; without a candidate the
    score is 0.  ``failed`` marks entries whose look-up didn't answer.
    """
    e, w = entries.withColumn("__doi", F.lower("doi")), catalogued(works)
    direct = e.join(w, "__doi", "left")
    rest = direct.where("found_doi is null").select("doc_id", "n", "title")
    hits = searched if searched is not None else search(rest, works)
    return classified(by_doi(direct.where("found_doi is not null")).unionByName(by_title(rest, hits, w)), failed)


FOUND = ("found_doi", "found_title", "found_year", "outlet", "citations", "retracted")


def catalogued(works: DataFrame) -> DataFrame:
    """Works by their DOI in lower case."""
    return works.select(F.lower("doi").alias("__doi"), F.col("doi").alias("found_doi"), F.col("title").alias("found_title"), "outlet", "citations", "retracted", F.col("year").alias("found_year"))


def by_doi(known: DataFrame, *more: str) -> DataFrame:
    """Entries beside the work of their DOI: whether its title is plausible; ``more`` columns of theirs stay."""
    same = F.coalesce(F.col("title") == F.col("found_title"), F.lit(False))
    ok = known.withColumn("ok", same | plausible(F.col("title"), F.col("found_title")))
    return ok.select("doc_id", "n", *more, F.col("ok").alias("matched"), F.when(F.col("ok"), 1.0).otherwise(IMPLAUSIBLE).alias("confidence"), *FOUND)


def by_title(rest: DataFrame, hits: DataFrame, catalogue: DataFrame, *more: str) -> DataFrame:
    """Entries with the first hit of their title search; ``more`` columns of theirs stay."""
    top = hits.where("rank = 1").select("doc_id", "n", F.lower("doi").alias("__doi"), "score")
    found = rest.select("doc_id", "n", *more).join(top, ["doc_id", "n"], "left").join(catalogue, "__doi", "left")
    return found.select("doc_id", "n", *more, F.coalesce(F.col("score") >= MATCH, F.lit(False)).alias("matched"), F.coalesce("score", F.lit(0.0)).alias("confidence"), *FOUND)


def classified(found: DataFrame, failed=None) -> DataFrame:
    error = F.when(failed, "lookup failed") if failed is not None else F.lit(None).cast("string")
    return found.withColumn("error", error).withColumn("status", status(F.col("error"), F.col("matched"), F.col("confidence"))).withColumn("doi_label", doi_label(F.col("error"), F.col("matched"), F.col("found_doi")))


def abstract_of(index):
    """Text of an inverted index (map from word to positions); null if empty."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x.w), " "), F.lit(""))


def names_of(entries, k: int):
    """The first k names, then without blanks."""
    return F.filter(F.transform(F.slice(entries, 1, k), lambda x: F.trim(x)), lambda x: x != "")


def door_open(closed_until, now):
    """A source's budget door clears itself once the clock passes its expiry."""
    return closed_until.isNull() | (now >= closed_until)


def closes_until(retry_after_seconds, now):
    """Retry-After if usable, else the next UTC midnight."""
    return F.coalesce(now + F.make_interval(secs=retry_after_seconds.try_cast("int")), F.date_trunc("DAY", now) + F.expr("INTERVAL 1 DAY"))


def ensemble(extracted: DataFrame) -> DataFrame:
    """Union of extraction tiers (doc_id, tier, pos, doi, title): per DOI the first row in
    tier order, but one with a title before one without."""
    rows = extracted.where(F.coalesce("doi", F.lit("")) != "")
    rank = F.row_number().over(Window.partitionBy("doc_id", "doi").orderBy(F.coalesce("title", F.lit("")) == "", "tier", "pos"))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def review_reason(status_, first_score, second_score, confidence):
    return (
        F.when(status_ == "unchecked", "The catalogues did not answer; the entry is not checked")
        .when(F.abs(first_score - second_score) <= 0.05, "Two candidates score alike")
        .when(first_score < MATCH, "The best candidate is below the threshold")
        .otherwise(F.concat(F.lit("Confidence "), F.format_string("%.2f", confidence)))
    )
