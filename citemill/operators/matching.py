"""Resolution of in-text markers to references, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RESOLVED, AMBIGUOUS, ORPHANED, UNRESOLVED = "resolved", "ambiguous", "orphaned", "unresolved"


def printed_number(raw):
    """Leading ``[n]``, ``n.`` or ``n)`` of up to three digits."""
    return F.coalesce(F.regexp_extract(raw, r"^\s*\[(\d{1,3})\](?:\s|\z)", 1).try_cast("bigint"), F.regexp_extract(raw, r"^\s*(\d{1,3})[.)](?:\s|\z)", 1).try_cast("bigint"))


def number_index(entries: DataFrame) -> DataFrame:
    """(doc_id, n, number, numbered, exhaustive): printed numbers if every entry has one and
    none twice, else positions; exhaustive if they are exactly 1..count."""
    with_number = entries.withColumn("p", printed_number(F.col("raw_text")))
    flags = with_number.groupBy("doc_id").agg(F.count("*").alias("n_entries"), F.count("p").alias("k"), F.countDistinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    numbered = (F.col("k") == F.col("n_entries")) & (F.col("d") == F.col("n_entries"))
    flags = flags.select("doc_id", "n_entries", numbered.alias("numbered"), (numbered & (F.col("lo") == 1) & (F.col("hi") == F.col("n_entries"))).alias("exhaustive"))
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).cast("bigint")
    return with_number.join(flags, "doc_id").select("doc_id", "n", F.when(F.col("numbered"), F.col("p")).otherwise(position).alias("number"), "numbered", "exhaustive")


def citation_rows(entries: DataFrame, markers: DataFrame) -> DataFrame:
    """Entries (doc_id, n, raw_text) and markers (doc_id, seq, number) of each document side by side, in one
    shuffle by document: every later step is a window or an aggregate within it.

    Rows have ``entry`` (else a marker), n, seq, number; a marker its status, reference_n and
    confidence; an entry how often it is cited (``times``).
    """
    listed = entries.select("doc_id", F.lit(True).alias("entry"), "n", F.lit(None).cast("bigint").alias("seq"), printed_number(F.col("raw_text")).alias("p"))
    cited = markers.select("doc_id", F.lit(False).alias("entry"), F.lit(None).cast("bigint").alias("n"), "seq", F.col("number").cast("bigint").alias("p"))
    doc, is_entry = Window.partitionBy("doc_id"), F.col("entry")
    printed = Window.partitionBy("doc_id", "entry", "p")
    rows = listed.unionByName(cited).repartition("doc_id")
    rows = rows.withColumn("again", is_entry & F.col("p").isNotNull() & (F.row_number().over(printed.orderBy("n", "seq")) > 1))
    of_entries = lambda c: F.when(is_entry, c)
    whole = (F.count(of_entries(F.lit(1))).over(doc), F.count(of_entries(F.col("p"))).over(doc), F.coalesce(F.max(F.col("again")).over(doc), F.lit(False)))
    rows = rows.withColumns({"n_entries": whole[0], "numbered": (whole[0] == whole[1]) & ~whole[2], "lo": F.min(of_entries(F.col("p"))).over(doc), "hi": F.max(of_entries(F.col("p"))).over(doc), "place": F.row_number().over(doc.orderBy(F.desc("entry"), "n", "seq")).cast("bigint")})
    rows = rows.withColumn("exhaustive", F.col("numbered") & (F.col("lo") == 1) & (F.col("hi") == F.col("n_entries")))
    rows = rows.withColumn("number", F.when(is_entry & ~F.col("numbered"), F.col("place")).otherwise(F.col("p")))
    same = Window.partitionBy("doc_id", "number")
    rows = rows.withColumns({"reference_n": F.max(of_entries(F.col("n"))).over(same), "times": F.count(F.when(~is_entry, F.lit(1))).over(same)})
    found, listed_here = F.col("reference_n").isNotNull(), F.col("n_entries") > 0
    status = F.when(found, RESOLVED).when(listed_here & F.col("exhaustive"), ORPHANED).otherwise(UNRESOLVED)
    confidence = F.when(found & F.col("numbered"), 1.0).when(found, 0.5).otherwise(0.0)
    return rows.select("doc_id", "entry", "n", "seq", "number", "numbered", "exhaustive", F.when(~is_entry, status).alias("status"), "reference_n", confidence.alias("confidence"), "times")


def resolve_numbered(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """Markers with the entry of their number.  A miss is orphaned only where the
    list is numbered and whole; else, or without a list, unresolved."""
    return citation_rows(entries, markers).where(~F.col("entry")).select("doc_id", "seq", "number", "status", "reference_n", "confidence")


def resolve_author_date(markers: DataFrame, keys: DataFrame, similarity, least: float = 0.90, corroborating=None) -> DataFrame:
    """Best entry by name similarity times year agreement, ties ambiguous.

    markers (doc_id, seq, surname, year); keys (doc_id, n, surname, years, dated).  Years
    veto first, equal names need no similarity call and those with too few common letters can't
    reach the threshold, so ``similarity`` (a column function on two names; null where it isn't
    needed) works on the pairs that are left.  ``corroborating`` (a column
    function on the marker's ``others`` and the entry's ``surnames``) breaks ties.
    """
    from citemill.functions.text import year_agreement

    pairs = markers.join(keys.withColumnRenamed("surname", "entry_surname"), "doc_id", "left")
    pairs = pairs.withColumn("agree", F.when(F.col("n").isNotNull(), year_agreement(F.col("year"), F.col("years"), F.col("dated"))))
    a, b = F.lower("surname"), F.lower("entry_surname")
    # names of plain letters share no more than those that both have: too few for the threshold need no call
    plain = F.col("surname").rlike("^[A-Za-z]+$") & F.col("entry_surname").rlike("^[A-Za-z]+$")
    left_over = lambda x, y: F.length(F.call_function("translate", x, y, F.lit("")))
    most = 2 * F.least(F.length(a) - left_over(a, b), F.length(b) - left_over(b, a)) / (F.length(a) + F.length(b))
    hopeless = plain & (most * F.col("agree") < least)
    called = F.col("agree").isNotNull() & (a != b) & ~F.coalesce(hopeless, F.lit(False))
    # a Python function is called for every row whatever a CASE says, so others get null
    near = similarity(F.when(called, F.col("surname")), F.when(called, F.col("entry_surname")))
    pairs = pairs.withColumn("score", F.round(F.when(F.col("agree").isNull(), 0.0).when(a == b, F.col("agree")).when(called, near * F.col("agree")).otherwise(0.0), 6))
    w = Window.partitionBy("doc_id", "seq")
    best = pairs.withColumn("best", F.max("score").over(w)).withColumn("at_best", F.coalesce((F.col("score") == F.col("best")) & (F.col("best") >= least), F.lit(False)))
    if corroborating is not None:
        # among equal scores the entry that more of the marker's other names are found in wins
        tied = F.sum(F.col("at_best").cast("int")).over(w) > 1
        best = best.withColumn("more", F.when(F.col("at_best") & tied & (F.size("others") > 0), corroborating(F.col("others"), F.col("surnames"))).otherwise(0))
        best = best.withColumn("at_best", F.col("at_best") & (F.col("more") == F.max(F.when(F.col("at_best"), F.col("more"))).over(w)))
    got = best.groupBy("doc_id", "seq").agg(
        F.first("surname").alias("surname"),
        F.max("best").alias("best"),
        F.count("n").alias("n_entries"),
        F.array_sort(F.collect_list(F.when(F.col("at_best"), F.col("n")))).alias("top"),
    )
    size = F.size("top")
    return got.select(
        "doc_id",
        "seq",
        F.when((F.col("n_entries") == 0) | F.col("surname").isNull(), UNRESOLVED).when(size == 0, ORPHANED).when(size == 1, RESOLVED).otherwise(AMBIGUOUS).alias("status"),
        F.when(size == 1, F.get("top", F.lit(0))).alias("reference_n"),
        F.when(size >= 1, F.col("best")).otherwise(0.0).alias("confidence"),
        F.when(size > 1, F.col("top")).otherwise(F.array().cast("array<bigint>")).alias("candidates"),
    )


def citation_counts(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("status") == RESOLVED).groupBy("doc_id", "reference_n").agg(F.count("*").alias("times_cited"))


def unused_references(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Entries that no marker resolves to or lists among its candidates."""
    used = matches.where(F.col("status") == RESOLVED).select("doc_id", F.col("reference_n").alias("n"))
    if "candidates" in matches.columns:
        used = used.union(matches.select("doc_id", F.explode("candidates").alias("n")))
    return entries.select("doc_id", "n").join(used, ["doc_id", "n"], "left_anti")


def run_status(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """not_run without a body, none_detected without markers, none_matched if all are
    unresolved, else ok."""
    seen = matches.groupBy("doc_id").agg(F.count("*").alias("markers"), F.bool_and(F.col("status") == UNRESOLVED).alias("none"))
    status = F.when(~F.col("has_body"), "not_run").when(F.col("markers").isNull(), "none_detected").when(F.col("none"), "none_matched").otherwise("ok")
    return documents.join(seen, "doc_id", "left").select("doc_id", status.alias("run_status"))


def per_reference(entries: DataFrame, matches: DataFrame, status: DataFrame) -> DataFrame:
    """A row for every entry; claims only where the run is ok."""
    counts = citation_counts(matches).withColumnRenamed("reference_n", "n")
    maybe = (matches.select("doc_id", F.explode("candidates").alias("n")) if "candidates" in matches.columns else matches.select("doc_id", F.lit(None).cast("bigint").alias("n")).where("n is not null")).groupBy("doc_id", "n").agg(F.count("*").alias("possible"))
    rows = entries.select("doc_id", "n").join(status, "doc_id", "left").join(counts, ["doc_id", "n"], "left").join(maybe, ["doc_id", "n"], "left")
    return labelled(rows)


def labelled(rows: DataFrame) -> DataFrame:
    """Claims, labels and figures of rows (doc_id, n, run_status, times_cited, possible)."""
    ok = F.col("run_status") == "ok"
    times, may = F.coalesce("times_cited", F.lit(0)), F.coalesce("possible", F.lit(0))
    label = (
        F.when(F.col("run_status") == "none_detected", "No in-text citations were found")
        .when(F.col("run_status") == "none_matched", "No in-text citation could be matched")
        .when(F.col("run_status") == "failed", "The in-text citation search failed")
        .when(~ok | ok.isNull(), "The in-text citation search did not run")
        .when(times == 1, "Cited once in this manuscript")
        .when(times > 1, F.concat(F.lit("Cited "), times.cast("string"), F.lit(" times in this manuscript")))
        .when(may > 0, "Possibly cited in this manuscript")
        .otherwise("No citation found in this manuscript")
    )
    figure = F.when(~ok | ok.isNull(), "—").when((may > 0) & (times == 0), F.concat(F.lit("0 (+"), may.cast("string"), F.lit(" ambiguous)"))).otherwise(times.cast("string"))
    return rows.select("doc_id", "n", F.when(ok, times).otherwise(0).alias("times_cited"), F.when(ok, may).otherwise(0).alias("possible"), (ok & (times == 0) & (may == 0)).alias("uncited"), label.alias("label"), figure.alias("figure"))


def document_summary(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts by status, uncited entries and a headline that states findings first, of documents (doc_id, has_body)
    and rows (doc_id, entry, n, status, candidates where there are any, times, possible where there is one).
    One aggregate by document."""
    is_entry = F.col("entry")
    may = F.coalesce(F.col("possible"), F.lit(0)) if "possible" in rows.columns else F.lit(0)
    bare = F.when(is_entry & (F.col("times") == 0) & (may == 0), F.col("n"))
    by = rows.groupBy("doc_id").agg(
        *[F.count_if(~is_entry & (F.col("status") == s)).alias(s) for s in (RESOLVED, AMBIGUOUS, ORPHANED, UNRESOLVED)],
        F.count_if(~is_entry).alias("markers"),
        F.count(bare).alias("k"),
        F.array_join(F.transform(F.array_sort(F.collect_list(bare)), lambda x: x.cast("string")), ",").alias("uncited_references"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    run = F.when(~F.col("has_body"), "not_run").when(zero("markers") == 0, "none_detected").when(F.col(UNRESOLVED) == F.col("markers"), "none_matched").otherwise("ok")
    out = documents.select("doc_id", "has_body").join(by, "doc_id", "left").withColumn("run_status", run)
    many = lambda c, one, more: F.when(zero(c) == 1, one).when(zero(c) > 1, F.concat(F.col(c).cast("string"), F.lit(more)))
    read = F.concat(zero("markers").cast("string"), F.when(zero("markers") == 1, " in-text citation read").otherwise(" in-text citations read"))
    orphan = many(ORPHANED, "1 naming a reference this list does not carry", " naming a reference this list does not carry")
    unused = many("k", "1 reference with no citation found", " references with no citation found")
    found, ok = F.concat_ws(", ", orphan, unused), F.col("run_status") == "ok"
    return out.select("doc_id", "run_status", *[F.when(ok, zero(s)).otherwise(0).alias(s) for s in (RESOLVED, AMBIGUOUS, ORPHANED, UNRESOLVED)], F.when(ok, F.coalesce("uncited_references", F.lit(""))).otherwise("").alias("uncited_references"), F.when(~ok, "no finding").when(found == "", read).otherwise(F.concat_ws(" — ", read, found)).alias("headline"))


def reference_rows(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``per_reference`` of the same rows: the entries among them with the run's status by a window."""
    doc, is_entry = Window.partitionBy("doc_id"), F.col("entry")
    markers, none = F.count(F.when(~is_entry, F.lit(1))).over(doc), F.count(F.when(~is_entry & (F.col("status") == UNRESOLVED), F.lit(1))).over(doc)
    own = rows.withColumns({"markers": markers, "none": none}).where(is_entry).join(documents.select("doc_id", "has_body"), "doc_id")
    run = F.when(~F.col("has_body"), "not_run").when(F.col("markers") == 0, "none_detected").when(F.col("none") == F.col("markers"), "none_matched").otherwise("ok")
    may = F.col("possible") if "possible" in rows.columns else F.lit(0).cast("bigint")
    return labelled(own.select("doc_id", "n", run.alias("run_status"), F.col("times").alias("times_cited"), may.alias("possible")))


# -- intervals ---------------------------------------------------------------------
def overlap(a_start, a_stop, b_start, b_stop):
    """Half-open spans overlap."""
    return (a_start < b_stop) & (b_start < a_stop)


def covered(spans: DataFrame, by: DataFrame, how: str = "left_semi") -> DataFrame:
    """Spans (doc_id, start, stop) that some span of ``by`` in the same document
    overlaps (``left_semi``) or none does (``left_anti``)."""
    other = by.select(F.col("doc_id").alias("__d"), F.col("start").alias("__a"), F.col("stop").alias("__b"))
    return spans.join(other, (F.col("doc_id") == F.col("__d")) & overlap(F.col("start"), F.col("stop"), F.col("__a"), F.col("__b")), how)


def mark_duplicates(results: DataFrame) -> DataFrame:
    """A verified row whose DOI (in lower case) an earlier verified row of the document
    has becomes ``dup`` of the first of them."""
    key = F.when((F.col("status") == "verified") & (F.coalesce("doi", F.lit("")) != ""), F.lower("doi"))
    first = F.min("n").over(Window.partitionBy("doc_id", "__key"))
    rows = results.withColumn("__key", key).withColumn("__first", F.when(F.col("__key").isNotNull(), first))
    dup = F.col("__first") < F.col("n")
    return rows.withColumn("dup_of", F.when(dup, F.col("__first"))).withColumn("status", F.when(dup, "dup").otherwise(F.col("status"))).drop("__key", "__first")
