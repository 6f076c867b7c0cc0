"""Queries of the relational operators: matching, counting, verifying, reviewing."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from citemill.operators import aggregate as agg
from citemill.operators import matching as mt
from citemill.operators import review as rv
from citemill.operators import synth as sy
from citemill.operators import verify as vf
from citemill.plans.registry import query

# -- fragments of SQL that several oracles share --------------------------------------
INDEX = """
 idx AS (SELECT e.doc_id, e.n, CASE WHEN f.k = f.c AND f.d = f.c THEN e.p ELSE row_number() OVER (PARTITION BY e.doc_id ORDER BY e.n) END AS number,
                f.k = f.c AND f.d = f.c AS numbered, f.k = f.c AND f.d = f.c AND f.lo = 1 AND f.hi = f.c AS exhaustive
         FROM (SELECT *, TRY_CAST(nullif(coalesce(nullif(regexp_extract(raw_text, '^\\s*\\[(\\d{1,3})\\]\\s', 1), ''), regexp_extract(raw_text, '^\\s*(\\d{1,3})[.)]\\s', 1)), '') AS BIGINT) AS p FROM entries) e
         JOIN (SELECT doc_id, count(*) AS c, count(p) AS k, count(DISTINCT p) AS d, min(p) AS lo, max(p) AS hi
               FROM (SELECT *, TRY_CAST(nullif(coalesce(nullif(regexp_extract(raw_text, '^\\s*\\[(\\d{1,3})\\]\\s', 1), ''), regexp_extract(raw_text, '^\\s*(\\d{1,3})[.)]\\s', 1)), '') AS BIGINT) AS p FROM entries) x GROUP BY doc_id) f ON e.doc_id = f.doc_id)"""
MATCHES = INDEX + """,
 matches AS (SELECT m.doc_id, m.seq, m.number, CASE WHEN i.n IS NOT NULL THEN 'resolved' WHEN f.numbered AND f.exhaustive THEN 'orphaned' ELSE 'unresolved' END AS status,
                    i.n AS reference_n, CASE WHEN i.n IS NOT NULL AND f.numbered THEN 1.0::DOUBLE WHEN i.n IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence
             FROM markers m LEFT JOIN idx i ON m.doc_id = i.doc_id AND m.number = i.number
             LEFT JOIN (SELECT doc_id, bool_or(numbered) AS numbered, bool_or(exhaustive) AS exhaustive FROM idx GROUP BY doc_id) f ON m.doc_id = f.doc_id)"""
DUPS = """
 dups AS (SELECT doc_id, n, min(n) OVER (PARTITION BY doc_id, lower(doi)) AS first_n FROM checked WHERE status = 'verified' AND coalesce(doi, '') <> ''),
 results AS (SELECT c.* EXCLUDE (status), CASE WHEN d.first_n < c.n THEN 'dup' ELSE c.status END AS status, CASE WHEN d.first_n < c.n THEN d.first_n END AS dup_of
             FROM checked c LEFT JOIN dups d ON c.doc_id = d.doc_id AND c.n = d.n)"""
EVENTS = """
 log AS (SELECT doc_id, n, CAST(seq AS BIGINT) AS "at", CASE seq % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct' WHEN 2 THEN 'reject' ELSE 'reopen' END AS action,
                CASE WHEN seq % 3 = 0 THEN '  ' ELSE 'Title ' || seq END AS title, CASE WHEN seq % 5 = 0 THEN '' ELSE '10.1/' || seq END AS doi, CASE WHEN seq % 2 = 0 THEN '19' || (10 + seq % 90) ELSE 'n.d.' END AS year
         FROM (SELECT m.doc_id, m.number AS n, m.seq FROM markers m) x),
 last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY "at" DESC, action DESC) AS r FROM log) y WHERE r = 1)"""


def matched(t):
    return mt.resolve_numbered(t("markers"), t("entries"))


def result_rows(t):
    return mt.mark_duplicates(t("checked"))


def event_log(t):
    m = t("markers").withColumnRenamed("number", "n")
    s = F.col("seq")
    return m.select(
        "doc_id",
        "n",
        s.alias("at"),
        F.element_at(F.array(*map(F.lit, ("confirm", "correct", "reject", "reopen"))), (s % 4 + 1).cast("int")).alias("action"),
        F.when(s % 3 == 0, "  ").otherwise(F.concat(F.lit("Title "), s.cast("string"))).alias("title"),
        F.when(s % 5 == 0, "").otherwise(F.concat(F.lit("10.1/"), s.cast("string"))).alias("doi"),
        F.when(s % 2 == 0, F.concat(F.lit("19"), (10 + s % 90).cast("string"))).otherwise("n.d.").alias("year"),
    )


# -- index and matching -------------------------------------------------------------
@query("idx_number_index", "entries", sql=f"WITH {INDEX} SELECT * FROM idx")
def _(t):
    return mt.number_index(t("entries"))


@query("joi_resolve_numbered", "markers", "entries", sql=f"WITH {MATCHES} SELECT * FROM matches")
def _(t):
    return matched(t)


@query("agg_citation_counts", "markers", "entries", sql=f"WITH {MATCHES} SELECT doc_id, reference_n, count(*) AS times_cited FROM matches WHERE status = 'resolved' GROUP BY 1, 2")
def _(t):
    return mt.citation_counts(matched(t))


@query("rel_unused_references", "markers", "entries", sql=f"WITH {MATCHES} SELECT doc_id, n FROM entries e WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = e.doc_id AND m.reference_n = e.n AND m.status = 'resolved')")
def _(t):
    return mt.unused_references(t("entries"), matched(t))


STATUS = """
 runs AS (SELECT d.doc_id, CASE WHEN d.doc_id % 23 = 0 THEN 'not_run' WHEN m.c IS NULL THEN 'none_detected' WHEN m.none THEN 'none_matched' ELSE 'ok' END AS run_status
          FROM (SELECT DISTINCT doc_id FROM refs) d LEFT JOIN (SELECT doc_id, count(*) AS c, bool_and(status = 'unresolved') AS none FROM matches GROUP BY doc_id) m ON d.doc_id = m.doc_id)"""


def manuscripts(t):
    return t("refs").select("doc_id").distinct().withColumn("has_body", F.col("doc_id") % 23 != 0)


@query("ver_run_status", "refs", "markers", "entries", sql=f"WITH {MATCHES}, {STATUS} SELECT * FROM runs")
def _(t):
    return mt.run_status(manuscripts(t), matched(t))


PER = """
 per AS (SELECT e.doc_id, e.n, CASE WHEN r.run_status = 'ok' THEN coalesce(c.k, 0) ELSE 0 END AS times_cited, r.run_status = 'ok' AND c.k IS NULL AS uncited,
                CASE WHEN r.run_status = 'none_detected' THEN 'No in-text citations were found' WHEN r.run_status = 'none_matched' THEN 'No in-text citation could be matched'
                     WHEN r.run_status <> 'ok' THEN 'The in-text citation search did not run' WHEN c.k = 1 THEN 'Cited once in this manuscript'
                     WHEN c.k > 1 THEN 'Cited ' || c.k || ' times in this manuscript' ELSE 'No citation found in this manuscript' END AS label,
                CASE WHEN r.run_status <> 'ok' THEN '—' ELSE CAST(coalesce(c.k, 0) AS VARCHAR) END AS figure
         FROM entries e JOIN runs r ON e.doc_id = r.doc_id LEFT JOIN (SELECT doc_id, reference_n, count(*) AS k FROM matches WHERE status = 'resolved' GROUP BY 1, 2) c ON c.doc_id = e.doc_id AND c.reference_n = e.n)"""


def citation_rows(t):
    return mt.citation_rows(t("entries"), t("markers"))


def per_reference(t):
    return mt.reference_rows(manuscripts(t), citation_rows(t))


@query("agg_per_reference", "refs", "markers", "entries", sql=f"WITH {MATCHES}, {STATUS}, {PER} SELECT doc_id, n, times_cited, 0::BIGINT AS possible, uncited, label, figure FROM per")
def _(t):
    return per_reference(t).withColumn("possible", F.col("possible").cast("bigint"))


@query(
    "agg_document_summary",
    "refs",
    "markers",
    "entries",
    sql=f"""WITH {MATCHES}, {STATUS}, {PER},
 by_status AS (SELECT doc_id, count(*) AS c, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'orphaned') AS orphaned, count(*) FILTER (status = 'unresolved') AS unresolved FROM matches GROUP BY doc_id),
 bare AS (SELECT doc_id, count(*) AS k, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS ns FROM per WHERE uncited GROUP BY doc_id)
 SELECT r.doc_id, r.run_status, CASE WHEN run_status = 'ok' THEN coalesce(resolved, 0) ELSE 0 END AS resolved, 0::BIGINT AS ambiguous, CASE WHEN run_status = 'ok' THEN coalesce(orphaned, 0) ELSE 0 END AS orphaned, CASE WHEN run_status = 'ok' THEN coalesce(unresolved, 0) ELSE 0 END AS unresolved,
        CASE WHEN run_status = 'ok' THEN coalesce(ns, '') ELSE '' END AS uncited_references,
        CASE WHEN run_status <> 'ok' THEN 'no finding' ELSE coalesce(c, 0) || CASE WHEN c = 1 THEN ' in-text citation read' ELSE ' in-text citations read' END
             || CASE WHEN coalesce(orphaned, 0) > 0 OR coalesce(k, 0) > 0 THEN ' — ' ELSE '' END
             || concat_ws(', ', CASE WHEN orphaned = 1 THEN '1 naming a reference this list does not carry' WHEN orphaned > 1 THEN orphaned || ' naming a reference this list does not carry' END,
                                CASE WHEN k = 1 THEN '1 reference with no citation found' WHEN k > 1 THEN k || ' references with no citation found' END) END AS headline
 FROM runs r LEFT JOIN by_status s ON r.doc_id = s.doc_id LEFT JOIN bare b ON r.doc_id = b.doc_id""",
)
def document_summary(t):
    out = mt.document_summary(manuscripts(t), citation_rows(t))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("resolved", "ambiguous", "orphaned", "unresolved")})


@query(
    "joi_resolve_author_date_exact",
    "author_markers",
    "entries",
    sql="""WITH pairs AS (SELECT m.doc_id, m.seq, m.surname, e.n, CASE WHEN e.n IS NULL THEN 0 WHEN lower(m.surname) <> lower(e.surname) THEN 0 WHEN m.year IS NULL THEN 0.9 WHEN m.year = CAST(e.year AS VARCHAR) THEN 1.0 ELSE 0 END AS score
              FROM author_markers m LEFT JOIN entries e ON m.doc_id = e.doc_id),
 best AS (SELECT *, max(score) OVER (PARTITION BY doc_id, seq) AS b FROM pairs),
 g AS (SELECT doc_id, seq, max(b) AS b, count(n) AS k, count(*) FILTER (score = b AND b >= 0.9) AS top, min(n) FILTER (score = b AND b >= 0.9) AS first_n, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (score = b AND b >= 0.9) AS ns FROM best GROUP BY 1, 2)
 SELECT doc_id, seq, CASE WHEN k = 0 THEN 'unresolved' WHEN top = 0 THEN 'orphaned' WHEN top = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN top = 1 THEN first_n END AS reference_n,
        CASE WHEN top >= 1 THEN b::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN top > 1 THEN ns ELSE '' END AS candidates FROM g""",
)
def _(t):
    keys = t("entries").select("doc_id", "n", "surname", F.array(F.col("year").cast("string")).alias("years"), F.lit(True).alias("dated"))
    out = mt.resolve_author_date(t("author_markers"), keys, lambda a, b: F.lit(0.0))
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


@query("joi_mark_duplicates", "checked", sql=f"WITH {DUPS} SELECT doc_id, n, doi, status, dup_of FROM results")
def _(t):
    return result_rows(t).select("doc_id", "n", "doi", "status", "dup_of")


SPANS = """
 a AS (SELECT doc_id, seq, seq * 10 + doc_id % 7 AS start, seq * 10 + doc_id % 7 + 6 AS stop FROM markers),
 b AS (SELECT doc_id, n * 13 AS start, n * 13 + 5 AS stop FROM refs)"""


def spans(t):
    m, r = t("markers"), t("refs")
    s = F.col("seq") * 10 + F.col("doc_id") % 7
    return m.select("doc_id", "seq", s.alias("start"), (s + 6).alias("stop")), r.select("doc_id", (F.col("n") * 13).alias("start"), (F.col("n") * 13 + 5).alias("stop"))


@query("joi_interval_semi", "markers", "refs", sql=f"WITH {SPANS} SELECT doc_id, seq FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND a.start < b.stop AND b.start < a.stop)")
def _(t):
    a, b = spans(t)
    return mt.covered(a, b).select("doc_id", "seq")


@query("joi_interval_anti", "markers", "refs", sql=f"WITH {SPANS} SELECT doc_id, seq FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND a.start < b.stop AND b.start < a.stop)")
def _(t):
    a, b = spans(t)
    return mt.covered(a, b, "left_anti").select("doc_id", "seq")


# -- aggregates --------------------------------------------------------------------
@query("agg_metrics", "checked", sql=f"WITH {DUPS} SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status IN ('review', 'unchecked')) AS review, count(*) FILTER (status = 'halluc') AS halluc, count(*) FILTER (status = 'dup') AS dup, count(*) FILTER (status = 'unchecked') AS unchecked, count(*) FILTER (retracted) AS retracted FROM results GROUP BY doc_id")
def _(t):
    return agg.metrics(result_rows(t))


@query("agg_card_text", "checked", sql=f"WITH {DUPS}, m AS (SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'verified') AS v FROM results GROUP BY doc_id) SELECT doc_id, CAST(round_even(100.0 * v / total, 0) AS INTEGER) || '%' AS note FROM m")
def _(t):
    m = agg.metrics(result_rows(t))
    return m.select("doc_id", agg.percent_note(F.col("verified"), F.col("total")).alias("note"))


ONCE = "row_number() OVER (PARTITION BY doc_id, lower(doi) ORDER BY n) = 1 OR doi IS NULL"


@query("agg_outlet_breakdown", "checked", sql=f"WITH {DUPS} SELECT doc_id, outlet, count(*) AS works FROM (SELECT * FROM results WHERE status IN ('verified', 'dup') AND coalesce(outlet, '') <> '' QUALIFY {ONCE}) x GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return agg.outlet_breakdown(result_rows(t))


@query("agg_topic_breakdown", "checked", sql=f"WITH {DUPS}, c AS (SELECT doc_id, topic, count(*) AS works FROM (SELECT doc_id, unnest(string_split(topics, ',')) AS topic FROM (SELECT * FROM results WHERE coalesce(topics, '') <> '' QUALIFY {ONCE}) x) y GROUP BY 1, 2) SELECT doc_id, topic, works, row_number() OVER (PARTITION BY doc_id ORDER BY works DESC, topic DESC) AS rank FROM c QUALIFY rank <= 8")
def _(t):
    return agg.topic_breakdown(result_rows(t))


BIN = lambda c, bins: "CASE " + " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN {k}" for k, (lo, hi, _) in enumerate(bins)) + " END"
FRAME = lambda bins: "(VALUES " + ", ".join(f"({k}, '{label}')" for k, (_, _, label) in enumerate(bins)) + ") f(bin, label)"


@query("agg_age_histogram", "checked", sql=f"WITH c AS (SELECT {BIN('2026 - year', agg.AGE_BINS)} AS bin, count(*) AS k FROM checked WHERE coalesce(year, 0) <> 0 GROUP BY 1) SELECT f.bin, f.label, coalesce(k, 0) AS works FROM {FRAME(agg.AGE_BINS)} LEFT JOIN c ON c.bin = f.bin")
def _(t):
    return agg.age_bins(t("checked"))


UNIQUE = "SELECT * FROM results WHERE status IN ('verified', 'dup') AND citations IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, doi ORDER BY n) = 1 OR doi IS NULL"


@query("agg_unique_citations", "checked", sql=f"WITH {DUPS} SELECT doc_id, n, citations FROM ({UNIQUE}) x")
def _(t):
    return agg.unique_citations(result_rows(t)).select("doc_id", "n", "citations")


@query("agg_citation_histogram", "checked", sql=f"WITH {DUPS}, c AS (SELECT {BIN('citations', agg.CITATION_BINS)} AS bin, count(*) AS k FROM ({UNIQUE}) x GROUP BY 1) SELECT f.bin, f.label, coalesce(k, 0) AS works FROM {FRAME(agg.CITATION_BINS)} LEFT JOIN c ON c.bin = f.bin")
def _(t):
    return agg.citation_bins(result_rows(t))


@query("agg_cited_by_text", "works", sql="SELECT work_id, CASE WHEN citations IS NULL AND work_id % 5 = 0 THEN '—' ELSE concat_ws(' / ', CASE WHEN citations IS NOT NULL THEN format('{:,}', citations) || ' (Crossref)' END, CASE WHEN work_id % 5 <> 0 THEN format('{:,}', work_id * 11) || ' (OpenAlex)' END) END AS cited_by FROM works")
def _(t):
    w = t("works")
    return w.select("work_id", agg.cited_by_text(F.col("citations"), F.when(F.col("work_id") % 5 != 0, F.col("work_id") * 11)).alias("cited_by"))


GOLD = """
 ext AS (SELECT DISTINCT doc_id, lower(doi) AS doi FROM checked WHERE doi IS NOT NULL),
 gold AS (SELECT DISTINCT r.doc_id, CASE WHEN (r.doc_id + r.work_id) % 6 = 0 THEN w.doi || 'x' ELSE w.doi END AS doi FROM refs r JOIN works w ON r.work_id = w.work_id),
 sc AS (SELECT coalesce(e.doc_id, g.doc_id) AS doc_id, coalesce(found, 0) AS found, coalesce(gold, 0) AS gold, coalesce(hits, 0) AS hits
        FROM (SELECT doc_id, count(*) AS found FROM ext GROUP BY 1) e FULL JOIN (SELECT doc_id, count(*) AS gold FROM gold GROUP BY 1) g ON e.doc_id = g.doc_id
        LEFT JOIN (SELECT ext.doc_id, count(*) AS hits FROM ext JOIN gold ON ext.doc_id = gold.doc_id AND ext.doi = gold.doi GROUP BY 1) h ON h.doc_id = coalesce(e.doc_id, g.doc_id)),
 rp AS (SELECT *, CASE WHEN gold > 0 THEN hits / gold ELSE 'NaN'::DOUBLE END AS recall, CASE WHEN found > 0 THEN hits / found ELSE 'NaN'::DOUBLE END AS "precision" FROM sc)"""


def gold_dois(t):
    """What a manuscript's gold list has; every sixth identifier is another than the entry's."""
    other = F.when((F.col("doc_id") + F.col("work_id")) % 6 == 0, F.concat("doi", F.lit("x"))).otherwise(F.col("doi"))
    return t("refs").join(t("works"), "work_id").select("doc_id", other.alias("doi"))


def scored(t):
    ext = t("checked").select("doc_id", F.lower("doi").alias("doi"))
    return agg.recall_precision(ext, gold_dois(t))


@query("agg_doi_scores", "checked", "refs", "works", sql=f"WITH {GOLD} SELECT doc_id, found, gold, hits, round(recall, 6) AS recall, round(\"precision\", 6) AS \"precision\", CASE WHEN isnan(recall) OR isnan(\"precision\") OR recall = 0 OR \"precision\" = 0 THEN 'NaN'::DOUBLE ELSE round(2 * recall * \"precision\" / (recall + \"precision\"), 6) END AS f1 FROM rp")
def _(t):
    return scored(t).withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


@query("agg_mean_without_nan", "checked", "refs", "works", sql=f"WITH {GOLD} SELECT round(avg(recall) FILTER (NOT isnan(recall)), 6) AS mean, count(*) FILTER (isnan(recall)) AS excluded FROM rp")
def _(t):
    return agg.mean_of_numbers(scored(t), "recall").withColumn("mean", F.round("mean", 6))


@query("joi_gold_union", "checked", "refs", "works", sql=f"WITH {GOLD} SELECT coalesce(e.doc_id, g.doc_id) AS doc_id, coalesce(e.doi, g.doi) AS doi, e.doi IS NOT NULL AS in_first, g.doi IS NOT NULL AS in_second FROM ext e FULL JOIN gold g ON e.doc_id = g.doc_id AND e.doi = g.doi")
def _(t):
    e = t("checked").where("doi is not null").select("doc_id", F.lower("doi").alias("doi")).distinct().withColumn("a", F.lit(True))
    g = gold_dois(t).distinct().withColumn("b", F.lit(True))
    return e.join(g, ["doc_id", "doi"], "full_outer").select("doc_id", "doi", F.col("a").isNotNull().alias("in_first"), F.col("b").isNotNull().alias("in_second"))


# -- filters, order, top-k ------------------------------------------------------------
@query("rel_status_tab", "checked", sql=f"WITH {DUPS} SELECT tab, count(*) AS k FROM results, (VALUES ('all'), ('review'), ('retracted'), ('verified'), ('halluc'), ('dup')) v(tab) WHERE CASE tab WHEN 'all' THEN TRUE WHEN 'review' THEN status IN ('review', 'unchecked') WHEN 'retracted' THEN retracted IS TRUE ELSE status = tab END GROUP BY tab")
def _(t):
    s = F.col("status")
    tabs = F.filter(F.array(F.lit("all"), F.when(s.isin("review", "unchecked"), "review"), F.when(F.col("retracted"), "retracted"), F.when(s.isin("verified", "halluc", "dup"), s)), lambda x: x.isNotNull())
    return result_rows(t).select(F.explode(tabs).alias("tab")).groupBy("tab").agg(F.count("*").alias("k"))


@query("rel_sort_and_page", "checked", sql="SELECT doc_id, n, lower(raw) AS raw, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n) AS place, (row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n) - 1) // 5 AS page FROM checked")
def _(t):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "n")).cast("bigint")
    return t("checked").select("doc_id", "n", F.lower("raw").alias("raw"), place.alias("place"), F.floor((place - 1) / 5).alias("page"))


@query("rel_truncate", "refs", sql="SELECT doc_id, n, CASE WHEN c > 4 THEN c END AS truncated_from FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM refs) x WHERE r <= 4")
def _(t):
    w = Window.partitionBy("doc_id")
    r = t("refs").withColumn("c", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("n")))
    return r.where("r <= 4").select("doc_id", "n", F.when(F.col("c") > 4, F.col("c")).alias("truncated_from"))


@query("rel_top_candidates", "checked", sql="SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, n) AS rank FROM checked WHERE coalesce(doi, '') <> '' AND coalesce(raw, '') <> '' QUALIFY rank <= 3")
def _(t):
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "n"))
    rows = t("checked").where((F.coalesce("doi", F.lit("")) != "") & (F.coalesce("raw", F.lit("")) != ""))
    return rows.withColumn("rank", rank).where("rank <= 3").select("doc_id", "n", F.col("rank").cast("bigint").alias("rank"))


@query("rel_best_of", "checked", sql="SELECT doc_id, arg_max(doi, confidence * 100000 - n) AS doi, max(confidence) AS confidence FROM checked WHERE doi IS NOT NULL GROUP BY doc_id")
def _(t):
    return t("checked").where("doi is not null").groupBy("doc_id").agg(F.max_by("doi", F.struct("confidence", -F.col("n"))).alias("doi"), F.max("confidence").alias("confidence"))


@query("rel_doi_sets", "checked", "works", sql="SELECT 'union' AS kind, count(*) AS k FROM (SELECT lower(doi) FROM checked WHERE doi IS NOT NULL UNION SELECT doi FROM works) x UNION ALL SELECT 'overlap', count(*) FROM (SELECT lower(doi) FROM checked WHERE doi IS NOT NULL INTERSECT SELECT doi FROM works) y UNION ALL SELECT 'except', count(*) FROM (SELECT doi FROM works EXCEPT SELECT lower(doi) FROM checked WHERE doi IS NOT NULL) z")
def _(t):
    a, b = t("checked").where("doi is not null").select(F.lower("doi").alias("doi")), t("works").select("doi")
    one = lambda df, k: df.agg(F.count("*").alias("k")).select(F.lit(k).alias("kind"), "k")
    return one(a.union(b).distinct(), "union").union(one(a.intersect(b), "overlap")).union(one(b.subtract(a), "except"))


@query("rel_review_queue", "checked", "markers", sql=f"WITH {EVENTS} SELECT c.doc_id, c.n, c.status FROM checked c WHERE status IN ('review', 'unchecked') AND NOT EXISTS (SELECT 1 FROM last l WHERE l.doc_id = c.doc_id AND l.n = c.n AND l.action <> 'reopen')")
def _(t):
    return rv.open_queue(t("checked"), event_log(t))


# -- verification ---------------------------------------------------------------------
@query("ver_status", "checked", sql="SELECT doc_id, n, CASE WHEN e THEN 'unchecked' WHEN m THEN 'verified' WHEN confidence < 0.3 THEN 'halluc' ELSE 'review' END AS status, CASE WHEN e THEN 'not checked (lookup failed)' WHEN m THEN coalesce(nullif(doi, ''), '—') ELSE 'no match' END AS doi_label FROM (SELECT *, n % 11 = 0 AS e, confidence >= 0.85 AS m FROM checked) x")
def _(t):
    c = t("checked")
    error, matched_ = F.when(F.col("n") % 11 == 0, "lookup failed"), F.col("confidence") >= 0.85
    return c.select("doc_id", "n", vf.status(error, matched_, F.col("confidence")).alias("status"), vf.doi_label(error, matched_, F.col("doi")).alias("doi_label"))


@query(
    "ver_merge_by_doi",
    "checked",
    sql="""WITH c AS (SELECT doc_id, 0::BIGINT AS n, n AS pos, CASE WHEN n % 5 = 0 THEN NULL ELSE doi END AS doi, CASE WHEN n % 3 = 0 THEN NULL ELSE raw END AS title, CASE WHEN n % 2 = 0 THEN NULL ELSE year END AS year, outlet, citations, retracted, confidence AS score FROM checked),
 k AS (SELECT *, coalesce(lower(nullif(doi, '')), '#' || pos) AS key FROM c)
 SELECT doc_id, n, key, min(pos) AS pos, first(doi ORDER BY pos) FILTER (doi IS NOT NULL) AS doi, first(title ORDER BY pos) FILTER (title IS NOT NULL) AS title, first(year ORDER BY pos) FILTER (year IS NOT NULL) AS year, first(outlet ORDER BY pos) FILTER (outlet IS NOT NULL) AS outlet, first(score ORDER BY pos) AS score, max(citations) AS citations, bool_or(retracted) AS retracted FROM k GROUP BY 1, 2, 3""",
)
def _(t):
    c, n = t("checked"), F.col("n")
    rows = c.select("doc_id", F.lit(0).cast("bigint").alias("n"), n.alias("pos"), F.when(n % 5 != 0, F.col("doi")).alias("doi"), F.when(n % 3 != 0, F.col("raw")).alias("title"), F.when(n % 2 != 0, F.col("year")).alias("year"), "outlet", "citations", "retracted", F.col("confidence").alias("score"))
    return vf.merge_by_doi(rows)


TOK = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"
ASKED = "q AS (SELECT r.doc_id, r.n, CASE WHEN r.work_id % 3 = 0 THEN w.title || ' revised' ELSE 'On ' || w.title END AS title, CASE WHEN (r.doc_id + r.n) % 4 = 0 THEN w.doi WHEN (r.doc_id + r.n) % 4 = 1 THEN '10.1/none' END AS doi FROM refs r JOIN works w ON r.work_id = w.work_id)"


def asked(t):
    r = t("refs").join(t("works"), "work_id")
    k = (F.col("doc_id") + F.col("n")) % 4
    title = F.when(F.col("work_id") % 3 == 0, F.concat("title", F.lit(" revised"))).otherwise(F.concat(F.lit("On "), F.col("title")))
    return r.select("doc_id", "n", title.alias("title"), F.when(k == 0, F.col("doi")).when(k == 1, "10.1/none").alias("doi"))


# every work that shares a token, the most shared first
SEARCH = f"""{ASKED}, dt AS (SELECT DISTINCT title, {TOK('title')} AS ts FROM q), wt AS (SELECT doi, {TOK('title')} AS ts FROM works),
 shared AS (SELECT d.title, w.doi, any_value(d.k) AS a, any_value(w.k) AS b, count(*) AS s FROM (SELECT title, len(ts) AS k, unnest(ts) AS t FROM dt) d JOIN (SELECT doi, len(ts) AS k, unnest(ts) AS t FROM wt) w ON d.t = w.t GROUP BY 1, 2),
 best AS (SELECT title, doi, row_number() OVER (PARTITION BY title ORDER BY s DESC, doi) AS rank, s / least(a, b) AS score FROM shared QUALIFY rank <= 3),
 hits AS (SELECT q.doc_id, q.n, b.doi, b.rank, b.score FROM q JOIN best b ON b.title = q.title)"""


@query("src_title_search", "refs", "works", sql=f"WITH {SEARCH} SELECT doc_id, n, rank, doi, round(score, 6) AS score FROM hits")
def _(t):
    return vf.search(asked(t), t("works")).withColumn("score", F.round("score", 6))


@query("src_doi_lookup", "refs", "works", sql=f"WITH {ASKED} SELECT q.doc_id, q.n, w.title AS found_title FROM q LEFT JOIN works w ON lower(q.doi) = w.doi")
def _(t):
    return asked(t).withColumn("doi", F.lower("doi")).join(t("works").select("doi", F.col("title").alias("found_title")), "doi", "left").select("doc_id", "n", "found_title")


@query(
    "ver_verify",
    "refs",
    "works",
    sql=f"""WITH {SEARCH}, d AS (SELECT q.doc_id, q.n, q.title, w.doi AS found_doi, w.title AS found_title FROM q LEFT JOIN works w ON lower(q.doi) = w.doi),
 a AS (SELECT doc_id, n, len(list_intersect({TOK('title')}, {TOK('found_title')})) > 0 AS matched, found_doi FROM d WHERE found_doi IS NOT NULL),
 b AS (SELECT d.doc_id, d.n, coalesce(h.score >= 0.85, FALSE) AS matched, coalesce(h.score, 0) AS confidence, h.doi AS found_doi FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id AND d.n = h.n AND h.rank = 1 WHERE d.found_doi IS NULL),
 u AS (SELECT doc_id, n, matched, CASE WHEN matched THEN 1.0::DOUBLE ELSE 0.84::DOUBLE END AS confidence, found_doi FROM a UNION ALL SELECT * FROM b)
 SELECT doc_id, n, found_doi, round(confidence, 6) AS confidence, CASE WHEN matched THEN 'verified' WHEN confidence < 0.3 THEN 'halluc' ELSE 'review' END AS status FROM u""",
)
def _(t):
    return vf.verify(asked(t), t("works")).select("doc_id", "n", "found_doi", F.round("confidence", 6).alias("confidence"), "status")


@query("ver_ensemble_doi", "checked", sql="SELECT doc_id, tier, pos, doi, title FROM (SELECT doc_id, n % 3 AS tier, n AS pos, lower(doi) AS doi, CASE WHEN n % 2 = 0 THEN '' ELSE raw END AS title FROM checked) x WHERE coalesce(doi, '') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, doi ORDER BY coalesce(title, '') = '', tier, pos) = 1")
def _(t):
    c = t("checked")
    return vf.ensemble(c.select("doc_id", (F.col("n") % 3).alias("tier"), F.col("n").alias("pos"), F.lower("doi").alias("doi"), F.when(F.col("n") % 2 == 0, "").otherwise(F.col("raw")).alias("title")))


@query("ver_review_reason", "checked", sql="SELECT doc_id, n, CASE WHEN status = 'unchecked' THEN 'The catalogues did not answer; the entry is not checked' WHEN n % 20 <= 5 THEN 'Two candidates score alike' WHEN confidence < 0.85 THEN 'The best candidate is below the threshold' ELSE 'Confidence ' || printf('%.2f', confidence) END AS reason FROM checked")
def _(t):
    c, f = t("checked"), F.col("confidence")
    # the distance to the runner-up, in hundredths, is n % 20
    near = F.when(F.col("n") % 20 <= 5, f).otherwise(f + 1)
    return c.select("doc_id", "n", vf.review_reason(F.col("status"), f, near, f).alias("reason"))


@query("ver_source_door", "checked", sql="SELECT doc_id, n, n % 3 = 0 OR ts >= until AS open, CASE WHEN n % 2 = 0 THEN ts + to_seconds(n * 60) ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS closes FROM (SELECT doc_id, n, TIMESTAMP '2024-03-05 10:00:00' AS ts, TIMESTAMP '2024-03-05 09:00:00' + to_hours(n % 4) AS until FROM checked) x")
def _(t):
    now = F.lit("2024-03-05 10:00:00").cast("timestamp")
    until = F.when(F.col("n") % 3 != 0, F.lit("2024-03-05 09:00:00").cast("timestamp") + F.make_interval(hours=(F.col("n") % 4).cast("int")))
    retry = F.when(F.col("n") % 2 == 0, (F.col("n") * 60).cast("string")).otherwise("soon")
    return t("checked").select("doc_id", "n", vf.door_open(until, now).alias("open"), vf.closes_until(retry, now).alias("closes"))


@query("ver_abstract", "documents", sql="SELECT doc_id, nullif(text, '') AS abstract FROM documents")
def _(t):
    # whole texts as inverted indexes (word to its places), then read back
    d = t("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    words = d.groupBy("doc_id", "w").agg(F.collect_list("i").alias("at"))
    index = words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select("doc_id", vf.abstract_of(F.col("index")).alias("abstract"))


# -- manual review ----------------------------------------------------------------------
@query("rev_latest_decision", "markers", sql=f"WITH {EVENTS} SELECT doc_id, n, \"at\", action FROM last")
def _(t):
    return rv.latest(event_log(t)).select("doc_id", "n", "at", "action")


@query(
    "rev_apply_decisions",
    "checked",
    "markers",
    sql=f"""WITH {EVENTS} SELECT c.doc_id, c.n, CASE WHEN action = 'reject' THEN '—' WHEN action IN ('confirm', 'correct') THEN coalesce(nullif(trim(l.title), ''), raw) ELSE raw END AS title,
 CASE WHEN action = 'reject' THEN 'no match' WHEN action IN ('confirm', 'correct') THEN coalesce(nullif(trim(l.doi), ''), c.doi) ELSE c.doi END AS doi,
 CASE WHEN action IN ('confirm', 'correct') THEN coalesce(TRY_CAST(l.year AS BIGINT), c.year) ELSE c.year END AS year, CASE WHEN action = 'reject' THEN NULL ELSE citations END AS citations, CASE WHEN action = 'reject' THEN NULL ELSE retracted END AS retracted,
 CASE WHEN action = 'reject' THEN 'halluc' WHEN action IN ('confirm', 'correct') THEN 'verified' ELSE status END AS status, CASE WHEN action IN ('reject', 'confirm', 'correct') THEN "at" END AS decided_at
 FROM checked c LEFT JOIN last l ON c.doc_id = l.doc_id AND c.n = l.n""",
)
def _(t):
    return rv.apply_decisions(t("checked"), event_log(t))


@query("rev_recategorize", "checked", sql=f"WITH {DUPS} SELECT doc_id, n, CASE WHEN to_status = 'dup' THEN dup_of END AS dup_of, status IN ('verified', 'dup') AND to_status <> 'verified' AS clears FROM (SELECT *, CASE n % 3 WHEN 0 THEN 'dup' WHEN 1 THEN 'verified' ELSE 'review' END AS to_status FROM results) x")
def _(t):
    to = F.when(F.col("n") % 3 == 0, "dup").when(F.col("n") % 3 == 1, "verified").otherwise("review")
    dup, clears = rv.recategorize(F.col("status"), to, F.col("dup_of"))
    return result_rows(t).select("doc_id", "n", dup.alias("dup_of"), clears.alias("clears"))


@query("rev_stamp", sql="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp FROM events")
def _(t):
    return t("events").select("event_id", rv.stamp(F.col("ts")).alias("stamp"))


# -- synthetic defects -------------------------------------------------------------------
@query("syn_citation_plan", "refs", sql="WITH k AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM refs) SELECT doc_id, n, CASE WHEN k % 5 = 0 THEN 'narrative' WHEN k % 5 = 1 THEN 'parenthetical' WHEN k % 5 = 2 THEN 'locator' WHEN k % 5 = 3 AND k = c - 1 THEN 'parenthetical' ELSE 'grouped' END AS form, (k // 5) * 4 + least(k % 5, 3) AS marker FROM k")
def _(t):
    return sy.citation_plan(t("refs"))


@query("syn_text_defects", "works", sql="""SELECT work_id, CASE (work_id - 1) % 3 WHEN 0 THEN '[' || work_id || '] ' || title WHEN 1 THEN work_id || '. ' || title ELSE title END AS mixed, regexp_replace(regexp_replace('A "quoted" 12-19 ' || outlet, '"([^"]*)"', '“\\1”', 'g'), '(\\d)-(\\d)', '\\1–\\2', 'g') AS smart,
 substr(title, 1, CAST(floor(length(title) * 0.6) AS INTEGER)) AS cut, 'a ' || regexp_replace(title, '\\s+', ' ', 'g') AS merged FROM works""")
def _(t):
    w, title = t("works"), F.col("title")
    return w.select("work_id", sy.mixed_numbering(title, F.col("work_id") - 1).alias("mixed"), sy.smart_punctuation(F.concat(F.lit('A "quoted" 12-19 '), "outlet")).alias("smart"), sy.truncate(title, 0.6).alias("cut"), sy.merged_entries(F.concat(F.lit(" a\n\n"), title)).alias("merged"))


@query("syn_field_defects", "works", sql="""SELECT work_id, CASE WHEN length(surname) >= 3 AND m + 1 < length(surname) THEN substr(surname, 1, m) || substr(surname, m + 2, 1) || substr(surname, m + 1, 1) || substr(surname, m + 3) ELSE surname END AS typo,
 substr(CAST(year AS VARCHAR), 1, 1) || substr(CAST(year AS VARCHAR), 3, 1) || substr(CAST(year AS VARCHAR), 2, 1) || substr(CAST(year AS VARCHAR), 4, 1) AS swapped,
 regexp_extract(doi, '^(.*)(\\d)(\\D*)$', 1) || ((CAST(regexp_extract(doi, '^(.*)(\\d)(\\D*)$', 2) AS INTEGER) + 1) % 10) || regexp_extract(doi, '^(.*)(\\d)(\\D*)$', 3) AS doi,
 array_to_string(list_transform(list_filter(regexp_split_to_array('Journal of ' || outlet || ' and Notes', '\\s+'), lambda x: regexp_matches(x, '^[A-Z]')), lambda x: substr(x, 1, 1) || '.'), '') AS journal
 FROM (SELECT *, CAST(floor(length(surname) / 2) AS INTEGER) AS m FROM works) x""")
def _(t):
    w = t("works")
    return w.select("work_id", sy.author_typo(F.col("surname")).alias("typo"), sy.year_swap(F.col("year")).alias("swapped"), sy.doi_typo(F.col("doi")).alias("doi"), sy.journal_abbreviation(F.concat(F.lit("Journal of "), "outlet", F.lit(" and Notes"))).alias("journal"))


@query("syn_doi_variants", "works", sql="SELECT work_id, v.variant, CASE v.variant WHEN 0 THEN doi WHEN 1 THEN 'doi:' || doi WHEN 2 THEN 'https://doi.org/' || doi ELSE 'http://dx.doi.org/' || doi END AS spelling, doi AS normalized FROM works, (VALUES (0), (1), (2), (3)) v(variant)")
def _(t):
    from citemill.functions.text import normal_doi

    return sy.doi_variants(t("works")).select("work_id", "variant", "spelling", normal_doi(F.col("spelling")).alias("normalized"))


@query("syn_page_swap", "refs", sql="SELECT doc_id, n, coalesce(CASE WHEN k % 2 = 1 THEN lead(work_id) OVER w ELSE lag(work_id) OVER w END, work_id) AS swapped FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM refs) x WINDOW w AS (PARTITION BY doc_id ORDER BY n)")
def _(t):
    return sy.page_swap(t("refs"), "work_id").select("doc_id", "n", "swapped")


@query("src_bibtex", "works", sql="""SELECT 'w' || work_id AS key, '@article{w' || work_id || ',' || chr(10) || '  author = {' || surname || '},' || chr(10) || '  title = {' || replace(replace(title, '&', '\\&'), '_', '\\_') || '},' || chr(10) || '  journal = {' || replace(replace(outlet, '&', '\\&'), '_', '\\_') || '},' || chr(10) || '  year = {' || year || '},' || chr(10) || '  doi = {' || doi || '},' || chr(10) || '}' AS record FROM works""")
def _(t):
    return sy.bibtex(t("works").select(F.concat(F.lit("w"), F.col("work_id").cast("string")).alias("key"), F.col("surname").alias("author"), "title", "outlet", "year", "doi"))
