"""Queries of tier arbitration, catalogue records and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.operators import aggregate as agg
from citemill.operators import lines as ln
from citemill.operators import tiers as ti
from citemill.operators import verify as vf
from citemill.plans.q_relational import DUPS, MATCHES, matched, result_rows
from citemill.plans.q_text import HITS, PARAS, lines
from citemill.plans.registry import query

TIERS = """
 t1 AS (SELECT doc_id, n, 'parsed ' || raw_text AS raw_text FROM entries e WHERE (SELECT count(*) FROM entries x WHERE x.doc_id = e.doc_id) % 2 = 0),
 t0 AS (SELECT doc_id, n, raw_text FROM entries)"""


def tiers(t):
    from pyspark.sql import Window

    e = t("entries").withColumn("k", F.count("*").over(Window.partitionBy("doc_id")))
    one = e.where("k % 2 = 0").select("doc_id", "n", F.concat(F.lit("parsed "), "raw_text").alias("raw_text"))
    return one, t("entries").select("doc_id", "n", "raw_text")


@query("spl_preferred_entries", "entries", sql=f"WITH {TIERS} SELECT *, 1 AS tier FROM t1 UNION ALL SELECT *, 0 FROM t0 WHERE doc_id NOT IN (SELECT doc_id FROM t1)")
def _(t):
    return ti.preferred_entries(*tiers(t))


@query("spl_extraction_status", "entries", "refs", sql=f"WITH {TIERS} SELECT d.doc_id, CASE WHEN a > 0 THEN 'tier1' WHEN b > 0 THEN 'tier0' ELSE 'no_bibliography' END AS status, coalesce(a, b, 0) AS entries FROM (SELECT DISTINCT doc_id FROM refs) d LEFT JOIN (SELECT doc_id, count(*) AS a FROM t1 GROUP BY 1) x ON x.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS b FROM t0 GROUP BY 1) y ON y.doc_id = d.doc_id")
def _(t):
    return ti.extraction_status(t("refs").select("doc_id").distinct(), *tiers(t))


COMBINED = f"""{MATCHES},
 own AS (SELECT doc_id, seq, seq * 10 AS start, seq * 10 + 6 AS stop, status, reference_n FROM matches),
 ctx AS (SELECT doc_id, seq, CASE WHEN doc_id % 6 = 0 AND seq = 1 THEN NULL ELSE seq * 10 + seq % 4 END AS start, CASE WHEN doc_id % 6 = 0 AND seq = 1 THEN NULL ELSE seq * 10 + seq % 4 + 5 END AS stop,
                CASE WHEN seq % 3 = 1 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN seq % 3 = 1 THEN coalesce(reference_n, 1) + seq % 2 END AS reference_n FROM matches),
 located AS (SELECT doc_id, bool_and(start IS NOT NULL) AS ok FROM ctx GROUP BY 1),
 kept AS (SELECT o.* FROM own o LEFT JOIN located l ON l.doc_id = o.doc_id WHERE coalesce(l.ok, TRUE) AND NOT EXISTS (SELECT 1 FROM ctx c WHERE c.doc_id = o.doc_id AND c.start IS NOT NULL AND o.start < c.stop AND c.start < o.stop AND (o.status <> 'resolved' OR c.reference_n = o.reference_n))),
 first AS (SELECT c.* FROM ctx c WHERE NOT (c.status = 'unresolved' AND c.start IS NOT NULL AND EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = c.doc_id AND k.start < c.stop AND c.start < k.stop)))"""


@query("joi_combined_matches", "markers", "entries", sql=f"WITH {COMBINED} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start NULLS LAST, stop, tier DESC, seq) AS pos FROM (SELECT *, 1 AS tier FROM first UNION ALL SELECT *, 0 AS tier FROM kept) x")
def _(t):
    m, s = matched(t), F.col("seq")
    own = m.select("doc_id", "seq", (s * 10).alias("start"), (s * 10 + 6).alias("stop"), "status", "reference_n")
    lost = (F.col("doc_id") % 6 == 0) & (s == 1)
    at = F.when(~lost, s * 10 + s % 4)
    sure = s % 3 == 1
    ctx = m.select("doc_id", "seq", at.alias("start"), (at + 5).alias("stop"), F.when(sure, "resolved").otherwise("unresolved").alias("status"), F.when(sure, F.coalesce("reference_n", F.lit(1)) + s % 2).alias("reference_n"))
    return ti.combined_matches(ctx, own)


@query("rel_citation_places", "markers", "entries", sql=f"WITH {MATCHES} SELECT doc_id, reference_n AS n, seq * 10 AS start, TRUE AS certain, row_number() OVER (PARTITION BY doc_id, reference_n ORDER BY seq) AS rank FROM matches WHERE status = 'resolved'")
def _(t):
    m = matched(t).withColumn("start", F.col("seq") * 10).withColumn("candidates", F.array().cast("array<bigint>"))
    return ti.citation_places(m)


@query("anc_passage_html", sql=f"WITH {PARAS}, {HITS}, a AS (SELECT h.doc_id, h.start, h.stop, least(h.start, min(p.start)) AS lo, greatest(h.stop, max(p.stop)) AS hi FROM hits h LEFT JOIN paras p ON h.doc_id = p.doc_id AND h.start < p.stop AND p.start < h.stop GROUP BY 1, 2, 3) SELECT a.doc_id, a.start, md5(CASE WHEN lo > 0 THEN '…' ELSE '' END || replace(replace(replace(replace(replace(substr(text, lo + 1, start - lo), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') || '<mark> the </mark>' || replace(replace(replace(replace(replace(substr(text, stop + 1, hi - stop), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') || CASE WHEN hi < length(text) THEN '…' ELSE '' END) AS digest FROM a JOIN documents d ON d.doc_id = a.doc_id")
def _(t):
    docs = t("documents").select("doc_id", "text")
    a = ln.anchors(ln.occurrences(docs, " the "), ln.line_paragraphs(lines(t))).join(docs, "doc_id")
    page = ti.passage_html(F.col("text"), F.col("start"), F.col("stop"), F.col("context_start"), F.col("context_stop"))
    return a.select("doc_id", "start", F.md5(page.cast("binary")).alias("digest"))


@query("ver_record_fields", "works", sql="SELECT work_id, coalesce(CASE WHEN work_id % 3 = 0 THEN year END, CASE WHEN work_id % 2 = 0 THEN year + 1 END, year + 2) AS year, CASE WHEN work_id % 4 = 1 THEN doi || '/r' END AS retraction_doi, CASE WHEN work_id % 5 = 0 THEN 'Inst' ELSE coalesce(nullif(CASE WHEN work_id % 2 = 0 THEN '' ELSE outlet END, ''), 'Pub') END AS outlet FROM works")
def _(t):
    k, y = F.col("work_id"), F.col("year")
    update = lambda kind, doi: F.struct(F.lit(kind).alias("type"), doi.alias("doi"))
    updates = F.when(k % 4 == 0, F.array(update("correction", F.col("doi")))).when(k % 4 == 1, F.array(update("Correction", F.col("doi")), update("Retraction", F.concat("doi", F.lit("/r"))))).otherwise(F.array().cast("array<struct<type: string, doi: string>>"))
    return t("works").select(
        "work_id",
        ti.record_year(F.when(k % 3 == 0, y), F.when(k % 2 == 0, y + 1), y + 2).alias("year"),
        ti.record_retraction(updates).alias("retraction_doi"),
        ti.record_outlet(F.when(k % 5 == 0, "preprint"), F.lit("Inst"), F.when(k % 2 == 0, "").otherwise(F.col("outlet")), F.lit("Pub")).alias("outlet"),
    )


@query("ver_names", "works", sql="SELECT work_id, array_to_string(list_filter(list_transform(string_split(title, ' ')[1:5], lambda x: trim(x)), lambda x: x <> ''), ',') AS names FROM works")
def _(t):
    return t("works").select("work_id", F.array_join(vf.names_of(F.split("title", " "), 5), ",").alias("names"))


@query("src_link_check", "entries", sql="SELECT doc_id, n, n % 5 <> 4 AND status < 400 AS reachable FROM (SELECT doc_id, n, 200 + (n % 4) * 100 AS status FROM entries) x")
def _(t):
    """Look-up of each entry's URL in a table of answers; a URL without an answer isn't reachable."""
    e = t("entries").select("doc_id", "n", F.concat(F.lit("https://pypi.org/p/"), "doc_id", F.lit("/"), "n").alias("url"))
    answers = e.where("n % 5 <> 4").select("url", (200 + (F.col("n") % 4) * 100).alias("status"))
    return e.join(answers, "url", "left").select("doc_id", "n", F.coalesce(F.col("status") < 400, F.lit(False)).alias("reachable"))


@query("src_gold_entries", "checked", sql="SELECT doc_id, n AS pos, CASE WHEN n % 2 = 0 THEN 'unstructured ' || raw ELSE raw END AS title, lower(doi) AS doi FROM checked")
def _(t):
    c, even = t("checked"), F.col("n") % 2 == 0
    items = c.select("doc_id", F.col("n").alias("pos"), F.when(even, "").otherwise(F.col("raw")).alias("article_title"), F.concat(F.lit("unstructured "), "raw").alias("unstructured"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"))
    return ti.gold_entries(items)


@query("src_works_by_id", "works", sql="SELECT work_id, 'W' || work_id AS short_id, title FROM works")
def _(t):
    """References resolved by their catalogue ids' last path segment."""
    w = t("works")
    ids = w.select(F.concat(F.lit("https://catalogue.example/W"), F.col("work_id").cast("string")).alias("url")).select(F.substring_index("url", "/", -1).alias("short_id"))
    return ids.join(w.select("work_id", F.concat(F.lit("W"), F.col("work_id").cast("string")).alias("short_id"), "title"), "short_id").select("work_id", "short_id", "title")


@query("agg_list_note", "checked", sql=f"WITH {DUPS}, g AS (SELECT doc_id, list(n ORDER BY n) AS ns FROM results WHERE status <> 'verified' GROUP BY 1) SELECT doc_id, array_to_string(ns[1:6], ', ') || CASE WHEN len(ns) > 6 THEN ' and ' || (len(ns) - 6) || ' more' ELSE '' END AS note FROM g")
def _(t):
    rows = result_rows(t).where("status <> 'verified'").groupBy("doc_id").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    return rows.select("doc_id", agg.list_note(F.col("ns")).alias("note"))


@query("agg_display_strings", "checked", sql="SELECT doc_id, n, CASE WHEN starts_with(doi, '10.') THEN 'https://doi.org/' || doi END AS link, concat_ws(' · ', nullif(outlet, ''), CASE WHEN n % 2 = 0 THEN NULL ELSE 'today' END) AS note FROM checked")
def _(t):
    return t("checked").select("doc_id", "n", ti.doi_link(F.col("doi")).alias("link"), ti.lookup_note(F.col("outlet"), F.when(F.col("n") % 2 == 1, "today").otherwise("")).alias("note"))


@query("syn_duplicate_doi", "checked", sql="SELECT doc_id, n, CASE WHEN n = 2 THEN first_value(doi) OVER (PARTITION BY doc_id ORDER BY n) ELSE doi END AS doi FROM checked")
def _(t):
    from pyspark.sql import Window

    first = F.first("doi").over(Window.partitionBy("doc_id").orderBy("n"))
    return t("checked").withColumn("f", first).select("doc_id", "n", F.when(F.col("n") == 2, F.col("f")).otherwise(F.col("doi")).alias("doi"))


@query("syn_split_corruption", "entries", sql="SELECT doc_id, CASE WHEN n = 2 THEN 1 ELSE n END AS n, string_agg(raw_text, ' ' ORDER BY n) AS raw_text FROM entries GROUP BY doc_id, CASE WHEN n = 2 THEN 1 ELSE n END")
def _(t):
    """The second entry runs into the first."""
    e = t("entries").withColumn("m", F.when(F.col("n") == 2, F.lit(1).cast("bigint")).otherwise(F.col("n")))
    out = e.groupBy("doc_id", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw_text"))), lambda x: x.raw_text), " ").alias("raw_text"))
    return out.select("doc_id", F.col("m").alias("n"), "raw_text")
