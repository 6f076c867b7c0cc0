"""Queries of whole checks, of benchmarks and of defects; the plans that texts are made from are the oracles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from citemill.functions import names as nm
from citemill.operators import aggregate as agg
from citemill.operators import check as ck
from citemill.operators import lines as ln
from citemill.operators import matching as mt
from citemill.operators import review as rv
from citemill.operators import synth as sy
from citemill.operators import tiers as ti
from citemill.plans.q_relational import EVENTS, event_log
from citemill.plans.registry import query
from citemill.sources import files


# -- manuscripts as texts ---------------------------------------------------------------
def manuscripts(t):
    """A text a manuscript: a sentence a marker, the heading and the list; lists without numbers are cited by author and date."""
    m = t("markers").withColumn("n", F.when(F.col("number") > 50, F.col("number") - 50).otherwise(F.col("number")))
    w = t("refs").join(t("works"), "work_id").select("doc_id", "n", "surname", "year")
    m = m.join(w, ["doc_id", "n"])
    dated = F.concat(F.lit("Earlier work ("), "surname", F.lit(", "), F.col("year").cast("string"), F.lit(") holds."))
    said = F.when(F.col("doc_id") % 3 == 2, dated).otherwise(F.concat(F.lit("It holds in part ["), F.col("number").cast("string"), F.lit("].")))
    joined = lambda by, c, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c.alias("x")))), lambda x: x.x), glue)
    bodies = m.groupBy("doc_id").agg(joined("seq", said, " ").alias("body"))
    lists = t("entries").groupBy("doc_id").agg(joined("n", F.col("raw_text"), "\n").alias("list"))
    return bodies.join(lists, "doc_id").select("doc_id", F.concat("body", F.lit("\n\nReferences\n\n"), "list").alias("text"))


# the entries that splitting finds: k printed ones, of which the first keeps its number where the second is missing, or all in one
READ = """
 c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, doc_id % 10 = 0 AS gap, doc_id % 3 = 2 AS dated FROM entries),
 lists AS (SELECT doc_id, max(k) AS k, bool_or(gap) AS gap, bool_or(dated) AS dated, bool_or(k = 1 OR (NOT dated AND gap AND k = 2)) AS whole FROM c GROUP BY doc_id),
 shape AS (SELECT *, CASE WHEN whole THEN 1 ELSE k END AS found, NOT dated AND NOT gap AND k >= 2 AS numbered FROM lists)"""


@query("joi_printed_entries", "entries", sql=f"""WITH {READ} SELECT c.doc_id, CASE WHEN whole THEN 1 ELSE c.i END AS pos, CASE WHEN numbered THEN c.n END AS number FROM c JOIN shape s ON c.doc_id = s.doc_id WHERE NOT whole OR c.i = 1""")
def _(t):
    lists = t("entries").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw_text"))), lambda x: x.raw_text), "\n").alias("text"))
    return ck.printed_entries(lists).select("doc_id", "pos", "number")


@query("spl_extract_entries", "entries", "markers", "works", sql=f"""WITH {READ} SELECT doc_id, found AS entries, CASE WHEN dated AND k >= 2 THEN 'author-date' WHEN NOT dated AND k >= 2 THEN 'numbered' ELSE 'author-date,numbered' END AS families FROM shape""")
def _(t):
    x = ck.extract(manuscripts(t))
    n = x.entries.groupBy("doc_id").agg(F.count("*").alias("entries"))
    return n.join(x.families, "doc_id").select("doc_id", "entries", "families")


# a marker by number finds that number (a list left whole keeps its first), or where lists print none that hold, that position; one by author and date
# the entries of the same author and year
OUTCOMES = f"""{READ},
 m AS (SELECT m.*, r.n AS ref_n, w.surname, w.year FROM markers m JOIN refs r ON r.doc_id = m.doc_id AND r.n = CASE WHEN m.number > 50 THEN m.number - 50 ELSE m.number END JOIN works w ON w.work_id = r.work_id),
 alike AS (SELECT m.doc_id, m.seq, count(c.n) AS hits, min(c.i) AS first FROM m JOIN c ON c.doc_id = m.doc_id AND c.surname = m.surname AND c.year = m.year GROUP BY 1, 2),
 outcome AS (SELECT m.doc_id, m.seq, CASE
   WHEN s.dated THEN CASE WHEN coalesce(a.hits, 0) = 0 THEN 'orphaned' WHEN a.hits = 1 THEN 'resolved' ELSE 'ambiguous' END
   WHEN s.numbered OR s.whole THEN CASE WHEN m.number <= s.found THEN 'resolved' ELSE 'orphaned' END
   ELSE CASE WHEN m.number <= s.found THEN 'resolved' ELSE 'unresolved' END END AS status,
   CASE WHEN s.dated THEN CASE WHEN a.hits = 1 THEN a.first END WHEN m.number <= s.found THEN m.number END AS reference_n
  FROM m JOIN shape s ON s.doc_id = m.doc_id LEFT JOIN alike a ON a.doc_id = m.doc_id AND a.seq = m.seq)"""


@query("joi_match_citations", "entries", "markers", "refs", "works", sql=f"WITH {OUTCOMES} SELECT doc_id, seq, status, reference_n FROM outcome")
def _(t):
    return ck.match_citations(ck.extract(manuscripts(t))).select("doc_id", "seq", "status", "reference_n")


@query("ver_full_check", "entries", "markers", "refs", "works", sql=f"""WITH {OUTCOMES}, o AS (SELECT doc_id, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'orphaned') AS orphaned, count(*) FILTER (status = 'unresolved') AS unresolved FROM outcome GROUP BY doc_id)
 SELECT s.doc_id, found AS "references", found AS verified, 0::BIGINT AS review, 0::BIGINT AS halluc, 0::BIGINT AS unchecked, 0::BIGINT AS dup, resolved, ambiguous, orphaned, unresolved, 'bibliography' AS found FROM shape s JOIN o ON o.doc_id = s.doc_id""")
def _(t):
    return ck.full_check(manuscripts(t), t("works"))


@query("spl_tier1_entries", "entries", "refs", "works", sql=f"""WITH {READ} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN k ELSE found END AS entries, doc_id % 4 = 1 AS structured FROM shape""")
def _(t):
    """A structured parser's entries stand for a document's own where it has any."""
    e = t("entries").where("doc_id % 4 = 1")
    tier1 = e.select("doc_id", "n", F.concat(F.lit("rebuilt "), "raw_text").alias("raw_text"), F.col("raw_text").alias("source_text"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("doi"))
    x = ck.extract(manuscripts(t), tier1)
    return x.entries.groupBy("doc_id").agg(F.count("*").alias("entries"), F.bool_and(F.col("source_text").isNotNull()).alias("structured"))


# -- ambiguous matches -------------------------------------------------------------------------
MATCHED = """
 mm AS (SELECT doc_id, seq, seq * 10 AS start, CASE seq % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'orphaned' ELSE 'unresolved' END AS status, 1 + seq % 3 AS a, 2 + seq % 3 AS b FROM markers),
 runs AS (SELECT doc_id, bool_and(status = 'unresolved') AS none FROM mm GROUP BY doc_id),
 sure AS (SELECT doc_id, a AS n, count(*) AS k FROM mm WHERE status = 'resolved' GROUP BY 1, 2),
 may AS (SELECT doc_id, n, count(*) AS k FROM (SELECT doc_id, unnest([a, b]) AS n FROM mm WHERE status = 'ambiguous') x GROUP BY 1, 2),
 per AS (SELECT e.doc_id, e.n, CASE WHEN none THEN 0 ELSE coalesce(s.k, 0) END AS times_cited, CASE WHEN none THEN 0 ELSE coalesce(m.k, 0) END AS possible, none FROM refs e JOIN runs r ON r.doc_id = e.doc_id LEFT JOIN sure s ON s.doc_id = e.doc_id AND s.n = e.n LEFT JOIN may m ON m.doc_id = e.doc_id AND m.n = e.n),
 worded AS (SELECT doc_id, n, times_cited, possible, NOT none AND times_cited = 0 AND possible = 0 AS uncited, CASE WHEN none THEN 'No in-text citation could be matched' WHEN times_cited = 1 THEN 'Cited once in this manuscript' WHEN times_cited > 1 THEN 'Cited ' || times_cited || ' times in this manuscript' WHEN possible > 0 THEN 'Possibly cited in this manuscript' ELSE 'No citation found in this manuscript' END AS label,
   CASE WHEN none THEN '—' WHEN possible > 0 AND times_cited = 0 THEN '0 (+' || possible || ' ambiguous)' ELSE CAST(times_cited AS VARCHAR) END AS figure FROM per)"""


def mixed_matches(t):
    """Markers of every outcome; ambiguous ones name two entries."""
    s, none = F.col("seq"), F.array().cast("array<bigint>")
    status = F.element_at(F.array(*map(F.lit, (mt.RESOLVED, mt.AMBIGUOUS, mt.ORPHANED, mt.UNRESOLVED))), (s % 4 + 1).cast("int"))
    a = 1 + s % 3
    return t("markers").select("doc_id", "seq", (s * 10).alias("start"), status.alias("status"), F.when(s % 4 == 0, a).alias("reference_n"), F.when(s % 4 == 1, F.array(a, a + 1)).otherwise(none).alias("candidates"))


@query("agg_possible_counts", "markers", "refs", sql=f"WITH {MATCHED} SELECT * FROM worded")
def _(t):
    m = mixed_matches(t)
    docs = m.select("doc_id").distinct().withColumn("has_body", F.lit(True))
    out = mt.per_reference(t("refs").join(docs.select("doc_id"), "doc_id"), m, mt.run_status(docs, m))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("times_cited", "possible")})


@query("rel_unused_with_candidates", "markers", "refs", sql=f"WITH {MATCHED} SELECT e.doc_id, e.n FROM refs e LEFT JOIN sure s ON s.doc_id = e.doc_id AND s.n = e.n LEFT JOIN may m ON m.doc_id = e.doc_id AND m.n = e.n WHERE s.n IS NULL AND m.n IS NULL")
def _(t):
    return mt.unused_references(t("refs"), mixed_matches(t))


@query("rel_ambiguous_places", "markers", sql=f"WITH {MATCHED.split(' runs AS')[0].rstrip().rstrip(',')}, p AS (SELECT doc_id, a AS n, start, TRUE AS certain FROM mm WHERE status = 'resolved' UNION ALL SELECT doc_id, unnest([a, b]), start, FALSE FROM mm WHERE status = 'ambiguous') SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY certain DESC, start) AS rank FROM p")
def _(t):
    return ti.citation_places(mixed_matches(t))


@query("agg_report_rows", "markers", "refs", "works", sql=f"""WITH {MATCHED},
 sent AS (SELECT doc_id, seq, 'Sentence ' || seq || ' of it.' AS s FROM markers),
 paras AS (SELECT *, coalesce(sum(length(s) + 2) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sent),
 hits AS (SELECT doc_id, n, string_agg(s, '|' ORDER BY certain DESC, seq) AS passages FROM (SELECT m.doc_id, unnest(CASE WHEN status = 'resolved' THEN [a] ELSE [a, b] END) AS n, status = 'resolved' AS certain, m.seq, s FROM mm m JOIN sent p ON p.doc_id = m.doc_id AND p.seq = m.seq WHERE status IN ('resolved', 'ambiguous')) x GROUP BY 1, 2)
 SELECT w.doc_id, w.n, times_cited, uncited, label, coalesce(passages, '') AS passages FROM worded w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.n = w.n""")
def _(t):
    said = F.concat(F.lit("Sentence "), F.col("seq").cast("string"), F.lit(" of it."))
    ordered = t("markers").select("doc_id", "seq", said.alias("s"))
    at = F.coalesce(F.sum(F.length("s") + 2).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ordered.select("doc_id", "seq", at.alias("start"))
    bodies = ordered.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x.s), "\n\n").alias("text"))
    m = mixed_matches(t).drop("start").join(starts, ["doc_id", "seq"])
    results = t("refs").join(m.select("doc_id").distinct(), "doc_id").join(t("works").select("work_id", F.col("title").alias("raw")), "work_id").select("doc_id", "n", "raw")
    out = ck.citation_table(results, m, bodies)
    return out.select("doc_id", "n", F.col("times_cited").cast("bigint").alias("times_cited"), "uncited", "label", F.array_join("passages", "|").alias("passages"))


# -- benchmark ---------------------------------------------------------------------------------
@query("agg_benchmark", "checked", "refs", "works", sql="""WITH f AS (SELECT doc_id, list(DISTINCT lower(doi)) FILTER (doi IS NOT NULL) AS found FROM checked GROUP BY doc_id), g AS (SELECT doc_id, list(DISTINCT CASE WHEN (r.doc_id + r.work_id) % 6 = 0 THEN doi || 'x' ELSE doi END) AS gold, count(*) AS c FROM refs r JOIN works w ON r.work_id = w.work_id GROUP BY doc_id),
 v AS (SELECT g.doc_id, variant, gold, c, coalesce(found, []) AS found FROM g CROSS JOIN (VALUES ('preprint'), ('published')) v(variant) LEFT JOIN f ON f.doc_id = g.doc_id WHERE NOT (variant = 'preprint' AND g.doc_id % 4 = 0)),
 h AS (SELECT *, len(list_intersect(found, gold)) AS hits FROM v), rp AS (SELECT *, CASE WHEN len(gold) > 0 THEN hits / len(gold) ELSE 'NaN'::DOUBLE END AS recall, CASE WHEN len(found) > 0 THEN hits / len(found) ELSE 'NaN'::DOUBLE END AS "precision" FROM h)
 SELECT 'ms' || doc_id AS manuscript, variant, hits, greatest(c, c + doc_id % 3 - 1) AS gold_total, round(recall, 6) AS recall, round("precision", 6) AS "precision", CASE WHEN isnan(recall) OR isnan("precision") OR recall = 0 OR "precision" = 0 THEN 'NaN'::DOUBLE ELSE round(2 * recall * "precision" / (recall + "precision"), 6) END AS f1 FROM rp""")
def _(t):
    other = F.when((F.col("doc_id") + F.col("work_id")) % 6 == 0, F.concat("doi", F.lit("x"))).otherwise(F.col("doi"))
    gold = t("refs").join(t("works"), "work_id").groupBy("doc_id").agg(F.collect_set(other).alias("gold_dois"), F.count("*").alias("crossref_total"))
    variants = gold.select("*", F.explode(F.array(F.lit("preprint"), F.lit("published"))).alias("variant"))
    file = F.when(~((F.col("variant") == "preprint") & (F.col("doc_id") % 4 == 0)), F.col("doc_id"))
    manifest = variants.select(F.concat(F.lit("ms"), F.col("doc_id").cast("string")).alias("manuscript"), "variant", file.alias("doc_id"), "gold_dois", "crossref_total", (F.col("crossref_total") + F.col("doc_id") % 3 - 1).alias("openalex_total"))
    out = ck.benchmark(manifest, t("checked").select("doc_id", F.lower("doi").alias("doi")))
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


# -- defects -----------------------------------------------------------------------------------
@query("syn_mixed_styles", "entries", sql="WITH k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, count(*) OVER (PARTITION BY doc_id) // 2 AS h FROM entries), h AS (SELECT doc_id, 0 AS part, i, raw_text AS text FROM k WHERE i <= h UNION ALL SELECT doc_id, 1, i, '[' || i || '] other ' || raw_text FROM k WHERE i <= h) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, i) AS place, text FROM h")
def _(t):
    e = t("entries").select("doc_id", "n", "raw_text")
    return sy.mixed_styles(e, e.withColumn("raw_text", F.concat(F.lit("other "), "raw_text")))


@query("syn_seeded_order", "refs", sql="SELECT doc_id, n, n AS by_place, count(*) OVER (PARTITION BY doc_id) AS last FROM refs")
def _(t):
    """A reproducible shuffle: places are those of the list, each once, and sorting by entry gives the list again."""
    doc = Window.partitionBy("doc_id")
    out = sy.seeded_order(t("refs"))
    return out.select("doc_id", "n", F.row_number().over(doc.orderBy("place")).cast("bigint").alias("k"), "place", F.max("place").over(doc).alias("last")).select("doc_id", "n", (F.col("n") + F.col("k") - F.col("place")).alias("by_place"), "last")


@query("syn_running_headers", "entries", "refs", sql=None)
def _(t):
    """Headers put into manuscripts go again, and what is left are the manuscripts' own lines."""
    from citemill.plans.q_text import script

    return ln.repeated_lines(sy.running_headers(ln.lines_of(script(t)).select("doc_id", "line_no", "text"), "Harbour manuscript", 4)).where("canonical = 'harbour manuscript'").groupBy("doc_id").agg(F.count("*").alias("headers"))


@query("syn_entry_defects", "works", sql="""SELECT work_id, CASE WHEN work_id % 2 = 0 THEN 'Moe;' || surname ELSE surname END AS authors, surname || ', A.' AS author, CAST(NULL AS BIGINT) AS volume, strip_accents('Ëvá ' || surname) AS bare FROM works""")
def _(t):
    w = t("works").withColumn("authors", F.when(F.col("work_id") % 2 == 0, F.array(F.col("surname"), F.lit("Moe"))).otherwise(F.array("surname"))).withColumn("volume", F.col("work_id"))
    return sy.without_volume(w).select("work_id", F.array_join(sy.author_order(F.col("authors")), ";").alias("authors"), sy.family_given(F.col("surname"), F.lit("A.")).alias("author"), "volume", sy.without_marks(F.concat(F.lit("Ëvá "), "surname")).alias("bare"))


def records(t):
    return t("refs").join(t("works"), "work_id").select("doc_id", "n", "title", "year", F.array("surname").alias("authors"), F.upper("doi").alias("doi"))


@query("syn_content_scores", "refs", "works", sql="SELECT doc_id, n, NOT (n = 2 AND doc_id % 2 = 0) AS doi_match, NOT (n = 2 AND doc_id % 2 = 1) AS title_match FROM refs")
def _(t):
    """One entry of each list has another DOI or another title, and only its own match goes."""
    r, even = records(t), F.col("doc_id") % 2 == 0
    printed = sy.corrupted_at(r, F.lit(2), doi=F.when(even, sy.doi_typo(F.col("doi"))).otherwise(F.col("doi")), title=F.when(even, F.col("title")).otherwise("0"))
    return sy.content_scores(r, printed, nm.title_similarity_udf)


@query("syn_gold_and_extracted", "refs", "works", sql="SELECT doc_id, n, title, CAST(year AS VARCHAR) AS year, surname AS first_author, doi FROM refs r JOIN works w ON r.work_id = w.work_id")
def _(t):
    r = records(t)
    read = sy.as_extracted(r).select("doc_id", "n", F.get("surnames", F.lit(0)).alias("s"), F.col("doi").alias("d"))
    return sy.as_gold(r).join(read, ["doc_id", "n"]).where((F.col("s") == F.col("first_author")) & (F.col("d") == F.col("doi"))).drop("s", "d")


@query("syn_duplicated_rows", "works", sql="SELECT 'w' || work_id || s AS key, title FROM works, (VALUES (''), ('_dup')) v(s)")
def _(t):
    return sy.duplicated(t("works").select(F.concat(F.lit("w"), F.col("work_id").cast("string")).alias("key"), "title"))


@query("syn_defect_catalogue", sql="SELECT * FROM (VALUES ('content', 8::BIGINT), ('layout', 1), ('merge', 3), ('split', 6)) v(stage, defects)")
def _(t):
    return sy.catalogue(t.spark).groupBy("stage").agg(F.count("*").alias("defects"))


# -- review ------------------------------------------------------------------------------------
@query("rev_next_open", "checked", "markers", sql=f"""WITH {EVENTS}, open AS (SELECT c.doc_id, c.n FROM checked c LEFT JOIN (SELECT doc_id, n FROM last WHERE action <> 'reopen') l ON l.doc_id = c.doc_id AND l.n = c.n WHERE status IN ('review', 'unchecked') AND l.n IS NULL)
 SELECT c.doc_id, c.n, coalesce(min(o.n) FILTER (o.n > c.n), min(o.n)) AS next_n FROM checked c LEFT JOIN open o ON o.doc_id = c.doc_id AND o.n <> c.n GROUP BY 1, 2""")
def _(t):
    return rv.next_open(t("checked").select("doc_id", "n"), rv.open_queue(t("checked"), event_log(t)))


@query("rev_confirm_fields", "checked", sql="SELECT doc_id, n, 'verified' AS status, 'Title ' || n AS title, '10.1/' || n AS doi, n / 10.0 AS confidence, CASE WHEN n % 2 = 0 THEN 'Catalogue' ELSE 'Manual review' END AS source, CASE WHEN n % 3 = 0 THEN outlet ELSE 'Outlet' END AS outlet, CAST(1900 + n AS BIGINT) AS year, n % 5 = 0 AS candidate_retracted FROM checked")
def _(t):
    c, n = t("checked"), F.col("n")
    s = n.cast("string")
    candidates = c.select("doc_id", "n", F.concat(F.lit("Title "), s).alias("title"), F.concat(F.lit("10.1/"), s).alias("doi"), (n / 10.0).alias("score"), F.when(n % 2 == 0, "Catalogue").alias("source"), F.when(n % 3 != 0, "Outlet").otherwise("").alias("outlet"), (1900 + n).alias("year"), (n % 5 == 0).alias("retracted"))
    return rv.confirm(c, candidates)


@query("rev_not_findable", "checked", sql="SELECT doc_id, n, 'halluc' AS status, '—' AS title, 'no match' AS doi, CAST(NULL AS BIGINT) AS citations, CAST(NULL AS BOOLEAN) AS retracted, '' AS retraction_doi, CAST(NULL AS BIGINT) AS dup_of FROM checked")
def _(t):
    return rv.not_findable(t("checked").withColumn("retraction_doi", F.lit("10.1/r")).withColumn("dup_of", F.lit(1).cast("bigint")))


@query("rev_watermark", "refs", sql="SELECT DISTINCT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AS watermark FROM refs")
def _(t):
    d = t("refs").select("doc_id").distinct()
    return d.select("doc_id", rv.watermark(F.when(F.col("doc_id") % 2 == 0, "demo").otherwise("local"), F.col("doc_id") % 3 == 0).alias("watermark"))


# -- display and sources ---------------------------------------------------------------------------
@query("agg_cited_by_cell", "checked", sql="SELECT doc_id, n, CASE WHEN status <> 'verified' THEN '—' WHEN n % 3 = 0 AND citations IS NOT NULL THEN format('{:,}', citations) || ' (Crossref)' WHEN n % 3 = 1 AND citations IS NOT NULL THEN format('{:,}', citations) || ' (Crossref) / ' || format('{:,}', citations + 1000) || ' (OpenAlex)' WHEN citations IS NULL THEN '—' ELSE format('{:,}', citations) END AS cell FROM checked")
def _(t):
    n, c = F.col("n") % 3, F.col("citations")
    return t("checked").select("doc_id", "n", agg.cited_by_cell(F.col("status"), F.when(n != 2, c), F.when(n == 1, c + 1000), c).alias("cell"))


@query("agg_sub_line", "checked", sql="SELECT doc_id, 'paper ' || doc_id || '.txt · ' || count(*) || CASE WHEN count(*) = 1 THEN ' reference' ELSE ' references' END AS line FROM checked GROUP BY doc_id")
def _(t):
    return t("checked").groupBy("doc_id").agg(F.count("*").alias("k")).select("doc_id", agg.sub_line(F.concat(F.lit("paper "), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("k")).alias("line"))


@query("idx_entry_text", "entries", sql="SELECT doc_id, n, CASE WHEN n % 2 = 0 THEN 'printed' ELSE raw_text END AS shown, CASE WHEN n % 2 = 0 THEN 'printed ' ELSE '' END || raw_text AS widest FROM entries")
def _(t):
    printed = F.when(F.col("n") % 2 == 0, "printed").otherwise("")
    return t("entries").select("doc_id", "n", ti.display_entry(printed, F.col("raw_text")).alias("shown"), ti.widest_entry(printed, F.col("raw_text")).alias("widest"))


@query("src_tier1_display", "refs", "works", sql="SELECT doc_id, n, concat_ws(' ', nullif(CASE WHEN n % 2 = 0 THEN surname || ', Moe' ELSE '' END, ''), '(' || CASE WHEN n % 3 = 0 THEN NULL ELSE year END || ')', title, 'doi:' || CASE WHEN n % 4 = 0 THEN NULL ELSE doi END) AS shown FROM refs r JOIN works w ON r.work_id = w.work_id")
def _(t):
    from citemill.sources import tei

    r, n = t("refs").join(t("works"), "work_id"), F.col("n")
    authors = F.when(n % 2 == 0, F.array(F.col("surname"), F.lit("Moe"))).otherwise(F.array().cast("array<string>"))
    return r.select("doc_id", "n", tei.display_text(authors, F.when(n % 3 != 0, F.col("year").cast("string")), F.col("title"), F.when(n % 4 != 0, F.col("doi"))).alias("shown"))


@query("src_parsed_json", "refs", "works", sql="SELECT doc_id, n, title, CASE WHEN n % 2 = 0 THEN CAST(year AS VARCHAR) END AS year, surname AS surnames FROM refs r JOIN works w ON r.work_id = w.work_id")
def _(t):
    q = F.lit('"')
    json = F.concat(F.lit('{"title":['), q, "title", q, F.lit(',"x"],"date":['), F.when(F.col("n") % 2 == 0, F.concat(q, F.col("year").cast("string"), q)).otherwise(""), F.lit('],"author":[{"family":'), q, "surname", q, F.lit('},{"given":"only"}]}'))
    rows = t("refs").join(t("works"), "work_id").select(F.struct("doc_id", "n").alias("doc_id"), json.alias("json"))
    return files.adapt_parsed(rows).select("doc_id.doc_id", "doc_id.n", "title", "year", F.array_join("surnames", ",").alias("surnames"))


@query("src_engine", "refs", sql="SELECT DISTINCT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN 'tier0' ELSE 'tier1' END AS engine FROM refs")
def _(t):
    d = t("refs").select("doc_id").distinct()
    return d.select("doc_id", ti.engine_of(F.when(F.col("doc_id") % 3 == 0, "text").otherwise("auto"), F.col("doc_id") % 2 == 1).alias("engine"))


@query("src_dispatch", "documents", sql="SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'paragraphs' WHEN 2 THEN 'unsupported' ELSE 'text' END AS reader, CASE doc_id % 4 WHEN 1 THEN len(list_filter(string_split(text, chr(10)), lambda x: TRUE)) WHEN 2 THEN NULL ELSE 1 END::BIGINT AS parts FROM documents WHERE text IS NOT NULL")
def _(t):
    d, k = t("documents").where("text is not null"), F.col("doc_id") % 4
    name = F.concat(F.lit("Paper."), F.when(k == 0, "TXT").when(k == 1, "docx").when(k == 2, "exe").otherwise("md"))
    return files.dispatched(d.select("doc_id", name.alias("name"), "text")).groupBy("doc_id", "reader").agg(F.when(F.col("reader") != "unsupported", F.count("part")).alias("parts"))


@query("src_second_catalogue", "checked", "works", sql="SELECT doc_id, n, CASE WHEN work_id % 3 = 0 THEN NULL WHEN work_id % 3 = 1 THEN 'Crossref' ELSE 'OpenAlex' END AS source, CASE WHEN work_id % 3 <> 0 THEN w.doi END AS found FROM (SELECT DISTINCT doc_id, n, raw FROM checked) c JOIN works w ON w.title = c.raw")
def _(t):
    """Point look-ups in both catalogues; the first answers where both know a work, and a closed door answers nothing."""
    w = t("works")
    a, b = w.where("work_id % 3 = 1"), w.where("work_id % 3 <> 0")
    asked = t("checked").select("doc_id", "n", "raw").distinct().join(w.select(F.col("title").alias("raw"), F.col("doi").alias("asked")), "raw").select("doc_id", "n", "asked")
    return ti.first_source(asked, {"Crossref": a, "OpenAlex": b, "Closed": w}, closed={"Closed"}).select("doc_id", "n", "source", "found")
