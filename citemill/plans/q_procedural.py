"""Queries of operators with sequential state, and of the fuzzy ones.  Where bodies are made
from planned markers the plan itself is the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import names as nm
from citemill.functions.arrow import expand_rows
from citemill.operators import audit as au
from citemill.operators import detect as dt
from citemill.operators import matching as mt
from citemill.operators import normalize as no
from citemill.operators import split as sp
from citemill.plans.q_text import script
from citemill.plans.registry import query
from citemill.sources import tei as te


def bodies(t):
    """A body a manuscript: numbered or author-date sentences in marker order."""
    m = t("markers").join(t("author_markers").select("doc_id", "seq", "surname", "year"), ["doc_id", "seq"], "left")
    dated = F.concat(F.lit("Earlier work ("), F.coalesce("surname", F.lit("Nobody")), F.lit(", "), F.coalesce("year", F.lit("n.d.")), F.lit(") holds."))
    sentence = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("It holds in part ["), F.col("number").cast("string"), F.lit("]."))).otherwise(dated)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", sentence.alias("s")))), lambda x: x.s), " ")
    return m.groupBy("doc_id").agg(text.alias("text")).withColumn("families", F.lit("author-date,numbered"))


@query(
    "det_markers",
    "markers",
    "author_markers",
    sql="SELECT m.doc_id, m.seq, CASE WHEN m.doc_id % 2 = 0 THEN 'numbered' ELSE 'author-date' END AS family, CASE WHEN m.doc_id % 2 = 1 THEN coalesce(a.surname, 'Nobody') END AS authors, CASE WHEN m.doc_id % 2 = 1 THEN coalesce(a.year, 'n.d.') END AS year, CASE WHEN m.doc_id % 2 = 0 THEN m.number END AS number, FALSE AS narrative FROM markers m LEFT JOIN author_markers a ON m.doc_id = a.doc_id AND m.seq = a.seq",
)
def _(t):
    return dt.detect_markers(bodies(t)).select("doc_id", "seq", "family", "authors", "year", "number", "narrative")


@query("det_documents_have_none", sql="SELECT doc_id, text FROM documents WHERE FALSE")
def _(t):
    """Invented prose has no marker."""
    docs = t("documents").select("doc_id", "text").withColumn("families", F.lit("author-date,numbered"))
    return dt.detect_markers(docs).select("doc_id", F.col("marker_text").alias("text"))


@query(
    "det_marker_forms",
    "forms",
    sql="""WITH k(form, seq, family, authors, year, number, narrative) AS (VALUES (0, 1, 'author-date', '{S}', '{Y}', NULL, TRUE), (1, 1, 'author-date', '{S} and Moe', '{Y}', NULL, TRUE),
  (2, 1, 'author-date', '{S}', '{Y}', NULL, FALSE), (2, 2, 'author-date', 'Moe', 'n.d.', NULL, FALSE), (3, 1, 'numbered', NULL, NULL, 12, NULL), (9, 1, 'numbered', NULL, NULL, 1, NULL),
  (9, 2, 'numbered', NULL, NULL, 3, NULL), (9, 3, 'numbered', NULL, NULL, 4, NULL), (9, 4, 'numbered', NULL, NULL, 5, NULL), (11, 1, 'author-date', '{S}', '{Y}', NULL, TRUE), (12, 1, 'author-date', 'van der {S} et al.', '{Y}b', NULL, TRUE))
 SELECT work_id AS doc_id, seq::BIGINT AS seq, family, replace(authors, '{S}', surname) AS authors, replace(k.year, '{Y}', y) AS year, number::BIGINT AS number, coalesce(narrative, FALSE) AS narrative FROM forms JOIN k ON forms.form = k.form""",
)
def _(t):
    bodies = t("forms").select(F.col("work_id").alias("doc_id"), "text", F.lit("author-date,numbered").alias("families"))
    return dt.detect_markers(bodies).select("doc_id", "seq", "family", "authors", "year", "number", "narrative")


@query(
    "det_parse_marker",
    "forms",
    sql="SELECT work_id AS doc_id, marker, CASE work_id % 6 WHEN 0 THEN 'numbered' WHEN 5 THEN 'numbered' ELSE 'author-date' END AS family, CASE WHEN work_id % 6 IN (1, 2) THEN surname END AS authors, CASE WHEN work_id % 6 IN (1, 2) THEN y END AS year, CASE work_id % 6 WHEN 0 THEN 12::BIGINT WHEN 5 THEN 3::BIGINT END AS number FROM forms WHERE work_id % 6 NOT IN (3, 4)",
)
def _(t):
    rows = lambda r: [(r["work_id"], r["marker"], m[0], m[4], m[5], m[6]) for m in dt.parse_marker(r["marker"])]
    return expand_rows(t("forms").select("work_id", "marker"), rows, "doc_id bigint, marker string, family string, authors string, year string, number bigint")


# lists in which each gate decides: numbers with and without a gap, authors on their lines, one entry alone
@query(
    "spl_split_cascade",
    "entries",
    sql="""WITH c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, doc_id % 10 = 0 AS gap FROM entries),
 d AS (SELECT *, k = 1 OR (doc_id % 3 <> 2 AND gap AND k = 2) AS whole FROM c)
 SELECT doc_id, i AS n, CASE WHEN doc_id % 3 = 2 OR (gap AND i = 1) THEN raw_text ELSE regexp_replace(raw_text, '^(\\[\\d+\\]|\\d+\\.) ', '') END AS raw_text FROM d WHERE NOT whole
 UNION ALL SELECT doc_id, 1, string_agg(raw_text, chr(10) ORDER BY n) FROM d WHERE whole GROUP BY doc_id""",
)
def _(t):
    bibs = t("entries").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw_text"))), lambda x: x.raw_text), "\n").alias("text"))
    return sp.split_bibliographies(bibs)


@query("spl_titles", "styled", sql="SELECT work_id, CASE WHEN style < 4 THEN 'Notes on ' || kind END AS title FROM styled")
def _(t):
    return expand_rows(t("styled").select("work_id", "raw_text"), lambda r: [(r["work_id"], sp.title_of(r["raw_text"]))], "work_id bigint, title string")


@query(
    "idx_reference_keys",
    "styled",
    sql="SELECT work_id, surname, CASE style WHEN 0 THEN y || 'a' WHEN 4 THEN y || ',' || (y::INT + 3) ELSE y END AS years, style < 4 AND strpos(raw_text, y) <= 80 AS dated FROM styled",
)
def _(t):
    rows = lambda r: [(r["work_id"], (k := nm.reference_key(r["raw_text"]))["surname"], ",".join(k["years"]), k["dated"])]
    return expand_rows(t("styled").select("work_id", "raw_text"), rows, "work_id bigint, surname string, years string, dated boolean")


@query("idx_rule_entries", "refs", "works", sql="SELECT r.doc_id, r.n, CASE WHEN r.n % 3 = 2 THEN lag(surname) OVER w WHEN r.n % 3 = 0 THEN lag(surname, 2) OVER w ELSE surname END AS surname FROM refs r JOIN works k ON r.work_id = k.work_id WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.n)")
def _(t):
    """Two of three entries open with a rule in place of their authors."""
    e = t("refs").join(t("works"), "work_id").select("doc_id", "n", F.when(F.col("n") % 3 == 1, F.concat("surname", F.lit(", A. "))).otherwise("———. ").alias("head"), F.concat(F.col("year").cast("string"), F.lit(". Tides.")).alias("rest"))
    lists = e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "rest").alias("raw")))), lambda x: x.raw).alias("raws"))
    rows = lambda r: [(r["doc_id"], i, k["surname"]) for i, k in enumerate(nm.inherited([nm.reference_key(x) for x in r["raws"]]), start=1)]
    return expand_rows(lists, rows, "doc_id bigint, n bigint, surname string")


@query("sim_marker_surnames", "works", sql="SELECT work_id, CASE work_id % 4 WHEN 0 THEN surname || ',Moe' WHEN 1 THEN surname || ',van der Brack,Zed' WHEN 2 THEN surname ELSE 'de ' || surname END AS surnames FROM works")
def _(t):
    k, s = F.col("work_id") % 4, F.col("surname")
    run = F.when(k == 0, F.concat(s, F.lit(" und Moe"))).when(k == 1, F.concat(s, F.lit(", van der Brack, & Zed et al."))).when(k == 2, F.concat(s, F.lit(" u. a."))).otherwise(F.concat(F.lit("J. de "), s))
    return expand_rows(t("works").select("work_id", run.alias("run")), lambda r: [(r["work_id"], ",".join(nm.marker_surnames(r["run"])))], "work_id bigint, surnames string")


@query(
    "sim_name_similarity",
    "works",
    sql="SELECT work_id, CASE work_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(2.0 * length(surname) / (2 * length(surname) + 1), 6) ELSE 0.0 END::DOUBLE AS similarity FROM works",
)
def _(t):
    """A particle more, a letter more at the end, and names without a common letter."""
    k, s = F.col("work_id") % 3, F.col("surname")
    other = F.when(k == 0, F.concat(F.lit("de "), F.upper(s))).when(k == 1, F.concat(s, F.lit("x"))).otherwise("---")
    return t("works").select("work_id", F.round(nm.name_similarity_udf(s, other), 6).alias("similarity"))


@query("joi_resolve_author_date", "author_markers", "entries")
def _(t):
    keys = t("entries").select("doc_id", "n", "surname", F.array(F.col("year").cast("string")).alias("years"), F.lit(True).alias("dated"))
    out = mt.resolve_author_date(t("author_markers"), keys, nm.name_similarity_udf)
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


@query("sim_title_similarity", "works")
def _(t):
    w = t("works")
    return w.select("work_id", F.round(nm.title_similarity_udf(F.concat(F.lit("On "), "title"), F.col("title")), 6).alias("similarity"))


@query("sim_fold_name", sql="SELECT p_partkey::BIGINT AS work_id, trim(regexp_replace(lower(strip_accents('Ëva ' || p_name)), '[^a-z ]', ' ', 'g')) AS folded FROM part")
def _(t):
    return t("part").select(F.col("p_partkey").cast("bigint").alias("work_id"), nm.fold_udf(F.concat(F.lit("Ëva "), "p_name")).alias("folded"))


# what the chain leaves of a script, with raw lines: the title takes the next line, numbers and bullets go, a header that
# comes once stays, and takes what follows the list if that opens no entry and is no heading
CHAIN = """
 ranked AS (SELECT doc_id, n, raw_text, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, count(*) OVER (PARTITION BY doc_id) AS k, count(*) FILTER (n % 2 = 1 AND n % 5 <> 0) OVER (PARTITION BY doc_id) AS headers FROM entries),
 lists AS (SELECT doc_id, max(k) AS k, max(CASE WHEN i = k AND headers = 1 AND n % 2 = 1 AND n % 5 <> 0 THEN 'Running header ' || n END) AS last_header FROM ranked GROUP BY doc_id),
 tails AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Appendix A. More' WHEN doc_id % 3 = 1 THEN 'Acknowledgements' ELSE 'Manuscript received: March 5, 2020' END AS tail, doc_id % 3 = 2 AND last_header IS NOT NULL AS taken FROM lists),
 kept AS (
  SELECT doc_id, 0 AS part, 0 AS i, 0 AS j, 'Paper ' || doc_id || ' Body text of paper ' || doc_id AS text, 0 AS origin, '0:0,' || (7 + length(CAST(doc_id AS VARCHAR))) || ':2' AS segments FROM lists
  UNION ALL SELECT doc_id, 1, 0, 0, CASE WHEN doc_id % 4 = 0 THEN 'Literature cited:' ELSE 'References' END, 4, '0:4' FROM lists
  UNION ALL SELECT doc_id, 2, i, 0, raw_text, 2 + 4 * i, '0:' || (2 + 4 * i) FROM ranked
  UNION ALL SELECT r.doc_id, 2, r.i, 1, 'Running header ' || n || CASE WHEN t.taken AND r.i = r.k THEN ' ' || t.tail ELSE '' END, 4 + 4 * r.i, '0:' || (4 + 4 * r.i) || CASE WHEN t.taken AND r.i = r.k THEN ',' || length('Running header ' || n) + 1 || ':' || (6 + 4 * r.k) ELSE '' END FROM ranked r JOIN tails t ON r.doc_id = t.doc_id WHERE headers = 1 AND n % 2 = 1 AND n % 5 <> 0
  UNION ALL SELECT doc_id, 3, 0, 0, tail, 6 + 4 * k, '0:' || (6 + 4 * k) FROM tails WHERE NOT taken),
 spaced AS (SELECT *, 1 AS own FROM kept UNION ALL SELECT doc_id, part, i, j, '', origin, '0:' || origin, 0 FROM kept WHERE part > 0
  UNION ALL SELECT doc_id, 4, 0, 0, 'Thanks to all.', 7 + 4 * k, '0:' || (7 + 4 * k), 1 FROM tails)"""


@query("nrm_chain", "entries", "refs", sql=f"WITH {CHAIN} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, i, j, own) - 1 AS line_no, text, origin::BIGINT AS origin, segments FROM spaced")
def _(t):
    return no.normalize_documents(script(t))


@query("nrm_table_rows", "entries", sql="SELECT doc_id, n, i::INTEGER AS i, CASE i WHEN 0 THEN n || '. ' || raw_text ELSE (n + 1) || '. more' END AS part FROM entries, (VALUES (0), (1)) v(i)")
def _(t):
    row = F.concat(F.lit("|**"), F.col("n").cast("string"), F.lit(".** "), "raw_text", F.lit(" | **"), (F.col("n") + 1).cast("string"), F.lit(".**<br>more|"))
    rows = lambda r: [(r["doc_id"], r["n"], i, x.text) for i, x in enumerate(no.table_rows([no.Line(r["row"], ((0, 0),))]))]
    return expand_rows(t("entries").select("doc_id", "n", row.alias("row")), rows, "doc_id bigint, n bigint, i int, part string")


PRINTED = """
 printed AS (SELECT doc_id, n AS pos, raw_text AS text FROM entries),
 extracted AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND n = 2 THEN 1 ELSE n END AS n, string_agg(raw_text, ' ' ORDER BY n) AS text FROM entries WHERE NOT (doc_id % 5 = 0 AND n = 3) GROUP BY 1, 2),
 p AS (SELECT doc_id, pos, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +'), lambda x: x <> '')) AS pw FROM printed),
 e AS (SELECT doc_id, n, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +'), lambda x: x <> '')) AS ew, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS el FROM extracted),
 s AS (SELECT p.doc_id, p.pos, e.n, CASE WHEN e.n IS NULL OR least(len(pw), len(ew)) < 4 THEN 0 ELSE least(1.0, (len(list_intersect(pw, ew)) + len(list_filter(pw, lambda w: NOT list_contains(ew, w) AND length(w) >= 4 AND contains(el, w)))) / least(len(pw), len(ew))) END AS score FROM p LEFT JOIN e ON p.doc_id = e.doc_id),
 o AS (SELECT doc_id, pos, CASE WHEN score >= 0.85 THEN n END AS owner FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, n) = 1),
 k AS (SELECT x.doc_id, x.n, count(o.pos) AS k FROM extracted x LEFT JOIN o ON o.doc_id = x.doc_id AND o.owner = x.n GROUP BY 1, 2)"""


def lists(t):
    e = t("entries")
    printed = e.select("doc_id", F.col("n").alias("pos"), F.col("raw_text").alias("text"))
    merged = F.when((F.col("doc_id") % 7 == 0) & (F.col("n") == 2), 1).otherwise(F.col("n")).cast("bigint")
    kept = e.where(~((F.col("doc_id") % 5 == 0) & (F.col("n") == 3)))
    extracted = kept.groupBy("doc_id", merged.alias("m")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw_text"))), lambda x: x.raw_text), " ").alias("text"))
    return printed, extracted.withColumnRenamed("m", "n")


@query("joi_list_owners", "entries", sql=f"WITH {PRINTED} SELECT doc_id, pos, owner FROM o")
def _(t):
    return au.owners(*lists(t))


@query(
    "joi_list_audit",
    "entries",
    sql=f"""WITH {PRINTED}, a AS (SELECT doc_id, count(*) AS printed_count, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (owner IS NULL), '') AS missing FROM o GROUP BY doc_id),
 b AS (SELECT doc_id, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (k > 1), '') AS merged, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (k = 0), '') AS unmatched FROM k GROUP BY doc_id)
 SELECT a.doc_id, printed_count, coalesce(merged, '') AS merged, coalesce(unmatched, '') AS unmatched, missing, coalesce(merged, '') = '' AND coalesce(unmatched, '') = '' AND missing = '' AS complete FROM a LEFT JOIN b ON a.doc_id = b.doc_id""",
)
def _(t):
    return au.audit(*lists(t))


@query("agg_parsing_scores", "checked")
def _(t):
    c = t("checked").select("doc_id", F.col("n").alias("pos"), F.col("raw").alias("title"))
    found = c.select("doc_id", "pos", F.when(F.col("pos") % 4 == 0, F.substring("title", 1, 9)).otherwise(F.concat(F.lit("On "), "title")).alias("title"))
    return au.score_parsing(c, found)


@query("ver_ensemble", "checked")
def _(t):
    c = t("checked")
    return au.ensemble(c.select("doc_id", (F.col("n") % 3).cast("bigint").alias("tier"), F.col("n").alias("pos"), F.lower("doi").alias("doi"), F.when(F.col("n") % 2 == 0, "").otherwise(F.col("raw")).alias("title")))


PLACED = """
 said AS (SELECT m.doc_id, m.seq, CASE WHEN m.doc_id % 2 = 0 THEN 'It holds in part [' || m.number || '].' ELSE 'Earlier work (' || coalesce(a.surname, 'Nobody') || ', ' || coalesce(a.year, 'n.d.') || ') holds.' END AS s FROM markers m LEFT JOIN author_markers a ON m.doc_id = a.doc_id AND m.seq = a.seq),
 placed AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) IS NULL AS last FROM said)"""


@query("joi_locate_markers", "markers", "author_markers", sql=f"WITH {PLACED} SELECT doc_id, seq, CASE WHEN doc_id % 2 = 0 THEN pos + 17 ELSE pos + 13 END AS start, CASE WHEN doc_id % 2 = 0 THEN pos + length(s) - 1 ELSE pos + length(s) - 7 END AS stop FROM placed")
def _(t):
    body = bodies(t)
    wanted = dt.detect_markers(body).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "marker_text"))), lambda x: x.marker_text).alias("ms"))

    def one(r):
        for i, at in enumerate(au.located(r["text"], r["ms"]), start=1):
            yield (r["doc_id"], i, *(at or (None, None)))

    return expand_rows(body.join(wanted, "doc_id").select("doc_id", "text", "ms"), one, "doc_id bigint, seq bigint, start bigint, stop bigint")


@query("anc_sentences", "markers", "author_markers", sql=f"WITH {PLACED} SELECT doc_id, seq, pos AS start, pos + length(s) + CASE WHEN last THEN 0 ELSE 1 END AS stop FROM placed")
def _(t):
    """The sentence about every marker of a body."""

    def one(r):
        for i, m in enumerate(dt.detect(r["text"]), start=1):
            yield (r["doc_id"], i, *no.sentence_bounds(r["text"], m[2], m[3]))

    return expand_rows(bodies(t).select("doc_id", "text"), one, "doc_id bigint, seq bigint, start bigint, stop bigint")


# -- structured-parser responses ----------------------------------------------------------
def responses(t):
    """A response a manuscript: its header's own record, a paragraph a marker with the marker in inline markup, and its list."""
    n = F.col("n").cast("string")
    record = F.concat(F.lit('<biblStruct xml:id="b'), n, F.lit('"><analytic><title level="a">'), "title", F.lit("</title><author><persName><surname>"), "surname", F.lit('</surname></persName></author></analytic><monogr><title level="j">'), "outlet", F.lit('</title><imprint><date type="published" when="'), F.col("year").cast("string"), F.lit('-03"/></imprint></monogr><idno type="DOI">https://doi.org/'), F.upper("doi"), F.lit('</idno><note type="raw_reference">'), "surname", F.lit("\n  "), "title", F.lit(".</note></biblStruct>"))
    ordered = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c.alias("x")))), lambda x: x.x), "\n")
    lists = t("refs").join(t("works"), "work_id").groupBy("doc_id").agg(ordered(record, "n").alias("records"))
    k = F.col("number").cast("string")
    passage = F.concat(F.lit("<p>Before <hi>see\n   <ref type=\"bibr\" target=\"#b"), k, F.lit('">['), k, F.lit("] </ref></hi> after. </p>"))
    paragraphs = t("markers").groupBy("doc_id").agg(ordered(passage, "seq").alias("ps"))
    tei = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><biblStruct><analytic><title>own</title></analytic></biblStruct></teiHeader><text><body><div>'), "ps", F.lit('</div></body><back><listBibl><p>own <ref type="bibr">[1]</ref></p>'), "records", F.lit("</listBibl></back></text></TEI>"))
    return lists.join(paragraphs, "doc_id").select("doc_id", tei.alias("tei"))


@query("src_tei_references", "refs", "works", sql="SELECT doc_id, n, 'b' || n AS source_id, title, CAST(year AS VARCHAR) AS year, doi, surname AS surnames, surname || ' ' || title || '.' AS raw FROM refs r JOIN works w ON r.work_id = w.work_id")
def _(t):
    return te.read_references(responses(t)).withColumn("surnames", F.array_join("surnames", ","))


@query("src_tei_contexts", "markers", sql="SELECT doc_id, seq, 'b' || number AS target, '[' || number || ']' AS marker_text, 'Before see [' || number || '] after.' AS paragraph_text, 11::BIGINT AS start, 13 + length(CAST(number AS VARCHAR)) AS stop FROM markers")
def _(t):
    return te.read_contexts(responses(t))


@query("src_tei_linked", "markers", "refs", sql="SELECT m.doc_id, seq, number AS printed, r.n AS reference_n FROM markers m LEFT JOIN refs r ON m.doc_id = r.doc_id AND m.number = r.n")
def _(t):
    found = responses(t)
    out = te.linked(te.read_contexts(found), te.read_references(found))
    return out.select("doc_id", "seq", F.regexp_extract("marker_text", r"\d+", 0).cast("bigint").alias("printed"), "reference_n")


@query("idx_inherited_authors", "entries", sql="SELECT doc_id, n, CASE WHEN n % 3 = 2 THEN last_value(CASE WHEN n % 3 <> 2 THEN surname END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) ELSE surname END AS surname FROM entries")
def _(t):
    return au.previous_wins(t("entries"), "surname", F.col("n") % 3 == 2).select("doc_id", "n", "surname")


@query("str_event_windows", sql="SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS k, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    """Batch form of the streaming window aggregate."""
    from citemill.streaming.reviews import event_windows

    return event_windows(t("events")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "k", F.round("total", 4).alias("total"))
