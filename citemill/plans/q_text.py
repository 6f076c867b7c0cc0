"""Queries of the text operators: normalization, anchors, splitting, similarity, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import text as tx
from citemill.operators import lines as ln
from citemill.plans.registry import query

LINES = """
 ls AS (SELECT doc_id, i - 1 AS line_no, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS k FROM documents WHERE text IS NOT NULL) x WHERE NOT (i = k AND line = '')),
 lines AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ls)"""


def lines(t):
    return ln.lines_of(t("documents"))


@query("nrm_lines", sql=f"WITH {LINES} SELECT doc_id, line_no::INTEGER AS line_no, start, length(text)::INTEGER AS k, md5(text) AS digest FROM lines")
def _(t):
    return lines(t).select("doc_id", "line_no", "start", F.length("text").alias("k"), F.md5(F.col("text").cast("binary")).alias("digest"))


# manuscripts with page numbers, headers and a bibliography, made from entries
SCRIPT = """
 script AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, n, k) - 1 AS line_no, line AS text FROM (
   SELECT doc_id, 0 AS part, 0 AS n, k, CASE k WHEN 0 THEN '# Paper ' || doc_id WHEN 1 THEN '' WHEN 2 THEN 'Body **text** of <b>paper</b> ' || doc_id WHEN 3 THEN '' WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN 'Literature cited:' ELSE 'References' END ELSE '' END AS line FROM (SELECT DISTINCT doc_id FROM refs) d, (VALUES (0), (1), (2), (3), (4), (5)) v(k)
   UNION ALL SELECT doc_id, 1, n, k, CASE k WHEN 0 THEN raw_text WHEN 1 THEN '' WHEN 2 THEN CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) WHEN n % 5 = 0 THEN '- x' ELSE 'Running header ' || n END ELSE '' END FROM entries, (VALUES (0), (1), (2), (3)) v(k)
   UNION ALL SELECT doc_id, 2, 0, k, CASE k WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'Appendix A. More' WHEN doc_id % 3 = 1 THEN 'Acknowledgements' ELSE 'Manuscript received: March 5, 2020' END ELSE 'Thanks to all.' END FROM (SELECT DISTINCT doc_id FROM refs) d, (VALUES (0), (1)) v(k)) x),
 sl AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM script)"""


def script(t):
    """The same manuscripts as the oracle's, as one text a document, split into lines."""
    d = F.col("doc_id").cast("string")
    head = F.array(
        F.concat(F.lit("# Paper "), d), F.lit(""), F.concat(F.lit("Body **text** of <b>paper</b> "), d), F.lit(""), F.when(F.col("doc_id") % 4 == 0, "Literature cited:").otherwise("References"), F.lit("")
    )
    n = F.col("n").cast("string")
    each = F.array(F.col("raw_text"), F.lit(""), F.when(F.col("n") % 2 == 0, n).when(F.col("n") % 5 == 0, "- x").otherwise(F.concat(F.lit("Running header "), n)), F.lit(""))
    tail = F.array(F.when(F.col("doc_id") % 3 == 0, "Appendix A. More").when(F.col("doc_id") % 3 == 1, "Acknowledgements").otherwise("Manuscript received: March 5, 2020"), F.lit("Thanks to all."))
    middle = t("entries").groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", each.alias("ls")))), lambda x: x.ls)), "\n").alias("mid"))
    docs = t("refs").select("doc_id").distinct().join(middle, "doc_id", "left")
    return docs.select("doc_id", F.concat_ws("\n", F.array_join(head, "\n"), "mid", F.array_join(tail, "\n")).alias("text"))


def script_lines(t):
    return ln.lines_of(script(t))


def plain(c: str) -> str:
    """A line without marks, as the other engine's expression."""
    for pattern, kept in ((r"^\s*>\s*", ""), (r"^#{1,6}\s*", ""), (r"^\s*[-*]\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"_(.+?)_", r"\1"), (r"~~(.+?)~~", r"\1"), (r"</?[a-zA-Z][^<>]*>", "")):
        c = f"regexp_replace({c}, '{pattern}', '{kept}', 'g')"
    return c


def starts_entry(c: str) -> str:
    return (
        f"(regexp_matches({c}, '^\\s*(\\[\\d+\\]|\\d+[.)])(\\s|$)') OR regexp_matches({c}, '^\\s*\\d{{1,3}}\\s') OR NOT regexp_matches({c}, '^(and|&)\\s') AND"
        f" (regexp_matches({c}, '^([A-Za-zÀ-ÿ]+\\s+){{0,2}}[A-ZÀ-Ý][\\w''-]*,\\s*[A-ZÀ-Ý]\\.') OR regexp_matches({c}, '^([a-zà-ý]+\\s+){{0,2}}[A-ZÀ-Ý][\\w''-]*\\s+[A-Z]{{1,4}}\\b')))"
    )


def header(c: str) -> str:
    """Neither bullet nor sentence nor start of an entry."""
    return f"(trim({c}) <> '' AND NOT regexp_matches({c}, '^\\s*[-*]\\s+') AND NOT (regexp_matches(trim({plain(c)}), '[.?!][\"\\x27”)\\]]*$') AND len(list_filter(regexp_split_to_array(trim({plain(c)}), '\\s+'), lambda y: y <> '')) >= 4) AND NOT {starts_entry(plain(c))})"


CANONICAL = f"regexp_replace(lower(trim({plain('text')})), '\\d+', '#', 'g')"


ISO = "(trim(text) <> '' AND coalesce(trim(lag(text) OVER w), '') = '' AND coalesce(trim(lead(text) OVER w), '') = '')"
W = "WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"


@query("nrm_isolated", "entries", "refs", sql=f"WITH {SCRIPT} SELECT doc_id, line_no::INTEGER AS line_no, {ISO} AS isolated FROM sl {W}")
def _(t):
    return script_lines(t).withColumn("isolated", ln.isolated()).select("doc_id", "line_no", "isolated")


@query("nrm_page_numbers", "entries", "refs", sql=f"WITH {SCRIPT} SELECT doc_id, line_no::INTEGER AS line_no, text FROM (SELECT *, {ISO} AS i FROM sl {W}) x WHERE NOT (i AND regexp_matches(trim(text), '^\\d{{1,4}}$'))")
def _(t):
    return ln.without_page_numbers(script_lines(t)).select("doc_id", "line_no", "text")


@query("nrm_decorative_bullets", "entries", "refs", sql=f"WITH {SCRIPT} SELECT doc_id, line_no::INTEGER AS line_no, text FROM (SELECT *, {ISO} AS i FROM sl {W}) x WHERE NOT (i AND regexp_matches(text, '^\\s*[-*]\\s+') AND length(trim({plain('text')})) <= 1)")
def _(t):
    return ln.without_bullets(script_lines(t)).select("doc_id", "line_no", "text")


HEADERS = f"""
 cand AS (SELECT doc_id, line_no, {CANONICAL} AS canonical FROM (SELECT *, {ISO} AS i FROM sl {W}) x WHERE i AND {header('text')}),
 rep AS (SELECT *, count(*) OVER (PARTITION BY doc_id, canonical) AS k, row_number() OVER (PARTITION BY doc_id, canonical ORDER BY line_no) AS occurrence FROM cand QUALIFY k >= 2)"""


@query("nrm_repeated_lines", "entries", "refs", sql=f"WITH {SCRIPT}, {HEADERS} SELECT doc_id, line_no::INTEGER AS line_no, canonical, k, occurrence FROM rep")
def _(t):
    return ln.repeated_lines(script_lines(t))


@query("nrm_running_headers", "entries", "refs", sql=f"WITH {SCRIPT}, {HEADERS}, gone AS (SELECT doc_id, line_no FROM rep WHERE NOT (occurrence = 1 AND canonical IN ('references', 'literature cited:', 'literature cited', 'acknowledgements'))) SELECT sl.doc_id, sl.line_no::INTEGER AS line_no, sl.text FROM sl LEFT JOIN gone ON gone.doc_id = sl.doc_id AND gone.line_no = sl.line_no WHERE gone.doc_id IS NULL")
def _(t):
    return ln.without_running_headers(script_lines(t)).select("doc_id", "line_no", "text")


@query("nrm_document_repeats", sql=f"WITH {LINES}, c AS (SELECT doc_id, line_no, {CANONICAL} AS canonical FROM lines WHERE {header('text')}) SELECT doc_id, line_no::INTEGER AS line_no, count(*) OVER (PARTITION BY doc_id, canonical) AS k FROM c QUALIFY k >= 2")
def _(t):
    return ln.repeated_lines(lines(t), only_isolated=False).select("doc_id", "line_no", "k")


@query("nrm_strip_markup", sql="SELECT page_id, length(regexp_replace(html, '</?[a-zA-Z][^<>]*>', '', 'g'))::INTEGER AS k FROM pages")
def _(t):
    return t("pages").select("page_id", F.length(F.regexp_replace("html", r"</?[a-zA-Z][^<>]*>", "")).alias("k"))


@query("nrm_markup_lines", "entries", "refs", sql=f"WITH {SCRIPT} SELECT doc_id, line_no::INTEGER AS line_no, {plain('text')} AS text FROM sl")
def _(t):
    return script_lines(t).select("doc_id", "line_no", tx.strip_markup(F.col("text")).alias("text"))


@query("nrm_entry_complete", "entries", sql="SELECT doc_id, n, regexp_matches(raw_text, '[.?!][\"\\x27”)\\]]*\\s*$') OR regexp_matches(raw_text, '(https?://|doi:|doi\\.org/|10\\.\\d{4,9}/)\\S+\\s*$') AS complete FROM entries")
def _(t):
    return t("entries").select("doc_id", "n", tx.entry_complete(F.col("raw_text")).alias("complete"))


# -- bibliography ----------------------------------------------------------------------
BOUNDS = """
 marked AS (SELECT *, regexp_replace(lower(trim(text)), ':+$', '') IN ('references', 'literature cited') AS heading,
   regexp_replace(lower(trim(text)), ':+$', '') = 'acknowledgements' OR ((prev IS NULL OR regexp_matches(prev, '[.?!]["\\x27”)\\]]*\\s*$') OR regexp_matches(prev, '(https?://|doi:|doi\\.org/|10\\.\\d{4,9}/)\\S+\\s*$')) AND (regexp_matches(trim(text), '^[Aa]ppendi(x|ces)\\s+[A-Z0-9]{1,4}\\b[.:]?\\s*[^.]{0,60}\\.?$') OR regexp_matches(trim(text), '^(?i)(manuscript\\s+)?received\\b[^.]{0,60}(1[5-9]\\d{2}|20\\d{2})[^.]{0,20}\\.?$'))) AS stop
  FROM (SELECT *, last_value(CASE WHEN trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sl) x),
 heads AS (SELECT doc_id, min(line_no) AS at0 FROM marked WHERE heading GROUP BY doc_id),
 bounds AS (SELECT m.doc_id, h.at0 + 1 AS first_line, coalesce(min(m.line_no) FILTER (m.stop AND m.line_no > h.at0), max(m.line_no) + 1) AS last_line FROM marked m JOIN heads h ON m.doc_id = h.doc_id GROUP BY m.doc_id, h.at0)"""


@query("spl_bibliography_bounds", "entries", "refs", sql=f"WITH {SCRIPT}, {BOUNDS} SELECT doc_id, first_line::INTEGER AS first, last_line::INTEGER AS last FROM bounds")
def _(t):
    return ln.bibliography_bounds(script_lines(t))


@query("spl_bibliography_text", "entries", "refs", sql=f"WITH {SCRIPT}, {BOUNDS} SELECT m.doc_id, md5(trim(string_agg(text, chr(10) ORDER BY line_no), ' ' || chr(10))) AS digest FROM marked m JOIN bounds b ON m.doc_id = b.doc_id WHERE line_no >= first_line AND line_no < last_line GROUP BY m.doc_id")
def _(t):
    return ln.bibliography(script_lines(t)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("anc_body_lines", "entries", "refs", sql=f"WITH {SCRIPT}, {BOUNDS} SELECT m.doc_id, line_no::INTEGER AS line_no FROM marked m LEFT JOIN bounds b ON m.doc_id = b.doc_id WHERE b.doc_id IS NULL OR line_no < first_line - 1 OR line_no >= last_line")
def _(t):
    return ln.body(script_lines(t)).select("doc_id", "line_no")


@query("spl_blank_line_split", "entries", "refs", sql=f"WITH {SCRIPT}, g AS (SELECT *, trim(text) = '' AS b, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM sl) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS n, string_agg(trim(text), ' ' ORDER BY line_no) AS raw_text FROM g WHERE NOT b GROUP BY doc_id, island")
def _(t):
    return ln.blank_line_entries(script(t))


def bibliographies(t):
    """Reference lists as texts; every seventh has signs of both families besides, every eleventh none."""
    lists = t("entries").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw_text"))), lambda x: x.raw_text), "\n").alias("text"))
    both = F.lit('\n[1] Moe, L., "Of tides and sands," J., 1999.\n[2] Quill, T., 2001. Of sands.\nMoe L. Tides (3. Aufl.).\nBrack, U. (2002a). X. Abgerufen am 1. Mai von y.\n\nZed, Q. (2003). Z.')
    return lists.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "Only prose.\n").when(F.col("doc_id") % 7 == 0, F.concat("text", both)).otherwise(F.col("text")).alias("text"))


BIBS = """
 bibs AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Only prose.' || chr(10) WHEN doc_id % 7 = 0 THEN t || chr(10) || '[1] Moe, L., "Of tides and sands," J., 1999.' || chr(10) || '[2] Quill, T., 2001. Of sands.' || chr(10) || 'Moe L. Tides (3. Aufl.).' || chr(10) || 'Brack, U. (2002a). X. Abgerufen am 1. Mai von y.' || chr(10) || chr(10) || 'Zed, Q. (2003). Z.' ELSE t END AS text FROM (SELECT doc_id, string_agg(raw_text, chr(10) ORDER BY n) AS t FROM entries GROUP BY doc_id) x),
 bl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM bibs),
 per_line AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '^\\s*\\[\\d+\\](\\s|$)')) AS bracket_numbers, count(*) FILTER (regexp_matches(line, '^\\s*\\d+[.)](\\s|$)')) AS dot_numbers, count(*) FILTER (NOT regexp_matches(line, '^(and|&)\\s') AND regexp_matches(line, '^([a-zà-ý]+\\s+){0,2}[A-ZÀ-Ý][\\w''-]*\\s+[A-Z]{1,4}\\b')) AS jss_starts, count(*) AS lines FROM bl WHERE trim(line) <> '' GROUP BY doc_id),
 profile AS (SELECT b.doc_id, bracket_numbers, dot_numbers, jss_starts, len(regexp_extract_all(text, '(^|[^0-9])\\((1[5-9]\\d\\d|20\\d\\d)[a-z]?\\b')) AS paren_years, len(regexp_extract_all(text, '([A-ZÀ-Ý]\\.|[A-ZÀ-Ý][\\w''-]+),\\s*(1[5-9]\\d\\d|20\\d\\d)[a-z]?\\.\\s+')) AS comma_years, len(regexp_extract_all(text, ',\\s["“][^"“”]{5,300}["”]')) AS quoted_titles, len(regexp_extract_all(text, '\\(\\d+\\.\\s*Aufl\\.\\)')) + len(regexp_extract_all(text, '(?i)\\bAbgerufen\\s+am\\b.*?\\bvon\\b')) AS german_signs,
   len(list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '([A-ZÀ-Ý]\\.|[A-ZÀ-Ý][\\w''-]+),\\s*(1[5-9]\\d\\d|20\\d\\d)[a-z]?\\.\\s+', ' ', 'g'), '([^0-9])\\((1[5-9]\\d\\d|20\\d\\d)[a-z]?\\b', ' ', 'g'), '\\d+'), lambda y: regexp_matches(y, '^(1[5-9]\\d\\d|20\\d\\d)$'))) AS bare_years, lines
   FROM bibs b JOIN per_line p ON b.doc_id = p.doc_id)"""


@query("spl_style_profile", "entries", sql=f"WITH {BIBS} SELECT doc_id, bracket_numbers, dot_numbers, jss_starts, paren_years, comma_years, quoted_titles, german_signs, bare_years, lines, round(bare_years / lines, 6) AS bare_year_density FROM profile")
def _(t):
    return ln.style_profile(bibliographies(t)).withColumn("bare_year_density", F.round("bare_year_density", 6))


@query("det_expected_families", "entries", sql=f"WITH {BIBS} SELECT doc_id, CASE WHEN (greatest(bracket_numbers, dot_numbers) >= 2) = (greatest(paren_years, comma_years, jss_starts) >= 2) THEN 'author-date,numbered' WHEN greatest(bracket_numbers, dot_numbers) >= 2 THEN 'numbered' ELSE 'author-date' END AS families FROM profile")
def _(t):
    return ln.expected_families(ln.style_profile(bibliographies(t)))


@query("spl_sentences", sql="SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS i, md5(s) AS digest FROM (SELECT doc_id, i, trim(p) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\.\\s+')) AS p, generate_subscripts(regexp_split_to_array(text, '\\.\\s+'), 1) AS i FROM documents) x) y WHERE s <> ''")
def _(t):
    return ln.sentences(t("documents")).select("doc_id", "i", F.md5(F.col("sentence").cast("binary")).alias("digest"))


# -- anchors --------------------------------------------------------------------------
PARAS = LINES + ", paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx, start, start + length(text) AS stop, line_no AS source_line FROM lines WHERE trim(text) <> '')"
HITS = """
 parts AS (SELECT doc_id, unnest(string_split(text, ' the ')) AS part, generate_subscripts(string_split(text, ' the '), 1) AS i, len(string_split(text, ' the ')) AS k FROM documents),
 hits AS (SELECT doc_id, start, start + 5 AS stop FROM (SELECT doc_id, i, k, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT + (i - 1) * 5 AS start FROM parts) x WHERE i < k)"""


@query("anc_line_paragraphs", sql=f"WITH {PARAS} SELECT * FROM paras")
def _(t):
    return ln.line_paragraphs(lines(t))


@query("anc_paragraphs", "entries", "refs", sql=f"WITH {SCRIPT}, g AS (SELECT *, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM sl) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(line_no)) - 1 AS idx, min(start) AS start, max(start + length(text)) AS stop, min(line_no) AS source_line FROM g WHERE trim(text) <> '' GROUP BY doc_id, island")
def _(t):
    return ln.paragraphs(script_lines(t))


@query("anc_occurrences", sql=f"WITH {HITS} SELECT * FROM hits")
def _(t):
    return ln.occurrences(t("documents"), " the ")


@query("anc_anchors", sql=f"WITH {PARAS}, {HITS} SELECT h.doc_id, h.start, h.stop, min(p.idx) AS paragraph, arg_min(p.source_line, p.idx) AS source_line, least(h.start, min(p.start)) AS context_start, greatest(h.stop, max(p.stop)) AS context_stop, count(p.idx) AS depth FROM hits h LEFT JOIN paras p ON h.doc_id = p.doc_id AND h.start < p.stop AND p.start < h.stop GROUP BY 1, 2, 3")
def _(t):
    return ln.anchors(ln.occurrences(t("documents"), " the "), ln.line_paragraphs(lines(t)))


@query("anc_snippets", sql=f"WITH {PARAS}, {HITS}, a AS (SELECT h.doc_id, h.start, h.stop, least(h.start, min(p.start)) AS lo, greatest(h.stop, max(p.stop)) AS hi FROM hits h LEFT JOIN paras p ON h.doc_id = p.doc_id AND h.start < p.stop AND p.start < h.stop GROUP BY 1, 2, 3) SELECT a.doc_id, a.start, substr(d.text, greatest(lo, start - 120) + 1, least(hi, stop + 120) - greatest(lo, start - 120)) AS snippet FROM a JOIN documents d ON a.doc_id = d.doc_id")
def _(t):
    docs = t("documents")
    a = ln.anchors(ln.occurrences(docs, " the "), ln.line_paragraphs(lines(t)))
    return a.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "start", ln.snippet(F.col("text"), F.col("start"), F.col("stop"), F.col("context_start"), F.col("context_stop")).alias("snippet"))


@query("anc_raw_line_lookup", sql=f"WITH {LINES} SELECT d.doc_id, l.text AS third_line FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id AND l.line_no = 2")
def _(t):
    return t("documents").select("doc_id").join(lines(t).where("line_no = 2").select("doc_id", F.col("text").alias("third_line")), "doc_id", "left")


# -- similarity -------------------------------------------------------------------------
@query("sim_normal_title", sql="SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", tx.normal_title(F.col("text")).alias("title"))


TOK = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query("sim_token_containment", "works", sql=f"SELECT work_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 6) AS containment FROM (SELECT work_id, {TOK('title')} AS a, {TOK('outlet || surname || substr(title, 10)')} AS b FROM works) x")
def _(t):
    w = t("works")
    other = F.concat("outlet", "surname", F.expr("substr(title, 10)"))
    return w.select("work_id", F.round(tx.containment(tx.tokens(F.col("title")), tx.tokens(other)), 6).alias("containment"))


@query("sim_doi_normalize", "works", sql="SELECT work_id, doi AS normalized FROM works")
def _(t):
    k, d = F.col("work_id") % 4, F.col("doi")
    spelt = F.when(k == 0, F.concat(F.lit(" https://doi.org/"), F.upper(d))).when(k == 1, F.concat(F.lit("http://dx.doi.org/"), d, F.lit(" "))).when(k == 2, F.concat(F.lit("doi: "), d)).otherwise(F.upper(d))
    return t("works").select("work_id", tx.normal_doi(spelt).alias("normalized"))


@query("sim_year_agreement", "works", sql="SELECT work_id, CASE WHEN work_id % 5 = 0 THEN 0.9::DOUBLE WHEN work_id % 5 = 1 THEN 1.0::DOUBLE WHEN work_id % 5 = 2 THEN 1.0::DOUBLE WHEN work_id % 5 = 3 THEN NULL ELSE 0.9::DOUBLE END AS agreement FROM works")
def _(t):
    k, y = F.col("work_id") % 5, F.col("year").cast("string")
    marker = F.when(k == 1, y).when(k == 2, F.concat(y, F.lit("a"))).when(k >= 3, (F.col("year") + 2).cast("string"))
    return t("works").select("work_id", tx.year_agreement(marker, F.array(y), k != 4).alias("agreement"))


@query("sim_year_key", "works", sql="SELECT work_id, CASE WHEN work_id % 3 = 2 THEN '2020a' ELSE 'n.d.' END AS key FROM works")
def _(t):
    k = F.col("work_id") % 3
    return t("works").select("work_id", tx.year_key(F.when(k == 0, "In Press").when(k == 1, "n. d.").otherwise(" 2020A")).alias("key"))


@query("ver_doi_in_text", "entries", sql="SELECT doc_id, n, lower(nullif(regexp_replace(regexp_extract(raw_text, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+'), '[.,;)]+$', ''), '')) AS doi FROM entries")
def _(t):
    return t("entries").select("doc_id", "n", tx.doi_in(F.col("raw_text")).alias("doi"))


@query("ver_package_url", "entries", sql="SELECT doc_id, n, CASE n % 4 WHEN 0 THEN 'https://cran.r-project.org/package=x' || n WHEN 1 THEN 'http://docs.pypi.org/p/' || n END AS url FROM entries")
def _(t):
    k, n = F.col("n") % 4, F.col("n").cast("string")
    raw = F.concat("raw_text", F.when(k == 0, F.concat(F.lit(" see https://cran.r-project.org/package=x"), n)).when(k == 1, F.concat(F.lit(" (http://docs.pypi.org/p/"), n, F.lit(")"))).when(k == 2, " https://github.com/pypi.org/x").otherwise(" https://notpypi.org/x"))
    return t("entries").select("doc_id", "n", tx.package_url(raw).alias("url"))


@query("src_doi_scan", sql="SELECT doc_id, lower(d) AS doi, row_number() OVER (PARTITION BY doc_id ORDER BY lower(d)) AS idx FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+')) AS d FROM documents) x")
def _(t):
    from pyspark.sql import Window

    found = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.DOI), F.lit(0))).alias("d")).select("doc_id", tx.normal_doi(F.col("d")).alias("doi")).distinct()
    return found.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("doi")).cast("bigint"))


@query("src_doi_scan_entries", "entries", sql="WITH d AS (SELECT DISTINCT doc_id, lower(regexp_extract(raw_text, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+')) AS doi FROM entries) SELECT doc_id, doi, row_number() OVER (PARTITION BY doc_id ORDER BY doi) AS idx FROM d WHERE doi <> ''")
def _(t):
    from pyspark.sql import Window

    found = t("entries").select("doc_id", F.explode(F.regexp_extract_all("raw_text", F.lit(tx.DOI), F.lit(0))).alias("d")).select("doc_id", tx.normal_doi(F.col("d")).alias("doi")).distinct()
    return found.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("doi")).cast("bigint"))


@query("det_number_groups", "refs", sql="SELECT doc_id, n, CASE n % 5 WHEN 0 THEN (n || ',' || (n + 1) || ',' || (n + 2)) WHEN 1 THEN '1,' || CASE WHEN n = 1 THEN '3' ELSE n || ',3' END WHEN 2 THEN '' WHEN 3 THEN '' ELSE CAST(n AS VARCHAR) END AS numbers FROM refs")
def _(t):
    n, k = F.col("n"), F.col("n") % 5
    s = n.cast("string")
    group = F.when(k == 0, F.concat(s, F.lit("–"), (n + 2).cast("string"))).when(k == 1, F.concat(F.lit("1, "), s, F.lit("; 3"))).when(k == 2, F.concat(s, F.lit("-1"))).when(k == 3, F.concat(F.lit("0, "), s)).otherwise(F.concat(s, F.lit(", "), s))
    return t("refs").select("doc_id", "n", F.array_join(F.transform(tx.bracketed_numbers(group), lambda x: x.cast("string")), ",").alias("numbers"))


@query("src_file_size_label", sql="SELECT doc_id, CASE WHEN k < 1024 THEN k || ' B' WHEN k < 1048576 THEN printf('%.1f KB', k / 1024.0) ELSE printf('%.1f MB', k / 1048576.0) END AS label FROM (SELECT doc_id, strlen(text) AS k FROM documents) x")
def _(t):
    return t("documents").select("doc_id", tx.size_label(F.octet_length("text")).alias("label"))


@query("src_docx_paragraphs", sql="SELECT doc_id, length(replace(text, chr(10), chr(10) || chr(10)))::INTEGER AS k, len(string_split(text, chr(10)))::INTEGER AS paragraphs FROM documents")
def _(t):
    parts = F.split("text", "\n")
    return t("documents").select("doc_id", F.length(F.array_join(parts, "\n\n")).alias("k"), F.size(parts).alias("paragraphs"))
