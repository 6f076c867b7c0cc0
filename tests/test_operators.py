"""Operators on small literal rows."""

import random
import time

import pytest
from pyspark.sql import Row, functions as F

from citemill.functions import names as nm
from citemill.functions import text as tx
from citemill.operators import aggregate as agg
from citemill.operators import audit as au
from citemill.operators import check as ck
from citemill.operators import detect as dt
from citemill.operators import lines as ln
from citemill.operators import matching as mt
from citemill.operators import normalize as no
from citemill.operators import reading as rd
from citemill.operators import split as sp
from citemill.operators import tiers as ti
from citemill.operators import verify as vf
from citemill.sources import files, tei
from citemill.streaming import reviews


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# -- detection ---------------------------------------------------------------------
@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("(Quill, 2011; Brack, n.d.)", [("Quill", "2011", None), ("Brack", "n.d.", None)]),
        ("It holds [1, 3-5].", [(None, None, n) for n in (1, 3, 4, 5)]),
        ("(p < .01)", []),
        ("95% CI [2, 5]", []),
        ("so [9-3] it is", []),
        ("see Table [3]", []),
        ("x[3] is", []),
        ("(May 2010)", []),
        ("Brack and Moe (2010, 2012a) say", [("Brack and Moe", "2010", None), ("Brack and Moe", "2012a", None)]),
        ("so (see Quill & Brack, 2011, p. 5)", [("Quill & Brack", "2011", None)]),
        ("of van der Berg et al. (1999) we", [("van der Berg et al.", "1999", None)]),
        ("the range (2001-2005) of", []),
        ("", []),
        # what stands before decides
        ("as Eq. [3] shows", []),
        ("a scale\n from [1, 7] was", []),
        ("ranging over quite a lot of all the [2, 5]", [(None, None, 2), (None, None, 5)]),
        ("differences between [3] and [4]", [(None, None, 3), (None, None, 4)]),
        ("A note ends.\n[2] Quill argues", []),
        ("as shown in\n[2], the tide", [(None, None, 2)]),
        ("[2]Quill", [(None, None, 2)]),
        ("m²[4] is", []),
        ("Der Beitrag von Quill (2020) ist", [("von Quill", "2020", None)]),
        ("ranging over [2, 5]", []),
        ("Diese sehr alte Welle (2020) ist", []),
        ("Recent Work Quill (2020) is", [("Quill", "2020", None)]),
        ("However, Quill (2020) is", [("Quill", "2020", None)]),
        ("J. P. Quill, Brack, & Moe u. a. (2019, 2020b) sind", [("J. P. Quill, Brack, & Moe u. a.", "2019", None), ("J. P. Quill, Brack, & Moe u. a.", "2020b", None)]),
        ("Quill (1939-1945) was", []),
        ("Quill (2001, 2005-2009) was", [("Quill", "2001", None)]),
        # what stands inside decides
        ("(Quill, 2020, pp. 1990-1995)", [("Quill", "2020", None)]),
        ("(S. Quill, 2020; vgl. auch Moe, o. J.)", [("S. Quill", "2020", None), ("Moe", "o. J.", None)]),
        ("(Oktober 2021; Figure 2020; 2020)", []),
        ("(M = 3, Quill, 2020)", []),
        ("[12, p. 5] and [1; 2–3]", [(None, None, 12), (None, None, 1), (None, None, 2), (None, None, 3)]),
        ("[0, 3] [3-50] [1,,2] [2020]", []),
        ("(t(28), Quill, 2020)", []),
    ],
)
def test_detection(text, found):
    assert [(m[4], m[5], m[6]) for m in dt.detect(text)] == found


def test_round_numbers_only_if_numbered_is_the_sole_family():
    text = "The whole of this result was shown before (3) and is known."
    assert [m[6] for m in dt.detect(text, "numbered")] == [3]
    assert dt.detect(text) == []


def test_detection_time_grows_with_the_text():
    text = "Some prose by Quill (2011) and more words here (Brack, 2010; Moe, 2012) shows [1, 2]. " * 1_300
    began = time.time()
    assert len(text) > 100_000 and len(dt.detect(text)) == 6_500
    assert time.time() - began < 10


def test_known_markers_are_parsed_without_context():
    assert [m[6] for m in dt.parse_marker("[2, 4]")] == [2, 4]
    assert [(m[4], m[5], m[7]) for m in dt.parse_marker("Quill (2011)")] == [("Quill", "2011", True)]
    assert [(m[4], m[5]) for m in dt.parse_marker("Quill, 2011")] == [("Quill", "2011")]
    assert [m[6] for m in dt.parse_marker(" [12, p. 5] ")] == [12] and [m[6] for m in dt.parse_marker("3")] == [3]
    assert dt.parse_marker("May (2010)") == dt.parse_marker("[9-3]") == dt.parse_marker("so Quill (2011)") == dt.parse_marker(" ") == []
    assert [(m[4], m[5]) for m in dt.parse_marker("(see Quill & Moe, 2011a; Zed, n.d.)")] == [("Quill & Moe", "2011a"), ("Zed", "n.d.")]


def test_round_numbers_at_the_end_of_a_line():
    numbers = lambda t: [m[6] for m in dt.detect(t, "numbered")]
    assert numbers("the effect was shown many years ago (3)\nand it") == [3]
    assert numbers("y = a x + b + c + d (3)\n") == numbers("(3)\n") == numbers("there are three: (1) a") == []
    assert numbers("the effect was shown (3).") == [3]


def test_families_follow_the_list(spark):
    lists = [("[1] a\n[2] b", "numbered"), ("1. a\n2) b", "numbered"), ("A, B. (2001). x\nC, D. (2002). y", "author-date"), ("Quill, A., 2001. X.\nMoe, B., 2002a. Y.", "author-date"), ("Quill AB. X\nvan Moe C. Y", "author-date"), ("[1] A (2001).\n[2] B (2002).\n[3] C", "author-date,numbered"), ("[1] a\nA (2001).", "author-date,numbered"), ("", "author-date,numbered"), (None, "author-date,numbered")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lists)], "doc_id long, text string")
    assert [r.families for r in ln.expected_families(ln.style_profile(df)).orderBy("doc_id").collect()] == [f for _, f in lists]
    one = ln.style_profile(spark.createDataFrame([(1, 'Moe, L., "Of tides," J 12, 1999;3.\n\nQuill, A., 2001. X (2. Aufl.). Abgerufen am 1. Mai von z. (2003)')], "doc_id long, text string")).first()
    assert (one.lines, one.quoted_titles, one.comma_years, one.paren_years, one.bare_years, one.german_signs, one.bare_year_density) == (2, 1, 1, 1, 1, 2, 0.5)


# -- splitting -----------------------------------------------------------------------
def test_split_gates():
    assert sp.split_block("References\n[1] Quill, T. Tides one. 2011.\n[2] Brack U. Undated\nmore.\n[3] Zed, Q. Third 2010.") == ["Quill, T. Tides one. 2011.", "Brack U. Undated\nmore.", "Zed, Q. Third 2010."]
    assert sp.split_block("1. Aa bb cc 2001. 2. Dd ee ff. 2002. 3. Gg hh ii 2003.") == ["Aa bb cc 2001.", "Dd ee ff. 2002.", "Gg hh ii 2003."]
    assert sp.split_block("Quill, T. (2011). Sorting. Shore. Brack, U. (n.d.). Undated. Moe, L. (1999). Third.") == ["Quill, T. (2011). Sorting. Shore.", "Brack, U. (n.d.). Undated.", "Moe, L. (1999). Third."]
    assert sp.split_block("Quill, T. (2011). One\nmore line.\nBrack, U. (2012). Two.") == ["Quill, T. (2011). One\nmore line.", "Brack, U. (2012). Two."]
    assert sp.split_block("First block\nhere 2001.\n\nSecond block 2002.") == ["First block here 2001.", "Second block 2002."]
    assert sp.split_block("just one text") == ["just one text"]
    assert sp.split_block(" \n ") == []
    # a stray number is passed over, a run that doesn't start at 1 must have words
    assert sp.split_block("1. Aa bb\n246.\n2. Cc dd") == ["Aa bb\n246.", "Cc dd"]
    assert sp.split_block("7. Aa bbb\n8. Cc ddd\n9. Ee fff") == ["Aa bbb", "Cc ddd", "Ee fff"]
    assert sp.split_block("246.\n247.") == ["246.\n247."]
    # a wrapped author list opens no entry, and what precedes the first start is lost
    assert sp.split_block("Lead.\nQuill, T., Moe, L., and\nBrack, U. (2011). One.\nZed, Q. (2012). Two.") == ["Quill, T., Moe, L., and\nBrack, U. (2011). One.", "Zed, Q. (2012). Two."]
    # editors and places open none inside a line
    assert len(sp.split_block("Quill, T. (2011). A. In Moe, L., & Zed, Q. (Eds.), B. Hillsdale, N.J.: C. Brack, U. (2012). D.")) == 2
    # three years in one entry license numbers, two in parentheses authors
    assert sp.flattened(["A (2001). B (2002)."]) == {"paren_years"} and sp.flattened(["A 2001. B 2002. C (2003)."]) == {"bare_years"}
    assert sp.flattened(["1. Aa. 2. Bb. 3. Cc."]) == {"inline_number_run"}


def test_printed_reading():
    assert ck.printed_reading("[1] Aa bb\n[3] stray\n[2] Cc") == [(1, " Aa bb\n[3] stray\n"), (2, " Cc")]
    assert [n for n, _ in ck.printed_reading("1. Aa bb")] == [None] and ck.printed_reading("") == []


def test_titles_are_never_guessed():
    assert sp.title_of("Quill, T. (2011). Sorting tides. Shore Letters, 4(2), 9-17.") == "Sorting tides"
    assert sp.title_of("Doll R, Hill AB. Smoking and more. BMJ. 1950.") == "Smoking and more"
    assert sp.title_of('Moe, L., "A quoted title here," J., 1999.') == "A quoted title here"
    assert sp.title_of("Author, A., 2020. Title here. J 1.") == "Title here"
    assert sp.title_of("nothing to see") is None
    assert sp.title_of("Quill, T. (2011). Sorting tides.") == "Sorting tides."
    assert sp.title_of('Quill, T. (2011). Tides, "a quoted part" of them. J.') == 'Tides, "a quoted part" of them'
    assert sp.title_of("Doll R, van Hill AB, et al. Smoking. BMJ.") == "Smoking"
    assert sp.title_of("Quill AB., 2020. Of tides. J.") == "Of tides" and sp.title_of("A title first. It goes on here, 2020. So. J.") is None


# -- names ------------------------------------------------------------------------------
def test_names():
    assert nm.fold("Müller-Löwe") == "muller lowe"
    assert nm.name_similarity("de Beauvoir", "Beauvoir") == 1.0
    assert nm.name_similarity("Smith", "Jones") < 0.9
    assert nm.surnames("Quill, T., Brack, U. B., & van der Berg, C.") == ["Quill", "Brack", "van der Berg"]
    assert nm.entry_years("x", "Quill, T. (n.d.).") == (["n.d."], True)
    assert nm.entry_years("Q 11, 1990-1995, 2003", "no year") == (["1990", "1995", "2003"], False)
    keys = nm.inherited([nm.reference_key("Moe, L. 1999. A first title."), nm.reference_key("———. 2001. A second title.")])
    assert keys[1]["surname"] == "Moe"
    assert nm.title_similarity("Sorting tides", "Sorting tides, again") == 1.0
    assert nm.marker_surnames("J. van der Berg, Quill und Moe u. a.") == ["van der Berg", "Quill", "Moe"] and nm.marker_surnames(None) == []
    assert nm.surnames("WU, Q., & Ng K") == ["WU", "Ng"] and nm.strip_initials("a title of many words") == ""
    assert nm.regions("[1] Quill, T. 1999 A. (2011). X") == ("[1] Quill, T. 1999 A. (2011", "[1] Quill, T. 1999 A. ")
    assert nm.entry_years("Q (1990-1995) 2003", "Q (1990-1995) 2003") == (["2003"], True)
    assert nm.opens_with_rule("[3] ———. 2001") and nm.opens_with_rule(". 2001") and not nm.opens_with_rule('"Title" 2001')


def test_text_expressions(spark):
    assert one(spark, F.array_join(F.transform(tx.bracketed_numbers(F.lit("1, 3–5; 1")), lambda x: x.cast("string")), ",")) == "1,3,4,5"
    for bad in ("5-3", "0", "1-99", "a", ""):
        assert one(spark, F.size(tx.bracketed_numbers(F.lit(bad)))) == 0
    assert one(spark, tx.normal_doi(F.lit(" https://DX.doi.org/10.1000/AbC "))) == "10.1000/abc"
    assert one(spark, tx.doi_in(F.lit("see 10.1000/AbC.). More"))) == "10.1000/abc"
    assert one(spark, tx.doi_in(F.lit("none"))) is None
    assert one(spark, tx.package_url(F.lit("at https://github.com/a and https://docs.pypi.org/x"))) == "https://docs.pypi.org/x"
    assert one(spark, tx.package_url(F.lit("at https://evilpypi.org/x"))) is None
    agree = lambda y, ys, d: one(spark, tx.year_agreement(F.lit(y).cast("string"), F.array(*map(F.lit, ys)) if ys else F.array().cast("array<string>"), F.lit(d)))
    assert (agree("2020a", ["2020"], True), agree("2020a", ["2020b"], True), agree(None, ["2020"], True), agree("2021", ["2020"], False), agree("2021", [], True)) == (1.0, None, 0.9, 0.9, 0.9)


# -- matching --------------------------------------------------------------------------
def test_the_four_outcomes(spark):
    markers = spark.createDataFrame([(1, 1, "Quill", "2011"), (1, 2, "Nobody", "2011"), (1, 3, None, "2011"), (1, 4, "Brack", "2000"), (2, 1, "Quill", "2011")], "doc_id long, seq long, surname string, year string")
    keys = spark.createDataFrame([(1, 1, "Quill", ["2011"], True), (1, 2, "Brack", ["2000"], True), (1, 3, "Brack", ["2000"], True)], "doc_id long, n long, surname string, years array<string>, dated boolean")
    got = {(r.doc_id, r.seq): (r.status, r.reference_n, r.candidates) for r in mt.resolve_author_date(markers, keys, nm.name_similarity_udf).collect()}
    assert got == {(1, 1): ("resolved", 1, []), (1, 2): ("orphaned", None, []), (1, 3): ("unresolved", None, []), (1, 4): ("ambiguous", None, [2, 3]), (2, 1): ("unresolved", None, [])}


def test_other_names_break_ties(spark):
    markers = spark.createDataFrame([(1, 1, "Quill", "2011", ["Brack"]), (1, 2, "Quill", "2011", ["Zed"]), (1, 3, "Quill", "2011", [])], "doc_id long, seq long, surname string, year string, others array<string>")
    keys = spark.createDataFrame([(1, 1, "Quill", ["2011"], True, ["Quill", "Moe"]), (1, 2, "Quill", ["2011"], True, ["Quill", "Brack"])], "doc_id long, n long, surname string, years array<string>, dated boolean, surnames array<string>")
    got = {r.seq: (r.status, r.reference_n, r.candidates) for r in mt.resolve_author_date(markers, keys, nm.name_similarity_udf, corroborating=nm.corroboration_udf).collect()}
    assert got == {1: ("resolved", 2, []), 2: ("ambiguous", None, [1, 2]), 3: ("ambiguous", None, [1, 2])}


def test_numbers_are_all_or_nothing(spark):
    e = spark.createDataFrame([(1, 1, "[1] a"), (1, 2, "[2] b"), (2, 1, "[1] a"), (2, 2, "b"), (3, 1, "[1] a"), (3, 2, "[3] b")], "doc_id long, n long, raw_text string")
    m = spark.createDataFrame([(d, 1, 5) for d in (1, 2, 3, 4)], "doc_id long, seq long, number long")
    got = {r.doc_id: (r.status) for r in mt.resolve_numbered(m, e).collect()}
    assert got == {1: "orphaned", 2: "unresolved", 3: "unresolved", 4: "unresolved"}


def test_audit(spark):
    text = "quill sorting tides shore letters volume"
    printed = spark.createDataFrame([(1, 1, text), (1, 2, "brack undated things harbour press"), (1, 3, "moe third thing lost altogether")], "doc_id long, pos long, text string")
    extracted = spark.createDataFrame([(1, 1, text + " brack undated things harbour press"), (1, 2, "something else entirely not printed")], "doc_id long, n long, text string")
    r = au.audit(printed, extracted).first()
    assert (r.merged, r.unmatched, r.missing, r.complete) == ("1", "2", "3", False)
    assert au.greedy_match(["Sorting tides", "Sorting tides"], ["Sorting tides"]) == [(0, 0)]
    assert au.ensemble_titles([("d", None), ("d", "Sorting tides"), (None, "sorting  Tides"), (None, None), (None, "Other work")]) == [1, 4]
    assert au.located("x [1] y [2] [1]", ["[1]", "[2]", "[9]", "[1]"]) == [(2, 5), (8, 11), None, (12, 15)]


# -- lines ---------------------------------------------------------------------------------
def test_normalization_chain():
    lines = no.normalize("# Title\n\nQuill, T. (2011). A very -\n\n12\n\nlong title. J.\n\n\n**bold** x.\n\n\n\nLast.")
    assert [x.text for x in lines] == ["Title", "", "Quill, T. (2011). A very - long title. J.", "", "bold x.", "", "Last."]
    merged = lines[2]
    assert no.origin_at(merged, 0) == 2 and no.origin_at(merged, merged.text.index("long")) == 6
    assert no.normalize("") == []
    assert [x.text for x in no.normalize("- [1] Quill, T. A long-\n\n- term view (2011).\n\n- Moe, L. 34(2), 1-22\n\n- *\n\nHead 3\n\n[4] ISO 1.\n\nHead 12\n\n[4] ISO 1.\n\n**bold**\n\n-5 is")] == ["[1] Quill, T. A long-", "", "term view (2011).", "", "Moe, L. 34(2), 1-22", "", "[4] ISO 1.", "", "[4] ISO 1.", "", "bold -5 is"]
    assert [x.text for x in no.normalize("- [1] Quill, T. A long-\n\n- term view")] == ["[1] Quill, T. A long- term view"]
    a, b = no.sentence_bounds("One is here. As Smith et al. say, it is so. Last one.", 20, 25)
    assert "One is here. As Smith et al. say, it is so. Last one."[a:b].strip() == "As Smith et al. say, it is so."


def test_anchors(spark):
    docs = spark.createDataFrame([(1, "ab 🙂 cd\n\nef ab"), (2, ""), (3, None)], "doc_id long, text string")
    paras = ln.paragraphs(ln.lines_of(docs))
    assert [(r.idx, r.start, r.stop) for r in paras.where("doc_id = 1").orderBy("idx").collect()] == [(0, 0, 7), (1, 9, 14)]
    found = ln.occurrences(docs, "ab").orderBy("start").collect()
    assert [(r.start, r.stop) for r in found] == [(0, 2), (12, 14)]


def test_bibliography_without_heading_has_no_bounds(spark):
    docs = spark.createDataFrame([(1, "a\nReferences:\nx.\nAppendix A. More\ny"), (2, "a\nb")], "doc_id long, text string")
    assert [tuple(r) for r in ln.bibliography_bounds(ln.lines_of(docs)).collect()] == [(1, 2, 3)]
    assert ln.body(ln.lines_of(docs)).where("doc_id = 1").count() == 3
    stops = {"Appendix B": True, "Appendix: Tables and more": True, "Appendix to the hearings, volume 2": False, "Received signal strength": False, "Manuscript received 3 May 2020.": True, "Received: 2019. Later": False, "Danksagung:": True, "Appendices A1 Of things.": True}
    rows = spark.createDataFrame([(i, f"References\nA.\n{t}") for i, t in enumerate(stops)], "doc_id long, text string")
    assert [r["last"] == 2 for r in ln.bibliography_bounds(ln.lines_of(rows)).orderBy("doc_id").collect()] == list(stops.values())


# -- verification ---------------------------------------------------------------------------
def test_unknown_is_not_false(spark):
    rows = spark.createDataFrame([(1, 1, 1, "10.1/A", None, 2000, "o", 5, None, 0.9), (1, 1, 2, "10.1/a", "T", None, None, 9, True, 0.8), (1, 1, 3, None, "U", None, None, None, None, 0.7)], "doc_id long, n long, pos long, doi string, title string, year long, outlet string, citations long, retracted boolean, score double")
    got = {r.key: r for r in vf.merge_by_doi(rows).collect()}
    assert (got["10.1/a"].title, got["10.1/a"].year, got["10.1/a"].citations, got["10.1/a"].retracted) == ("T", 2000, 9, True)
    assert got["#3"].retracted is None and got["#3"].citations is None


def test_metrics_count_true_only(spark):
    rows = spark.createDataFrame([(1, "verified", None), (1, "verified", True), (1, "unchecked", False)], "doc_id long, status string, retracted boolean")
    r = agg.metrics(rows).first()
    assert (r.retracted, r.review, r.unchecked) == (1, 1, 1)
    assert one(spark, agg.percent_note(F.lit(1), F.lit(8))) == "12%"
    assert one(spark, agg.list_note(F.array(*map(F.lit, range(1, 9))))) == "1, 2, 3, 4, 5, 6 and 2 more"


# -- sources and sinks ------------------------------------------------------------------------
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><p>As shown <ref type="bibr" target="#b0">(Quill,
 2011)</ref> and <ref type="bibr">[2]</ref>.</p></div></body><back><listBibl><biblStruct><analytic><title>no id</title></analytic></biblStruct>
<biblStruct xml:id="b0"><analytic><title level="a">Sorting tides</title><author><persName><surname>Quill</surname></persName></author></analytic><monogr><title level="j">Shore</title><imprint><date type="published" when="2011-03"/></imprint></monogr><idno type="DOI">10.1/ABC</idno><note type="raw_reference">Quill  2011.</note></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    df = spark.createDataFrame([(1, TEI), (2, "<broken"), (3, None)], "doc_id long, tei string")
    refs = tei.read_references(df)
    assert [tuple(r) for r in refs.collect()] == [(1, 1, "b0", "Sorting tides", "2011", "10.1/abc", ["Quill"], "Quill 2011.")]
    got = tei.linked(tei.read_contexts(df), refs).orderBy("seq").collect()
    assert [(r.marker_text, r.target, r.reference_n, r.paragraph_text[r.start : r.stop]) for r in got] == [("(Quill, 2011)", "b0", 1, "(Quill, 2011)"), ("[2]", None, None, "[2]")]


def test_passages_hold_nested_markers():
    import xml.etree.ElementTree as ET

    ref = lambda t, target="": f'<ref type="bibr"{target}>{t}</ref>'
    text = f"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><div>{ref("[1]")} opens <p>Held  in
  <hi>marks {ref(" [2] ", ' target="#b1"')}</hi>, and {ref(" ")}on. </p></div><figure><figDesc>See {ref("[3]")}</figDesc></figure>
  <p>none</p><listBibl><p>{ref("[4]")}</p></listBibl></text></TEI>"""
    got = [(c["marker_text"], c["target"], c["paragraph_text"], c["start"]) for c in tei.contexts(ET.fromstring(text))]
    assert got == [("[1]", None, "[1] opens Held in marks [2] , and on.", 0), ("[2]", "b1", "[1] opens Held in marks [2] , and on.", 24), ("[3]", None, "See [3]", 4)]


def test_report_escapes(spark, tmp_path):
    df = spark.createDataFrame([("<script>", None)], "a string, b string")
    page = files.report("x & y", {"t<": df, "left out": df}, {"left out": False})
    assert "<script>" not in page and "x &amp; y" in page and "left out" not in page and "—" in page
    parsed = files.adapt_parsed(spark.createDataFrame([(1, '{"title":["T"],"author":[{"family":"Q"},{"given":"x"}]}'), (2, "{}")], "doc_id long, json string")).orderBy("doc_id").collect()
    assert parsed[0].title == "T" and parsed[0].surnames == ["Q"] and parsed[1].title is None
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path)).first().text == "one\ntwo"


def test_corpora_paths_and_records(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "apa.json").write_text('{"style": "apa", "cases": [{"id": "one", "text": "a"},\n {"id": "two", "text": "b"}]}')
    assert sorted((r.style, r.id, r.text) for r in files.read_corpus(spark, str(tmp_path / "c")).collect()) == [("apa", "one", "a"), ("apa", "two", "b")]
    files.write_bibtex(spark.createDataFrame([("k", "@article{k,\n}")], "key string, record string"), str(tmp_path / "b"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "b")).collect()) == ["@article{k,", "}"]
    assert ti.report_path_error(str(tmp_path / "r.HTML")) is None
    assert [ti.report_path_error(x) for x in ("r.html", str(tmp_path / "r.txt"), "/no/such/r.html")] == ["not absolute", "not an HTML file", "no such folder"]
    assert [ti.engine(p, r) for p, r in (("auto", True), ("auto", False), ("text", True))] == ["tier1", "tier0", "tier0"]


def test_a_parse_without_references_gives_no_citations(spark):
    contexts = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, seq long")
    assert [r.doc_id for r in ti.contexts_in_use(contexts, spark.createDataFrame([(2, 1), (2, 2)], "doc_id long, n long")).collect()] == [2]


def test_a_whole_check(spark):
    list_ = "Quill, T. (2011). Sorting tides. Shore Letters. doi:10.1/tides\n\nBrack, U. (2012). Undated things. Harbour Press, 12.\n\nZed, Q. (2013). Nothing at all. Nowhere."
    docs = spark.createDataFrame([(1, f"# On tides\n\nAs Quill (2011) says, it holds (Brack, 2012; Moe, 1999).\n\n## References\n\n{list_}\n\nAcknowledgements\n\nThanks (Quill, 2011)."), (2, "No list (Quill, 2011)."), (3, None)], "doc_id long, text string")
    works = spark.createDataFrame([("10.1/TIDES", "Sorting tides", "Shore", 3, False, 2011), ("10.2/u", "Undated things", "Harbour", None, None, 2012)], "doi string, title string, outlet string, citations long, retracted boolean, year long")
    got = {r.doc_id: r for r in ck.full_check(docs, works).collect()}
    one = got[1]
    assert (one.references, one.verified, one.halluc, one.resolved, one.orphaned, one.found) == (3, 2, 1, 3, 1, "bibliography")
    assert [(got[i].references, got[i].found) for i in (2, 3)] == [(0, "no bibliography")] * 2
    x = ck.extract(docs)
    assert [(r.seq, r.status, r.reference_n) for r in ck.match_citations(x).orderBy("seq").collect() if r.doc_id == 1] == [(1, "resolved", 1), (2, "resolved", 2), (3, "orphaned", None), (4, "resolved", 1)]


def counted(spark, docs):
    """The documents, and an accumulator of how many were read of them."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return docs.mapInArrow(run, docs.schema), seen


MANUSCRIPTS = [(1, "It holds [1]. And [2].\n\nReferences\n\n[1] Quill T. Sorting tides. Shore. 2011;3:1.\n[2] Brack U. Undated things. Shore. 2012;3:2."), (2, "As (Moe, 2010).\n\nReferences"), (3, None), (4, "References\nMoe, A. (2010). Tides. Shore.\nAppendix\nMore (Moe, 2010).")]


def test_manuscripts_are_read_once(spark):
    docs, seen = counted(spark, spark.createDataFrame(MANUSCRIPTS, "doc_id long, text string"))
    x = ck.extract(docs)
    assert [(r.doc_id, r.n) for r in x.entries.orderBy("doc_id", "n").collect()] == [(1, 1), (1, 2), (4, 1)]
    assert [(r.doc_id, r.families) for r in x.families.orderBy("doc_id").collect()] == [(1, "numbered"), (4, "author-date,numbered")]
    assert [(r.doc_id, r.pos, r.number, r.owner) for r in x.owners.orderBy("doc_id", "pos").collect()] == [(1, 1, 1, 1), (1, 2, 2, 2), (4, 1, None, 1)]
    assert seen.value == len(MANUSCRIPTS)


def test_matching_reads_manuscripts_once(spark):
    docs, seen = counted(spark, spark.createDataFrame(MANUSCRIPTS, "doc_id long, text string"))
    got = ck.match_citations(ck.extract(docs)).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.seq, r.status, r.reference_n) for r in got] == [(1, 1, "resolved", 1), (1, 2, "resolved", 2), (4, 1, "resolved", 1)]
    assert seen.value == len(MANUSCRIPTS)


def test_matching_shuffles_nothing(spark):
    docs = spark.createDataFrame(MANUSCRIPTS, "doc_id long, text string")
    x = ck.extract(docs)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (ck.match_citations(x), x.owners, x.families)]
    assert not [p for p in plans if "Exchange" in p]


def test_a_whole_check_reads_manuscripts_once(spark):
    docs, seen = counted(spark, spark.createDataFrame(MANUSCRIPTS, "doc_id long, text string"))
    works = spark.createDataFrame([("10.1/t", "Sorting tides", "Shore", 3, False, 2011)], "doi string, title string, outlet string, citations long, retracted boolean, year long")
    got = {r.doc_id: (r.references, r.verified, r.resolved, r.found) for r in ck.full_check(docs, works).collect()}
    assert got == {1: (2, 1, 2, "bibliography"), 2: (0, 0, 0, "no bibliography"), 3: (0, 0, 0, "no bibliography"), 4: (1, 1, 1, "bibliography")}
    assert seen.value == len(MANUSCRIPTS)


ENDS = ["Appendix", " Danksagung :", "Appendix A. More", "Appendix A. More. And more", "appendix Aé", "Appendix A\u200c x", "appendices: all tests", ": Appendix. ok", "Appendix ABCDE x", "Appendix B1: Tables", "Author note:", "Manuscript received 3 May 2010", "manuscript\u2003Received: 4. 5. 2011.", "receivedé 2010", "Received May 2012 and so much more than that", "Received " + "May " * 20 + "2012", "Appendix " + "long " * 14, "References"]


def test_rows_of_documents_are_parted_as_lines_are(spark):
    texts = [f"Body.\n{head}\n{above}\n{end}\nAfter." for head in ("References", "LITERATUR ::", "\u2003Works cited:", "None") for above in ("Quill, T. (2011). Tides", "Tides. doi:10.1/x", "Tides.”)\u2003", "", " \n") for end in ENDS]
    texts += ["References", "References\n", "\n\nReferences\n\n", "a\nReferences\nb\nreferences\nAppendix\nReferences\nc"]
    lines = ln.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "line_no", "text").collect()
    expected = {r.doc_id: (r.bibliography, r.body) for r in ln.parted(spark.createDataFrame(lines, "doc_id long, line_no int, text string")).collect()}
    by = {k: [r.text for r in sorted(lines, key=lambda r: r.line_no) if r.doc_id == k] for k in range(len(texts))}
    assert {k: rd.parts(by[k]) for k in expected} == expected
    assert len(expected) == len(texts) and len({b for b, _ in expected.values()}) > 20


LISTS = ["", "x", "[1] A\n[2] B", "1. A\n2) B", "[1] A\n2. B", " [1]\n\t[2]", "[1]a\n[2]b", "Moe AB. X\nvan Quill C, Y", "and Moe AB\n& Moe A", "de la Moe ABCDE\nX_'-y ABCD", "(2011)\n(2012a)", "1(2011) (2012ab)", "Moe, 2011. A\nB., 2012a. C", "Quill, T. (2011). [1]\nMoe, A. (2012). [2]", "[1] Moe (2011)\n[2] Moe (2012)", "éa Moe AB\nÉa AB", "٣. A\n[٣] B"]


def test_rows_of_documents_support_the_families_of_profiles(spark):
    bibs = spark.createDataFrame(list(enumerate(LISTS)), "doc_id long, text string")
    expected = {r.doc_id: r.families for r in ln.expected_families(ln.style_profile(bibs)).collect()}
    assert {i: f for i, t in enumerate(LISTS) if (f := rd.families(t)) is not None} == {i: f for i, f in expected.items() if LISTS[i].isascii()}
    docs = spark.createDataFrame([(i, f"Body [1].\nReferences\nz\n{t}") for i, t in enumerate(LISTS)], "doc_id long, text string")
    x = ck.extract(docs)
    assert sorted(map(tuple, x.families.collect())) == sorted(map(tuple, ln.expected_families(ln.style_profile(x.bibliographies)).collect()))
    assert len(set(expected.values())) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_documents_match_as_tables_do(spark, seed):
    rnd = random.Random(seed)
    words, surnames = "tide tides shore ab cd notes 2011 w7 harbour boats".split(), ["Quill", "Quil", "Moe", "moe", "Müller", "Muller", "van Berg", "X", None]
    entries = [(d, n, " ".join(rnd.choices(words, k=rnd.randrange(9)))) for d in range(40) for n in range(1, rnd.randrange(1, 8))]
    printed = [(d, n, (t if rnd.random() < 0.6 else t.replace(" ", "", 2)) + rnd.choice(["", " more"])) for d, n, t in entries if rnd.random() < 0.9] + [(99, 1, "tide")]
    of = lambda rows, d: [r for r in rows if r[0] == d]
    own = {(r.doc_id, r.pos): r.owner for r in au.owners(spark.createDataFrame(printed, "doc_id long, pos long, text string"), spark.createDataFrame(entries, "doc_id long, n long, text string")).collect()}
    got = {}
    for d in {p[0] for p in printed}:
        got |= zip([(d, p[1]) for p in of(printed, d)], rd.owners([p[2] for p in of(printed, d)], [e[1:] for e in of(entries, d)]))
    assert got == own and None in own.values() and any(own.values())
    years = [["2010"], ["2011a"], ["2010", "2012"], [], ["n.d."]]
    keys = [(d, n, s, [s] + rnd.sample(surnames[:4], 2) if s else [], rnd.choice(years), rnd.random() < 0.8) for d in range(30) for n in range(1, rnd.randrange(1, 7)) for s in [rnd.choice(surnames)]]
    asked = [(d, q, s, rnd.sample(surnames[:4], rnd.randrange(3)) if s else [], rnd.choice(["2010", "2011", "2011a", "2011b", "2013", "n.d.", None])) for d in range(31) for q in range(1, 9) for s in [rnd.choice(surnames)]]
    table = mt.resolve_author_date(spark.createDataFrame(asked, "doc_id long, seq long, surname string, others array<string>, year string"), spark.createDataFrame(keys, "doc_id long, n long, surname string, surnames array<string>, years array<string>, dated boolean"), nm.name_similarity_udf, corroborating=nm.corroboration_udf)
    expected = {(r.doc_id, r.seq): (r.status, r.reference_n, r.candidates, r.confidence) for r in table.collect()}
    lists = {d: rd.Keys([(k[1], dict(zip(("surname", "surnames", "years", "dated"), k[2:]))) for k in of(keys, d)]) for d in range(31)}
    assert {(d, q): lists[d].resolve(s, tuple(o), y) for d, q, s, o, y in asked} == expected
    assert {s for s, *_ in expected.values()} == {"resolved", "ambiguous", "orphaned", "unresolved"}
    texts = [(d, n, rnd.choice(["[1] a", f"[{n}] a", f" {n}. b", f"{n})", f"{n}.c", "", None])) for d in range(40) for n in (2, 3, 5)[: rnd.randrange(1, 4)]] + [(77, n, f"[{3 - n}] x") for n in (1, 2)]
    expected = {tuple(r) for r in mt.number_index(spark.createDataFrame(texts, "doc_id long, n long, raw_text string")).collect()}
    assert {(d, *r) for d in {t[0] for t in texts} for r in rd.number_index([t[1:] for t in of(texts, d)])} == expected


def test_entries_are_looked_up_in_one_reading(spark):
    rows = [(1, 1, "Quill T. Sorting tides. Shore. 2011. doi:10.1234/tides", None, None), (1, 2, "Brack, U. (2012). Undated things. Harbour.", None, None), (1, 3, "rebuilt", "Other", "10.1234/tides"), (2, 1, None, None, None)]
    entries, seen = counted(spark, spark.createDataFrame(rows, "doc_id long, n long, raw_text string, title string, doi string"))
    works = spark.createDataFrame([("10.1234/TIDES", "Sorting tides", "Shore", 3, False, 2011), ("10.2/u", "Undated things", "Harbour", None, None, 2012)], "doi string, title string, outlet string, citations long, retracted boolean, year long")
    got = ck.looked_up(entries, works).orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.n, r.status, r.raw) for r in got] == [(1, 1, "verified", rows[0][2]), (1, 2, "verified", rows[1][2]), (1, 3, "review", "rebuilt"), (2, 1, "halluc", None)]
    assert seen.value == len(rows)


def test_every_entry_of_a_long_list_is_looked_up(spark):
    titles = [f"Tides of shore w{i}" for i in range(1, 1_203)]
    entries = spark.createDataFrame([(1, n, f"Quill T. {t}. Shore. 2011.", None, None) for n, t in enumerate(titles, start=1)], "doc_id long, n long, raw_text string, title string, doi string")
    works = spark.createDataFrame([(f"10.1/{n}", t, "Shore", None, None, 2011) for n, t in enumerate(titles, start=1)], "doi string, title string, outlet string, citations long, retracted boolean, year long")
    got = ck.looked_up(entries, works).orderBy("n").collect()
    assert [(r.n, r.status, r.doi) for r in got] == [(n, "verified", f"10.1/{n}") for n in range(1, len(titles) + 1)]


def test_parts_are_bibliography_and_body(spark):
    rows = ln.lines_of(spark.createDataFrame(MANUSCRIPTS, "doc_id long, text string")).select("doc_id", "line_no", "text")
    parts = ln.parted(rows)
    assert sorted(map(tuple, parts.where("bibliography is not null").select("doc_id", "bibliography").collect())) == sorted((r.doc_id, r.text) for r in ln.bibliography(rows).collect())
    held = ln.body(rows).orderBy("doc_id", "line_no").collect()
    assert {r.doc_id: r.body for r in parts.where("body is not null").collect()} == {d: "\n".join(r.text for r in held if r.doc_id == d) for d in {r.doc_id for r in held}}


def test_stream_equals_batch(spark, tmp_path):
    rows = [Row(doc_id=1, n=1, at=1, action="confirm"), Row(doc_id=1, n=1, at=2, action="reopen"), Row(doc_id=1, n=2, at=1, action="reject")]
    df = spark.createDataFrame(rows, "doc_id long, n long, at long, action string")
    df.write.parquet(str(tmp_path / "events"))
    stream = reviews.latest_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events")))
    q = reviews.to_memory(stream, "latest_reviews")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("latest_reviews").collect())) == sorted(map(tuple, reviews.latest_stream(df).collect())) == [(1, 1, 2, "reopen"), (1, 2, 1, "reject")]


@pytest.mark.parametrize(("seed", "cut"), [(1, 0), (2, 5), (3, 30), (4, 200)])
def test_title_search_is_whole(spark, seed, cut):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    works = [(f"10.{rnd.randrange(10**6)}/{i}", " ".join(rnd.choices(words, weights=range(1, 13), k=rnd.randrange(7))) + (f" r{i}" if i % 3 == 0 else "")) for i in range(600)]
    titles = [None, "", "W11", "nowhere", "w11 w10 w9 r3", *(" ".join(rnd.choices(words, k=rnd.randrange(1, 6))) + rnd.choice(["", f" r{i}", " unknown"]) for i in range(60))]
    queries = spark.createDataFrame([(1, n, t) for n, t in enumerate(titles)], "doc_id long, n long, title string")
    got = {(r.n, r.rank): (r.doi, round(r.score, 6)) for r in vf.search(queries, spark.createDataFrame(works, "doi string, title string"), most_postings=cut).collect()}
    expected = {}
    for n, t in enumerate(titles):
        a = set((t or "").lower().split())
        best = sorted((-len(a & set(b.split())), d, b) for d, b in works if a & set(b.split()))[:3]
        expected |= {(n, i + 1): (d, round(-c / min(len(a), len(set(b.split()))), 6)) for i, (c, d, b) in enumerate(best)}
    assert got == expected and len(expected) > 100
