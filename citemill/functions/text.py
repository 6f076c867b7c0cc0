"""Native text expressions: patterns in Java's dialect, offsets in code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Years, words and openings that the grammars are made of.
YEARS = (1500, 2099)
NO_DATE_WORDS = ("n.d.", "n. d.", "no date", "in press", "forthcoming", "o.j.", "o. j.", "im druck")
LINK_OPENINGS = ("http://", "https://", "doi:", "doi.org/")


def _any_of(words) -> str:
    """An alternation of literal words, blanks standing for any white space."""
    return "(?:" + "|".join(w.replace(".", r"\.").replace(" ", r"\s") for w in words) + ")"


def _years(first: int, last: int) -> str:
    """Years by their centuries."""
    whole = [f"{c:02d}" for c in range(first // 100, last // 100 + 1)]
    return "(?:" + "|".join(f"{c}[0-9][0-9]" for c in whole) + ")"


YEAR = _years(*YEARS)
NO_DATE = f"(?i:{_any_of(NO_DATE_WORDS)})"
PAREN_YEAR = rf"(?<!\d)\({YEAR}[a-z]?\b"
BARE_YEAR = rf"(?<!\d){YEAR}(?!\d)"
LINK = rf"(?:{_any_of(LINK_OPENINGS)}|10\.\d{{4,9}}/)\S+"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
URL = r"(?i)https?://[^\s)>\]\"']+"
PACKAGE_HOSTS = ("cran.r-project.org", "cran.rstudio.com", "pypi.org", "bioconductor.org", "npmjs.com", "ctan.org", "anaconda.org")
SECTION_HEADINGS = ("references", "reference list", "bibliography", "works cited", "literature cited", "literaturverzeichnis", "literatur", "quellenverzeichnis")
STOP_HEADINGS = ("appendix", "appendices", "acknowledgements", "acknowledgments", "supplementary material", "author", "authors", "author note", "author notes", "author information", "anhang", "danksagung")
PARTICLES = ("van", "von", "de", "del", "della", "den", "der", "des", "di", "dos", "du", "da", "la", "le", "ten", "ter", "zu", "zur")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normal_title(c: Column) -> Column:
    """Lower case; whatever isn't a-z or 0-9 becomes one blank; stripped."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Distinct tokens of a normal title."""
    return F.array_distinct(F.filter(F.split(normal_title(c), " "), lambda x: x != ""))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens by the smaller set's size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def normal_doi(c: Column) -> Column:
    x = F.regexp_replace(strip(c), r"^(?i)https?://(?:dx\.)?doi\.org/", "")
    return F.lower(strip(F.regexp_replace(x, r"^(?i)doi:\s*", "")))


def doi_in(c: Column) -> Column:
    """First DOI of a text, without trailing stops, normalized; null if none."""
    return normal_doi(F.nullif(F.regexp_replace(F.regexp_extract(c, DOI, 0), r"[.,;)]+\z", ""), F.lit("")))


def package_url(c: Column) -> Column:
    """First URL whose host is a package registry or below one; null if none."""
    host = lambda u: F.lower(F.try_parse_url(u, F.lit("HOST")))

    def known(u):
        out = F.lit(False)
        for h in PACKAGE_HOSTS:
            out = out | (host(u) == h) | host(u).endswith("." + h)
        return F.coalesce(out, F.lit(False))

    return F.get(F.filter(F.regexp_extract_all(c, F.lit(URL), F.lit(0)), known), F.lit(0))


def is_heading(c: Column, words) -> Column:
    """A whole line, stripped of blanks and then of colons, that is one of the words."""
    return F.lower(F.regexp_replace(strip(c), r":+\z", "")).isin(*words)


def entry_complete(c: Column) -> Column:
    """Ends as a finished reference does: a stop and closers, or a link."""
    return c.rlike(r"[.?!][\"'”)\]]*\s*\z") | c.rlike(LINK + r"\s*\z")


#: Marks of Markdown and HTML in the order they go, with what they hold (if anything) in group 1.
MARKUP = (
    ("quote", r"^\s*>\s*"),
    ("heading", r"^#{1,6}\s*"),
    ("bullet", r"^\s*[-*]\s+"),
    ("bold", r"\*\*(.+?)\*\*"),
    ("italic", r"_(.+?)_"),
    ("strike", r"~~(.+?)~~"),
    ("tag", r"</?[a-zA-Z][^<>]*>"),
)
BULLET = dict(MARKUP)["bullet"]


def strip_markup(c: Column) -> Column:
    """Without marks of Markdown and HTML, which leave what they hold."""
    for _, pattern in MARKUP:
        c = F.regexp_replace(c, "(?U)" + pattern, "$1" if "(" in pattern else "")
    return c


WORD_GAP = r"(?U)\s+"


def words_of(c: Column) -> Column:
    """Parts between white space; the first is empty if the text opens with some."""
    return F.split(c, WORD_GAP)


def _opens(c: Column, prefix: str, held) -> Column:
    """Whether ``held(word, next word)`` is true of one of the first three words of a text, behind words that
    match ``prefix`` only, the first of which is no connector."""

    def opens(w):
        at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
        plain = lambda i: at(i).rlike(prefix)
        return ~at(0).isin("and", "&") & (held(at(0), at(1)) | plain(0) & (held(at(1), at(2)) | plain(1) & held(at(2), at(3))))

    # the words are bound by a transform, so the text is split once, and no further than the fourth
    return F.get(F.transform(F.array(F.split(c, WORD_GAP, 5)), opens), F.lit(0))


#: A surname: a capital and any word's characters, apostrophes or hyphens.
SURNAME = r"[A-ZÀ-Ý](?U:[\w'-]*)"


def opens_with_initials(c: Column) -> Column:
    """``Surname, I.`` behind up to two words."""
    return _opens(c, "^[A-Za-zÀ-ÿ]+$", lambda a, b: a.rlike(rf"^{SURNAME},$") & b.rlike(r"^[A-ZÀ-Ý]\.") | a.rlike(rf"^{SURNAME},[A-ZÀ-Ý]\."))


def opens_with_capitals(c: Column) -> Column:
    """``Surname II`` behind up to two words in lower case."""
    return _opens(c, "^[a-zà-ý]+$", lambda a, b: a.rlike(rf"^{SURNAME}$") & b.rlike(r"^[A-Z]{1,4}(?!(?U:\w))"))


def opens_with_number(c: Column, shape: str | None = None) -> Column:
    """``[n]``, ``n.`` or ``n)``, or up to three bare digits before white space."""
    first = F.regexp_extract(c, r"(?U)^\s*(\S+)", 1)
    tests = {"bracket": first.rlike(r"^\[\d+\]$"), "dot": first.rlike(r"^\d+[.)]$"), "bare": first.rlike(r"^\d{1,3}$") & c.rlike(r"(?U)^\s*\d+\s")}
    return tests[shape] if shape else tests["bracket"] | tests["dot"] | tests["bare"]


def opens_entry(c: Column) -> Column:
    return opens_with_number(c) | opens_with_initials(c) | opens_with_capitals(c)


def year_key(c: Column) -> Column:
    """Lower case; every spelling of "no date" is ``n.d.``."""
    x = F.lower(strip(c))
    return F.when(x.rlike(rf"(?i)^{NO_DATE}\z"), "n.d.").otherwise(x)


def year_agreement(year: Column, years: Column, dated: Column) -> Column:
    """1.0 alike (a suffix on one side only doesn't count), 0.9 if a side is missing or the
    entry's years are uncertain, null (a veto) otherwise."""
    base = lambda y: F.regexp_replace(y, r"^(\d{4})[a-z]\z", "$1")
    one_plain = lambda y: (base(y) == base(year)) & ((y == base(y)) | (year == base(year)))
    return (
        F.when(year.isNull() | (F.size(years) <= 0), 0.9)
        .when(F.exists(years, lambda y: (y == year) | one_plain(y)), 1.0)
        .when(~dated, 0.9)
    )


def bracketed_numbers(c: Column, most: int = 40) -> Column:
    """Numbers of a group like ``1, 3-5``: ranges grow by at most ``most``; a descending,
    equal or oversize range, a zero or anything else empties the group; first kept of equals."""
    empty = F.array().cast("array<int>")
    parts = F.split(c, r"[,;]")
    lo = lambda p: F.regexp_extract(p, r"^\s*(\d{1,3})\s*(?:[-–—]\s*(\d{1,3})\s*)?\z", 1).try_cast("int")
    hi = lambda p: F.coalesce(F.regexp_extract(p, r"^\s*(\d{1,3})\s*[-–—]\s*(\d{1,3})\s*\z", 2).try_cast("int"), lo(p))
    ranged = lambda p: p.rlike(r"[-–—]")
    good = lambda p: F.coalesce((lo(p) > 0) & F.when(ranged(p), (hi(p) > lo(p)) & (hi(p) - lo(p) <= most)).otherwise(True), F.lit(False))
    grown = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(good(p), F.sequence(lo(p), F.greatest(lo(p), hi(p)))).otherwise(empty))))
    return F.when(F.forall(parts, good), grown).otherwise(empty)


def size_label(size: Column) -> Column:
    """Bytes in the unit they fill, units of 1024 with one decimal, halves to even."""
    tenths = lambda unit: F.format_string("%.1f", F.bround(size / unit, 1))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(tenths(1 << 10), F.lit(" KB"))).otherwise(F.concat(tenths(1 << 20), F.lit(" MB")))
