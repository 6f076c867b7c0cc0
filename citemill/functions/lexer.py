"""One pass over a text into tokens, dates by position, and a state machine for author runs.

Every token has one letter for its kind, so that a whole text's kinds are one string.
Recognisers step along that string; tables of words decide, not patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property, lru_cache
from itertools import accumulate

from citemill.functions.text import NO_DATE_WORDS, PARTICLES, YEARS

_PIECE = re.compile(r"[^\W\d_][\w'’\-]*|\d+|\s+|.", re.DOTALL)
_MAY_DATE = re.compile(rf"[\d{''.join({w[0] for w in NO_DATE_WORDS})}]", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_OPENING = re.compile(rf"(?:{_PIECE.pattern}){{0,16}}", re.DOTALL)

# Words that join or close a list of authors.
AND, ET, AL, ALII, U, A = {"and", "und"}, "et", "al", "alii", "u", "a"

#: Kinds: N capitalised word, I a capital before a stop, P particle, J connector, E L M U A parts
#: of "and others", w any other word, 9 digits, blank for white space, marks for themselves.
WORDS = frozenset("NIPJELMUAw")


def latin(c: str) -> bool:
    """A letter of basic or Western Latin, with what their block holds besides."""
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def capital(c: str) -> bool:
    return "A" <= c <= "Z" or "À" <= c <= "Ý"


def letters_only(word: str) -> bool:
    return all(map(latin, word))


@lru_cache(1 << 16)
def _kind(piece: str) -> str:
    """The kind of a piece; a capital alone is an I, which only a stop behind it leaves so."""
    first = piece[0]
    if first.isdecimal():
        return "9"
    if first.isspace():
        return " "
    if not first.isalnum():
        return "J" if piece == "&" else piece
    if piece in PARTICLES:
        return "P"
    if piece in AND:
        return "J"
    if (k := {ET: "E", AL: "L", ALII: "M", U: "U", A: "A"}.get(piece)) is not None:
        return k
    if not capital(first) or not all(latin(c) or c in "'’-" for c in piece):
        return "w"
    return "I" if len(piece) == 1 else "N"


class Tokens:
    """Tokens of a text: ``kinds`` (a string), ``starts`` and ``words``."""

    def __init__(self, text: str):
        self.text, self.words = text, _PIECE.findall(text)
        # pieces follow each other without a gap
        self.starts = list(accumulate(map(len, self.words), initial=0))[:-1]
        kinds = list(map(_kind, self.words))
        for i in [i for i, k in enumerate(kinds) if k == "I"]:
            if self.words[i + 1 : i + 2] != ["."]:
                kinds[i] = "N"
        self.kinds = "".join(kinds)

    def at(self, position: int) -> int:
        """Index of the first token that starts at ``position`` or later."""
        return bisect_left(self.starts, position)

    def stop(self, i: int) -> int:
        return self.starts[i] + len(self.words[i])

    @cached_property
    def years(self) -> list[int]:
        """Positions of the years that touch no other digit."""
        return [p for p, k, w in zip(self.starts, self.kinds, self.words) if k == "9" and is_year(w)] + self._years_in_words

    @cached_property
    def _years_in_words(self) -> list[int]:
        # digits inside a word, like those of "x2010", are years too where no digit touches them
        return [p + m.start() for p, k, w in zip(self.starts, self.kinds, self.words) if k in WORDS and not w.isalpha() for m in re.finditer(r"\d+", w) if is_year(m.group())]


def opening(text: str) -> str:
    """The first 16 tokens of a text."""
    return _OPENING.match(text).group()


def year_places(text: str) -> list[int]:
    """``Tokens.years`` in order, without tokens."""
    return [m.start() for m in _DIGITS.finditer(text) if is_year(m.group())]


def is_year(digits: str) -> bool:
    return len(digits) == 4 and digits.isdecimal() and YEARS[0] <= int(digits) <= YEARS[1]


_NO_DATE_FIRST = frozenset(w[0] for w in NO_DATE_WORDS)


def no_date_at(text: str, i: int) -> int:
    """Where a "no date" word that starts at i stops; 0 if none does."""
    if text[i : i + 1].lower() not in _NO_DATE_FIRST:
        return 0
    for w in NO_DATE_WORDS:
        if all((a.isspace() if b == " " else a.lower() == b) for a, b in zip(text[i : i + len(w)], w)) and len(text) >= i + len(w):
            return i + len(w)
    return 0


def date_at(text: str, i: int, suffix: bool = True) -> int:
    """Where a date that starts at i stops: a year and its letter, or a "no date" word; 0 if there is none."""
    if text[i : i + 1].isdecimal():
        if not is_year(text[i : i + 4]):
            return 0
        return i + 5 if suffix and "a" <= text[i + 4 : i + 5] <= "z" else i + 4
    return no_date_at(text, i)


def dates(text: str) -> list[tuple[int, int]]:
    """Spans of the dates in a text that touch no digit, nor follow a stop."""
    out, i = [], 0
    while m := _MAY_DATE.search(text, i):
        i = m.start()
        before = text[i - 1 : i] if i else ""
        stop = 0 if before == "." or before.isdecimal() else date_at(text, i)
        if stop and text[stop : stop + 1].isdecimal():
            stop = date_at(text, i, suffix=False)
            stop = 0 if text[stop : stop + 1].isdecimal() else stop
        if stop:
            out.append((i, stop))
        i = stop or i + 1
    return out


def slots(text: str) -> list[tuple[int, int]]:
    """Spans of date slots: an opening parenthesis with a year, its letter and a word's end, or with a
    "no date" word and the closing one."""
    out, i = [], text.find("(")
    while i >= 0:
        stop = date_at(text, i + 1)
        if stop and text[i + 1].isdecimal():
            after = text[stop : stop + 1]
            if not (i and text[i - 1].isdecimal()) and not (after.isalnum() or after == "_"):
                out.append((i, stop))
        elif stop and text[stop : stop + 1] == ")":
            out.append((i, stop + 1))
        i = text.find("(", i + 1)
    return out


def year_slots(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b in slots(text) if text[a + 1].isdecimal()]


# -- author runs ----------------------------------------------------------------------
#: Names (initials, particles, surname) with commas or connectors between, and others after.
_STEPS = {
    "name": {"I": "initial", "P": "particle", "N": "done"},
    "initial": {".": "stop"},
    "stop": {" ": "stop", "I": "initial", "P": "particle", "N": "done"},
    "particle": {" ": "particle, gap"},
    "particle, gap": {"P": "particle", "N": "done"},
    "done": {" ": "gap", ",": "comma"},
    "gap": {",": "comma", "J": "connector", "E": "et", "U": "u"},
    "comma": {" ": "comma", "J": "connector", "E": "et", "U": "u", "I": "initial", "P": "particle", "N": "done"},
    "connector": {" ": "name"},
    "et": {" ": "et, gap"},
    "et, gap": {"L": "al", "M": "closed"},
    "al": {".": "closed"},
    "u": {".": "u, stop"},
    "u, stop": {" ": "u, stop", "A": "a"},
    "a": {".": "closed"},
    "closed": {},
}
_WHOLE = {"done", "al", "closed"}
MOST_NAMES, MOST_INITIALS = 5, 3


def author_run(tokens: Tokens, first: int, stop: int) -> bool:
    """Whether tokens ``first`` to ``stop`` are a run of authors, from end to end."""
    state, names, initials = "name", 0, 0
    for i in range(first, stop):
        state = _STEPS[state].get(tokens.kinds[i])
        if state is None:
            return False
        if state == "initial":
            initials += 1
            if initials > MOST_INITIALS:
                return False
        elif state == "done":
            names, initials = names + 1, 0
            if names > MOST_NAMES:
                return False
    return state in _WHOLE


def words_before(text: str, position: int, most: int) -> list[str]:
    """The last ``most`` words before a position, the nearest first."""
    reach = 16 * (most + 1)
    while True:
        words = text[max(0, position - reach) : position].split()
        # the first word of a window may be cut
        if len(words) > most or reach >= position:
            return words[: -most - 1 : -1]
        reach *= 4
