"""Byte-level BPE by a monoid tree reduction.

A text is halved until the parts are short, the parts are encoded as texts of their
own, and neighbours are joined up the tree.  A join re-encodes a window about the place
where they meet and keeps the tokens outside; the window grows until these are
provably what they are in the whole.

*Seams.*  A single space between two characters that aren't white space always starts
a match, whatever surrounds it.  Whether a position is one depends on three characters only,
so where these lie in one part, the part's tokens up to the seam (left) or from it on
(right) are those of the whole: the window grows on each side until it has a
seam there, or has all of that part.

*Pieces.*  A window may be long where no seam is (a page without blanks).  It is then
a list of pieces ``(text, ids)``, one per match of the pattern, halved and joined the
same way: the join scans the text about the place again and widens it until

* left of it, a piece's match neither ended at the place nor could have looked over
  it (the pattern looks at most ``LOOK`` characters beyond the start of a literal
  alternative, and one beyond the end of a run);
* right of it, the new scan starts a match where the old scan of the right part started
  one: scanning has no memory beyond its position, so both go on alike.

*Tokens.*  Inside one long match (thousands of letters) the same reduction works on bytes: a token list is the BPE encoding of its bytes exactly
if each adjacent pair is the encoding of its two tokens' bytes, so a join
re-encodes a growing window of tokens until both pairs at its ends pass.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from citemill.llm.common import arrow_map, bounded_batches

#: Characters that an alternative of the pattern may look at beyond its start.
LOOK = 3
#: Longest text encoded without halving, and longest match without halving.
LEAF_CHARS, LEAF_BYTES = 512, 512
#: Characters on each side of a place of joining that a window begins with.
WINDOW = 16
_SEAM = re.compile(r"(?<=\S) (?=\S)")


class Ranks:
    """The ranks of a vocabulary file, and encoding and decoding with them."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).finditer
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.joins = self.widened = 0
        self.pair_ok = lru_cache(1 << 16)(self._pair_ok)

    # -- inside one match -------------------------------------------------
    def _single(self, data: bytes) -> list[int]:
        return self.core._encode_single_piece(data)

    def _pair_ok(self, a: int, b: int) -> bool:
        return self._single(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        self.joins += 1
        width = 4
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            mid = self._single(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.pair_ok(left[i - 1], mid[0])) and (j == len(right) or self.pair_ok(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            width *= 2
            self.widened += 1

    def match_ids(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if len(data) <= self.leaf_bytes:
            return self._single(data)
        half = len(data) // 2
        return self._join_tokens(self.match_ids(data[:half]), self.match_ids(data[half:]))

    # -- over matches ---------------------------------------------------------
    def _pieces(self, text: str) -> list[tuple[str, list[int]]]:
        return [(m := x.group(), self.match_ids(m.encode("utf-8"))) for x in self.find(text)]

    def _join_pieces(self, left, right):
        if not left or not right:
            return left or right
        self.joins += 1
        width = 2
        while True:
            # left edge: the window's first piece must start before anything that saw the seam
            i, reach = len(left), 0
            while i and (reach < LOOK or len(left) - i < width):
                i -= 1
                reach += len(left[i][0])
            j = min(len(right), width)
            head = "".join(t for t, _ in left[i:])
            starts, at = {}, len(head)
            for k in range(j):
                starts[at] = k
                at += len(right[k][0])
            # the text a little beyond the window decides where its last matches end
            tail = "".join(t for t, _ in right[j : j + LOOK + 1])
            known = dict(left[i:]) | dict(right[:j])
            mid = []
            for m in self.find(head + "".join(t for t, _ in right[:j]) + tail):
                if m.start() in starts and m.start() >= len(head):
                    return left[:i] + mid + right[starts[m.start()] :]
                if m.end() > at and j < len(right):
                    break
                mid.append((m.group(), known.get(m.group()) or self.match_ids(m.group().encode("utf-8"))))
            else:
                if j == len(right):
                    return left[:i] + mid
            width *= 2
            self.widened += 1

    def _tree(self, text: str):
        if len(text) <= self.leaf_chars:
            return self._pieces(text)
        half = len(text) // 2
        return self._join_pieces(self._tree(text[:half]), self._tree(text[half:]))

    # -- over parts of a text ------------------------------------------------------
    def _window(self, text: str) -> list[int]:
        """Ids of a text that starts and ends where a match does; it has no seam inside or is short."""
        if len(text) <= self.leaf_chars and len(text) <= self.leaf_bytes:
            return self.core.encode_ordinary(text)
        return [i for _, ids in self._tree(text) for i in ids]

    def _kept(self, ids: list[int], size: int, last: bool) -> list[int]:
        """Ids without those of the last (or first) ``size`` bytes."""
        n = 0
        while size:
            n += 1
            size -= len(self.bytes_of[ids[-n if last else n - 1]])
        return ids[: len(ids) - n] if last else ids[n:]

    def _join(self, text: str, start: int, place: int, stop: int, left: list[int], right: list[int]) -> list[int]:
        self.joins += 1
        width = WINDOW
        while True:
            a, b = max(start, place - width), min(stop, place + width)
            # a seam and what is beside it lie on one side of the place
            before = next(iter([m.start() for m in _SEAM.finditer(text[a:place])][-1:]), None)
            after = _SEAM.search(text[place:b])
            lo = start if before is None and a == start else None if before is None else a + before
            hi = stop if after is None and b == stop else None if after is None else place + after.start()
            if lo is not None and hi is not None:
                break
            width *= 2
            self.widened += 1
        head = self._kept(left, len(text[lo:place].encode("utf-8")), True)
        tail = self._kept(right, len(text[place:hi].encode("utf-8")), False)
        return [*head, *self._window(text[lo:hi]), *tail]

    def _reduce(self, text: str, start: int, stop: int) -> list[int]:
        if stop - start <= self.leaf_chars:
            part = text[start:stop]
            # a leaf without a seam may be one long match, which has a tree of its own
            return self._window(part) if _SEAM.search(part) is None else self.core.encode_ordinary(part)
        half = (start + stop) // 2
        return self._join(text, start, half, stop, self._reduce(text, start, half), self._reduce(text, half, stop))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, equal to encoding it at once.  ``joins`` and ``widened`` count the joins and how often
        a window grew."""
        self.joins = self.widened = 0
        if len(text) > self.leaf_chars and _SEAM.search(text) is None:
            return self._window(text)
        return self._reduce(text, 0, len(text))

    def decode(self, ids: list[int], leaf: int = 8_192) -> bytes:
        """Bytes of ids, concatenated up a tree: (bytes, +, b'') is the monoid."""
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + leaf])) for i in range(0, len(ids), leaf)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]


@lru_cache(4)
def _ranks(path: str, pattern: str, leaf_chars: int, leaf_bytes: int) -> Ranks:
    return Ranks(path, pattern, leaf_chars, leaf_bytes)


def clean(text: str | None) -> str:
    """Null is the empty text; lone surrogates can't come from UTF-8 columns."""
    return text or ""


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", key: str = "doc_id", keep_ids: bool = False, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Encode each whole text, decode the ids, and return one row per input row:
    key, n_tokens, ids_sha256, decoded_sha256, how many joins the tree had and how often
    their windows grew (``joins``, ``widened``), and with ``keep_ids`` the ids.

    Null text counts as empty (no ids, digests of no bytes); repeated rows give
    repeated rows; a null key is kept; an empty table gives an empty result; other
    columns are ignored.  Rows are independent: no shuffle, and memory is bounded
    by one batch and the longest text.
    """
    bounded_batches(docs.sparkSession)

    def run(cols):
        enc = _ranks(path, pattern, leaf_chars, leaf_bytes)
        out = {key: cols[key], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "joins": [], "widened": [], "ids": []}
        for t in map(clean, cols[text]):
            ids = enc.encode(t)
            out["n_tokens"].append(len(ids))
            out["joins"].append(enc.joins)
            out["widened"].append(enc.widened)
            out["ids_sha256"].append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode(ids)).hexdigest())
            if keep_ids:
                out["ids"].append(ids)
        return out

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, joins bigint, widened bigint" + ", ids array<int>" * keep_ids
    return arrow_map(docs.select(F.col(key), F.col(text).cast("string").alias(text)), run, schema)
