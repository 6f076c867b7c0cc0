"""Sequence packing as a cutting-stock problem solved by column generation.

Every document is tokenised and cut at multiples of the capacity; the pieces'
lengths, rounded up to ``unit`` tokens, make a histogram.  A linear program over
patterns (multisets of lengths that fit a sequence) is solved by the revised
simplex method, a knapsack dynamic program pricing new columns.  The solution is
rounded down, what is left is packed first-fit-decreasing, and the slots of the
patterns are given to the pieces by their rank within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from citemill.llm.common import arrow_map, bounded_batches, give_back, stored


# -- the cutting-stock problem (driver; its size is the histogram's) -------------
def price(duals: np.ndarray, size: int) -> np.ndarray:
    """The pattern of largest dual value: an unbounded knapsack over lengths 1..size."""
    best, take = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for w in range(1, size + 1):
        v = best[w - 1 :: -1][:w] + duals[1 : w + 1]
        k = int(np.argmax(v))
        best[w], take[w] = (v[k], k + 1) if v[k] > best[w - 1] else (best[w - 1], 0)
    pattern, w = np.zeros(size + 1, dtype=np.int64), size
    while w:
        pattern[take[w]] += 1
        w -= max(1, take[w])
    pattern[0] = 0
    return pattern


def solve(demand: np.ndarray, size: int, rounds: int = 4_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, for demand[1..size] pieces of each length."""
    kinds = np.flatnonzero(demand[: size + 1])
    kinds = kinds[kinds > 0]
    if not len(kinds):
        return []
    m = len(kinds)
    patterns = np.zeros((m, m))
    patterns[np.arange(m), np.arange(m)] = size // kinds
    inverse, x = np.diag(1 / np.diag(patterns)), demand[kinds] / (size // kinds)
    for step in range(rounds):
        duals = np.zeros(size + 1)
        duals[kinds] = inverse.sum(axis=0)
        column = price(np.maximum(duals, 0), size)[kinds].astype(float)
        if column @ duals[kinds] < 1 + 1e-7:
            break
        d = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * d
        x[out] = ratio[out]
        patterns[:, out] = column
        pivot = inverse[out] / d[out]
        inverse = inverse - np.outer(d, pivot)
        inverse[out] = pivot
        if step % 100 == 99:
            inverse = np.linalg.inv(patterns)
            x = np.maximum(inverse @ demand[kinds], 0)
    full = []
    for k in range(m):
        p = np.zeros(size + 1, dtype=np.int64)
        p[kinds] = patterns[:, k].astype(np.int64)
        full.append((p, max(0.0, float(x[k]))))
    return full


def plan(demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold every piece exactly once."""
    left, out = demand.astype(np.int64).copy(), []
    for p, x in sorted(solve(demand, size), key=lambda y: -y[1]):
        if not p.any():
            continue
        n = min(int(x + 1e-6), int((left[p > 0] // p[p > 0]).min()))
        if n:
            out.append((p, n))
            left -= n * p
    while left.any():
        # greedy over what is left: one pattern at a time, as often as it can be used
        p, room = np.zeros(size + 1, dtype=np.int64), size
        for w in range(size, 0, -1):
            n = min(int(left[w]), room // w)
            p[w], room = n, room - n * w
        n = int((left[p > 0] // p[p > 0]).min())
        out.append((p, n))
        left -= n * p
    return out


# -- tokenising ---------------------------------------------------------------
#: Words of these characters are alike before and after the normalizer but for case.
_PLAIN = re.compile(r"[!-~À-ÿ]*")
_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
#: The byte that stands for a word's end; UTF-8 never has it.
_END = b"\xff"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words:
    """Ids of a text by a tokenizer that drops white space and ends words.

    Words (split at blanks, tabs and line ends, which part words for it too) are
    encoded on their own, and those met are held, up to ``most_held`` bytes of words and ids.  A word not held goes to
    the tokenizer itself, unless it has plain characters only: then to a merge
    engine over the same vocabulary.  That engine joins any neighbours whose bytes
    make a token, by rank; as each token has one merge and encodes to itself, it
    never joins others than the tokenizer does (``self_encoding`` checks this).
    Added tokens in a text are text like any, or get their ids by ``special_as_text=False``.
    """

    def __init__(self, path: str, most_held: int = 10 << 20, *, special_as_text: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, back, suffix = config["model"], _byte_alphabet(), config["model"]["end_of_word_suffix"]
        special = {t["content"] for t in config["added_tokens"]}
        raw = lambda t: bytes(back[c] for c in t.removesuffix(suffix)) + _END * t.endswith(suffix)
        self.special = () if special_as_text else tuple(special)
        self.tokens = {t: raw(t) for t in model["vocab"] if t not in special}
        # merges rank by their place, single bytes and ends of words before them
        order = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        made = set(order)
        ranked = sorted((t for t in self.tokens if t not in made), key=lambda t: (len(self.tokens[t]), self.tokens[t])) + order
        ranks = {self.tokens[t]: k for k, t in enumerate(ranked)}
        self.fits = len(ranks) == len(ranked) == len(self.tokens) and all(bytes([b]) in ranks for b in range(256))
        self.ids = [int(model["vocab"][t]).to_bytes(4, "little") for t in ranked]
        self.engine = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe if self.fits else None
        self.held, self.size, self.most_held = {}, 0, most_held

    def forget(self) -> None:
        self.held, self.size = {}, 0

    def self_encoding(self) -> bool:
        """Whether each token is the encoding of its own characters, with the end of
        a word as one more character of the last."""
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        inner = BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        suffix, last = model["end_of_word_suffix"], self.tokenizer.model.tokenize
        one = lambda got, t: len(got) == 1 and got[0].value == t
        return self.fits and all(one(last(t.removesuffix(suffix)) if t.endswith(suffix) else inner.tokenize(t), t) for t in self.tokens)

    def word(self, w: str) -> bytes:
        if self.engine and (w.isascii() and w.isprintable() or _PLAIN.fullmatch(w)) and not any(t in w for t in self.special):
            one, ids = self.engine.encode_single_piece, self.ids
            return b"".join([ids[i] for p in _SPLIT.findall(w.lower()) for i in one(p.encode() + _END)])
        return np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out = []
        for t in texts:
            if self.size > self.most_held:
                # the older half goes
                self.held = dict(islice(self.held.items(), len(self.held) // 2, None))
                self.size = sum(len(w) + len(blob) for w, blob in self.held.items())
            held, words = self.held, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            got = list(map(held.get, words))
            if None in got:
                for k, blob in enumerate(got):
                    if blob is None:
                        w = words[k]
                        got[k] = blob = self.word(w)
                        if len(w) <= 64:
                            held[w] = blob
                            self.size += len(w) + len(blob)
            out.append(b"".join(got))
        return out


@lru_cache(2)
def _words(path: str) -> Words:
    return Words(path, special_as_text=False)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids, with ``end_id`` after them, cut at multiples of ``capacity``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(cols):
        out = {n: [] for n in (key, "start", "length", "ids_crc32", "doc_tokens")}
        for k, ids in zip(cols[key], _words(path)([t or "" for t in cols[text]])):
            ids += end
            n = len(ids) // 4
            for s in range(0, n, capacity):
                cut = ids[4 * s : 4 * (s + capacity)]
                for name, v in zip(out, (k, s, len(cut) // 4, zlib.crc32(cut), n)):
                    out[name].append(v)
        return out

    def done():
        _words(path).forget()
        give_back()

    return arrow_map(docs.select(F.col(key), F.col(text).cast("string").alias(text)), run, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", done)


# -- assignment -----------------------------------------------------------------
def pack_pieces(cut: DataFrame, capacity: int, *, key: str = "doc_id", unit: int = 16, rows_per_part: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces."""
    spark = cut.sparkSession
    size = -(-capacity // unit)
    kind = F.least(F.ceil(F.col("length") / unit), F.lit(size)).cast("int")
    parts = max(1, min(1_024, cut.count() // rows_per_part))
    # ranks within a length: parts by a hash, counted, then numbered from each part's first rank
    rows = cut.withColumn("kind", kind).withColumn("part", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(parts)).cast("int"))
    seen = rows.groupBy("kind", "part").count().collect()  # at most size * parts rows
    if not seen:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    demand, first, base = np.zeros(size + 1, dtype=np.int64), {}, 0
    for k, part, n in sorted(map(tuple, seen)):
        first[k, part] = int(demand[k])
        demand[k] += n
    slots = []  # kind, ranks from, to, pieces of the kind in a sequence, first sequence, place in the sequence
    given = np.zeros(size + 1, dtype=np.int64)
    for p, n in plan(demand, size):
        place = 0
        for w in range(size, 0, -1):
            if p[w]:
                slots.append((w, int(given[w]), int(given[w] + n * p[w]), int(p[w]), base, place))
                given[w] += n * p[w]
                place += int(p[w])
        base += n
    start = spark.createDataFrame([(k, part, f) for (k, part), f in first.items()], "kind int, part int, first long")
    slot = spark.createDataFrame(slots, "kind int, lo long, hi long, per long, base long, place long")
    rank = F.row_number().over(Window.partitionBy("kind", "part").orderBy(key, "start", "ids_crc32")) - 1
    # both tables are bounded by the parameters: size * parts rows, and the patterns' entries
    ranked = rows.withColumn("r", rank).join(F.broadcast(start), ["kind", "part"]).withColumn("rank", F.col("first") + F.col("r"))
    joined = ranked.join(F.broadcast(slot), (ranked["kind"] == slot["kind"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slot["kind"])
    j = F.col("rank") - F.col("lo")
    placed = joined.withColumn("sequence_id", F.col("base") + F.floor(j / F.col("per"))).withColumn("at", F.col("place") + F.pmod(j, F.col("per")))
    before = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*cut.columns, F.col("sequence_id").cast("long"), "offset")


def pack(docs: DataFrame, path: str, *, end_id: int = 2, capacity: int = 4096, key: str = "doc_id", text: str = "text", unit: int = 16) -> DataFrame:
    """Pack all documents: one row per piece with key, start, length, ids_crc32,
    doc_tokens, sequence_id and offset.

    Null text counts as empty and gives one piece of the end id; an empty table gives
    no rows; repeated rows are packed each; a null key is kept; other columns are
    ignored.  A sequence holds at most ``capacity`` tokens, gapless from 0.
    """
    return pack_pieces(stored(pieces(docs, path, end_id, capacity, key=key, text=text)), capacity, key=key, unit=unit)
