"""Language identification by word-first backoff.

A word seen in training scores, per language, the logarithm of its relative
frequency there (a floor where it was never seen).  A word not seen falls back to
its character n-grams, longest first: the mean over the word's known n-grams of
the first length of which any is known.  A text's language is the best mean over
its words, and its score that language's share after a softmax.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from citemill.llm.common import arrow_map, bounded_batches, fresh, stored

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


class Table:
    """Strings, by their 64-bit hashes in order, and a float32 row of each; no string is held."""

    def __init__(self, strings, rows: np.ndarray):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order].astype(np.float32)

    def find(self, strings: list[str]) -> np.ndarray:
        """Places of the strings, -1 of those that it doesn't have."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


@dataclass
class Backoff:
    """langs, and tables of words and n-grams with a score for each language."""

    langs: list[str]
    words: Table
    grams: Table
    longest: int

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words, and whether anything is known of each (else, or without a letter, zeros)."""
        out, known = np.zeros((len(words), max(1, len(self.langs))), dtype=np.float32), np.zeros(len(words), dtype=bool)
        at = self.words.find(words)
        out[at >= 0], known[at >= 0] = self.words.rows[at[at >= 0]], True
        left = [i for i in np.flatnonzero(at < 0).tolist() if any(map(str.isalpha, words[i]))]
        for n in range(self.longest, 0, -1):
            some = [i for i in left if len(words[i]) + 2 >= n]
            if not some:
                continue
            grams, starts = [], []
            for i in some:
                padded = f"<{words[i]}>"
                starts.append(len(grams))
                grams += [padded[k : k + n] for k in range(len(padded) - n + 1)]
            at = self.grams.find(grams)
            hit = at >= 0
            number = np.add.reduceat(hit, starts, dtype=np.int64)
            total = np.add.reduceat(np.where(hit[:, None], self.grams.rows[at], 0), starts, axis=0) if hit.any() else np.zeros((len(some), out.shape[1]))
            place, scored = np.array(some), number > 0
            out[place[scored]], known[place[scored]] = total[scored] / number[scored, None], True
            left = [i for i in left if not known[i]]
        return out, known


class Scorer:
    """Scores texts, holding the rows of words met (a bounded table)."""

    def __init__(self, model: Backoff, most_held: int = 150_000):
        self.model, self.most_held = model, most_held
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(self.model.langs))), dtype=np.float32)
        self.counts = np.zeros(1024, dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        """Hold the rows of words not met before."""
        first, need = len(self.at), len(self.at) + len(words)
        if need > len(self.rows):
            more = max(need, 2 * len(self.rows)) - len(self.rows)
            self.rows, self.counts = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.float32)]), np.concatenate([self.counts, np.zeros(more, np.float32)])
        self.rows[first:need], self.counts[first:need] = self.model.rows(words)
        self.at.update(zip(words, range(first, need)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        return next(self.many([text]))

    def many(self, texts, together: int = 30_000) -> Iterator[tuple[str, float]]:
        """(language, score) of each text.  New words are scored together for some texts at a time."""
        held, size = [], 0
        for t in texts:
            held.append(words := WORD.findall((t or "").lower()))
            size += len(words)
            if size > together:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def _some(self, texts: list[list[str]]) -> Iterator[tuple[str, float]]:
        if len(self.at) > self.most_held:
            self.clear()
        if fresh := [w for w in set().union(*texts) if w not in self.at]:
            self.learn(sorted(fresh))
        for words in texts:
            yield self._best(words)

    def _best(self, words: list[str]) -> tuple[str, float]:
        langs, idx = self.model.langs, [self.at[w] for w in words]
        known = self.counts[idx].sum()
        if not known:
            if not langs or not any(any(map(str.isalpha, w)) for w in words):
                return UNDETERMINED, 0.0
            # letters, but none known to any language: the most common language, with no confidence
            return langs[0], 1.0 / len(langs)
        # in the order of the words, so that equal texts score alike on any worker
        total = self.rows[idx].sum(axis=0, dtype=np.float64)
        p = np.exp(min(1.0, 50.0 / known) * (total - total.max()))
        best = int(np.argmax(p))
        return langs[best], float(p[best] / p.sum())


def learn(docs: DataFrame, *, key: str, text: str, lang: str, docs_per_lang: int = 2_000, max_words: int = 200_000, max_grams: int = 200_000, least_entries: int = 1_000, longest: int = 4, floor: float = 2.0) -> Backoff:
    """Fit on a sample of about ``docs_per_lang`` rows of each language (whole texts,
    chosen by a hash of the key), all languages, and of each language
    the words and n-grams of each length that it has most of: its share of ``max_words`` and ``max_grams``, but
    ``least_entries`` at least, so no language's entries displace another's.  These parameters bound the fit and what
    reaches the driver; rows with a null text, language or key teach nothing.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("k is not null and t is not null and l is not null")
    per = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("l")).count().orderBy(F.desc("count"), "l").collect()
    langs = [r[0] for r in per]
    if not langs:
        return Backoff([], Table([], np.zeros((0, 1))), Table([], np.zeros((0, 1))), longest)
    part = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1_000_000))
    rate = F.create_map(*[x for r in per for x in (F.lit(r[0]), F.lit(min(1_000_000, max(1, 1_000_000 * docs_per_lang // r[1]))))])
    sample = rows.where(part < rate[F.col("l")])
    bounded_batches(docs.sparkSession)

    def count(cols):
        by = {}
        for t, l in zip(cols["t"], cols["l"]):
            by.setdefault(l, Counter()).update(WORD.findall(t.lower()))
        flat = [(l, w, c) for l, ws in by.items() for w, c in ws.items()]
        return dict(zip(("l", "w", "c"), map(list, zip(*flat)))) if flat else {"l": [], "w": [], "c": []}

    counts = stored(arrow_map(sample.select("t", "l"), count, "l string, w string, c bigint").groupBy("l", "w").agg(F.sum("c").alias("c")))
    place = {l: k for k, l in enumerate(langs)}

    def scored(found: DataFrame, most: int) -> Table:
        """Entries (l, g, c): those that any language has most of, with their counts in all."""
        rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("c"), "g"))
        kept = found.withColumn("r", rank).where(F.col("r") <= max(least_entries, most // len(langs))).select("g").distinct()
        rows = found.join(kept, "g", "left_semi").select("g", "l", "c").toArrow()
        strings, at = rows.column("g").combine_chunks().dictionary_encode(), rows.column("l").to_pylist()
        c = np.zeros((len(strings.dictionary), len(langs)))
        c[strings.indices.to_numpy(), [place[l] for l in at]] = rows.column("c").to_numpy()
        total = np.maximum(c.sum(axis=0), 1)
        # what a language never had costs more than its rarest entry, by ``floor``
        least = -np.log(total.max()) - floor
        return Table(strings.dictionary.to_pylist(), np.where(c > 0, np.log(np.maximum(c, 1e-12) / total), least))

    grams = []
    for n in range(1, longest + 1):
        padded = F.concat(F.lit("<"), "w", F.lit(">"))
        each = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
        grams.append(scored(counts.where(F.length("w") + 2 >= n).select("l", F.explode(each).alias("g"), "c").groupBy("l", "g").agg(F.sum("c").alias("c")), max_grams))
    words = scored(counts.withColumnRenamed("w", "g"), max_words)
    return Backoff(langs, words, joined(grams), longest)


def joined(tables: list[Table]) -> Table:
    """One table of all, which have no string in common."""
    out = Table([], np.zeros((0, 1)))
    hashes = np.concatenate([t.hashes for t in tables])
    order = np.argsort(hashes)
    out.hashes, out.rows = hashes[order], np.concatenate([t.rows for t in tables])[order]
    return out


def predictor(spark, model: Backoff):
    """A column function text -> struct(lang_pred, score)."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    scorer = None

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        nonlocal scorer
        scorer = scorer or Scorer(sent.value)
        return pd.DataFrame(list(scorer.many(texts)), columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, **fit) -> DataFrame:
    """Predict the language of every whole text: key, held_out, lang_pred, score.

    Rows whose crc32 of the key (as text) is a multiple of ``folds`` are held out;
    the others teach.  Null text, or one without a letter, gives ``und`` and 0; a
    null key teaches nothing and is not held out; if nothing teaches, all is
    ``und``; repeated rows give repeated rows; of two languages that score alike the more common one (then the first
    by name) is predicted; very long texts are scored whole; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))
    model = learn(docs.where(~held), key=key, text=text, lang=lang, **fit)
    predict = predictor(docs.sparkSession, model)
    return docs.select(F.col(key), held.alias("held_out"), predict(F.col(text).cast("string")).alias("p")).select(key, "held_out", "p.lang_pred", "p.score")


def reject_unidentified(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5, **fit) -> DataFrame:
    """Rows whose language is determined with a score of ``least`` or more, columns as they are.

    Null texts and those without a letter go, as do all where nothing teaches; a null key teaches nothing and its
    row is judged like any other; repeated rows are each judged; an empty table stays empty; of two languages that
    score alike the more common one is taken; very long texts are read whole; columns may have any names.
    """
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))
    predict = predictor(docs.sparkSession, learn(docs.where(~held), key=key, text=text, lang=lang, **fit))
    (p,) = fresh(docs, "__p")
    said = docs.withColumn(p, predict(F.col(text).cast("string")))
    return said.where((F.col(p)["lang_pred"] != UNDETERMINED) & (F.col(p)["score"] >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
