"""Quality classification by hierarchical empirical Bayes.

Three sources speak for a document: a classifier of its text, the labelled share of
good documents of its host, and that of its path section below the host.  Counts of
labels are aggregated by host and path; a host's share is shrunk toward the
global one, a path's toward its host's, by prior weights that the spread
between sites determines.  The text's log odds, less the prior they were fitted at, are
added to the path's posterior log odds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from citemill.llm.common import bounded_batches, fresh, stored

#: Byte classes: control, blank, line end, lower, upper, digit, stop, emphasis, bracket or quote, sign, bar, high.
_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((" \t", "\r\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "()[]{}'\"-", "#$%&*@^~_+=<>/\\`", "|"), start=1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 11
CLASSES = 12
WIDTH = CLASSES * CLASSES + 6


def features(text: str) -> np.ndarray:
    """Shares of neighbouring byte classes (square roots), and statistics of words and lines."""
    out = np.zeros(WIDTH, dtype=np.float32)
    c = _CLASS[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]
    if len(c) > 1:
        out[: CLASSES * CLASSES] = np.sqrt(np.bincount(c[:-1] * np.uint8(CLASSES) + c[1:], minlength=CLASSES * CLASSES) / (len(c) - 1))
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if n:
        kinds = len(set(words))
        out[-6:] = (math.log1p(n) / 10, kinds / n, math.log(kinds + 1) / math.log(n + 1), min(3.0, len(text) / n / 10), len(set(lines)) / len(lines), math.log1p(len(text) / len(lines)) / 10)
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -12, 12) - self.prior


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 25) -> Classifier:
    """Logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return Classifier(mean, scale, w[:-1], float(w[-1]), float(math.log(share / (1 - share))))


def prior_weight(groups: DataFrame, centre: Column, least: float = 1.0, most: float = 10_000.0) -> tuple[float, float]:
    """(share, weight): the weight of a prior, in labels, from the spread of the shares
    of rows (n, good) around ``centre`` beyond what chance gives."""
    p = F.col("good") / F.col("n")
    r = groups.agg(F.sum("n"), F.sum("good"), F.count("*"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (p - centre) * (p - centre))).first()
    if not r[0]:
        return 0.5, least
    n, good, k, squares, spread = float(r[0]), float(r[1]), r[2], float(r[3]), float(r[4])
    m = min(max(good / n, 1e-3), 1 - 1e-3)
    room = n - squares / n
    between = max(0.0, (spread - (k - 1) * m * (1 - m)) / room) if room > 0 else 0.0
    return m, min(most, max(least, m * (1 - m) / between - 1)) if between > 0 else most


def site_posteriors(labelled: DataFrame) -> tuple[float, DataFrame]:
    """From rows (host, path, good): the global share, and rows (host, path, host_posterior,
    path_posterior).  Grouped aggregation with map-side sums; a hot host is one row after."""
    paths = stored(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    share = (r := hosts.agg(F.sum("good"), F.sum("n")).first())[0] / r[1] if not hosts.isEmpty() else 0.5
    m, host_weight = prior_weight(hosts, F.lit(float(share)))
    hosts = hosts.select("host", ((F.col("good") + m * host_weight) / (F.col("n") + host_weight)).alias("host_posterior"))
    joined = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    _, path_weight = prior_weight(joined, F.col("host_posterior"))
    return m, joined.select("host", "path", "host_posterior", ((F.col("good") + F.col("host_posterior") * path_weight) / (F.col("n") + path_weight)).alias("path_posterior"))


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", sample_rows: int = 20_000, most_broadcast: int = 100_000) -> DataFrame:
    """``docs`` with evidence, host_posterior, path_posterior and quality_score (0 to 1).

    The text classifier is fitted on at most ``sample_rows`` labelled documents, chosen by
    a hash of their key; the counts by site cover all labels.  A document with several
    labels counts as good if half of them are; null labels and keys teach nothing; a site
    without labels has its host's or the global share; null or blank text scores 0; with
    no label at all every other score is 0.5; repeated rows give repeated rows; an
    empty table gives an empty result; very long texts are read whole; columns of ``docs`` stay, but for those
    of the four names that are added.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    k, good, h, p, hp, pp, h2, hh, e = fresh(docs, "__k", "__good", "__h", "__p", "__hp", "__pp", "__h2", "__hh", "evidence")
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias(k)).agg((F.avg(label) >= 0.5).cast("int").alias(good))
    sample = marks.orderBy(F.xxhash64(k), k).limit(sample_rows)

    @F.pandas_udf("array<float>")
    def describe(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in texts])

    # the sample has at most sample_rows rows, so it may be sent to all
    seen = docs.join(F.broadcast(sample), F.col(key) == F.col(k)).select(good, describe(F.col(text).cast("string")).alias("x")).toArrow()
    y = seen.column(good).to_numpy().astype(np.float64)
    model = fit(seen.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(y), -1), y) if len(y) and 0 < y.mean() < 1 else None
    sites = docs.select(F.col(key).alias(k), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")).join(marks, k).select("host", "path", F.col(good).alias("good"))
    share, posteriors = site_posteriors(sites)
    posteriors = stored(posteriors.withColumnsRenamed({"host": h, "path": p, "host_posterior": hp, "path_posterior": pp}))
    hosts = posteriors.groupBy(h).agg(F.first(hp).alias(hh)).withColumnRenamed(h, h2)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        m = sent.value
        out = np.zeros(len(texts))
        if m is not None:
            out = m.log_odds(np.stack([features(t or "") for t in texts]).astype(np.float64)) if len(texts) else out
        return pd.Series(out)

    few = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df
    out = docs.withColumn(e, evidence(F.col(text).cast("string")))
    out = out.join(few(posteriors), F.col(host).cast("string").eqNullSafe(F.col(h)) & F.col(path).cast("string").eqNullSafe(F.col(p)), "left")
    out = out.join(few(hosts), F.col(host).cast("string").eqNullSafe(F.col(h2)), "left")
    site = F.coalesce(F.col(pp), F.col(hh), F.lit(float(share)))
    odds = F.col(e) + F.log(site / (1 - site))
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s+", " ")) == ""
    added = {
        "evidence": F.col(e),
        "host_posterior": F.coalesce(F.col(hh), F.lit(float(share))),
        "path_posterior": site,
        "quality_score": F.when(blank, 0.0).when(F.lit(model is None), 0.5).otherwise(1 / (1 + F.exp(-odds))),
    }
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[c.alias(name) for name, c in added.items()])


def reject_poor(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **how) -> DataFrame:
    """Rows of ``docs`` whose quality score is ``least`` or more, columns as they are.

    Null and blank texts go; without any label all others stay, as each then scores 0.5; a row without a key is judged by
    its text and site; repeated rows are each judged; an empty table stays empty; columns may have any names.
    """
    (s,) = fresh(docs, "__score")
    names = fresh(docs, *(f"__{i}" for i in range(len(docs.columns))))
    # under names of their own, as the score's names may be taken
    own = dict(zip(docs.columns, names))
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    columns = {"key": "doc_id", "text": "text", "host": "source", "path": "lang"} | {k: v for k, v in how.items() if k in ("key", "text", "host", "path")}
    rest = {k: v for k, v in how.items() if k not in columns}
    marks = labels.withColumnRenamed(columns["key"], own[columns["key"]])
    kept = score(renamed, marks, **{k: own[c] for k, c in columns.items()}, **rest).withColumnRenamed("quality_score", s).where(F.col(s) >= least)
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
