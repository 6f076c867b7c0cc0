"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Triplets of a sliding window of four bytes (three choices that hold its first
byte) are hashed to ``BUCKETS`` counters.  Each counter is written as the quartile
it lies in (two bits), after a header of the length (on a logarithmic scale) and
the ratios between the quartile points.  The difference of two digests sums
header differences and quartile steps (two ends of the scale count double) and is
bounded by ``BOUND``; likeness is one minus its share of that bound.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from citemill.llm.common import arrow_schema, bounded_batches, record_batch

BUCKETS, BOUND = 256, 400
#: Odd multipliers for the bytes of a triplet, one row per choice of bytes.
_MIX = np.array([[0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], [0x27D4EB2F, 0x165667B1, 0xD3A2646D], [0xFD7046C5, 0xB55A4F09, 0x8DA6B343]], dtype=np.uint32)
_TABLES = [[(np.arange(256, dtype=np.uint32) + np.uint32(1)) * m for m in row] for row in _MIX]
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)


def digest(data: bytes) -> np.ndarray:
    """Header (3 bytes) and quartile codes (BUCKETS values of 0 to 3)."""
    b = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(3 + BUCKETS, dtype=np.uint8)
    out[0] = min(255, round(8 * math.log2(1 + len(b))))
    if len(b) < 4:
        # too short for a window: the bytes themselves mark buckets, so equal texts stay equal and others differ
        for k, x in enumerate(data):
            out[3 + (int(_TABLES[0][k][x]) >> 16) % BUCKETS] = 3
        return out
    w, x, y, z = b[:-3], b[1:-2], b[2:-1], b[3:]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for (t0, t1, t2), (p, q) in zip(_TABLES, ((x, y), (x, z), (y, z))):
        h = t0[w]
        h ^= t1[p]
        h *= np.uint32(0x2C1B3C6D)
        h ^= t2[q]
        h *= np.uint32(0x297A2D39)
        counts += np.bincount(h >> shift, minlength=BUCKETS)
    s = np.sort(counts)
    q1, q2, q3 = (int(s[k * BUCKETS // 4 - 1]) for k in (1, 2, 3))
    out[1], out[2] = (15 * q1 // q3, 15 * q2 // q3) if q3 else (0, 0)
    out[3:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return out


def encode(d: np.ndarray) -> str:
    q = d[3:].reshape(-1, 4)
    return (d[:3].tobytes() + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes()).hex()


def decode(s: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(s), dtype=np.uint8)
    q = raw[3:]
    return np.concatenate([raw[:3], np.stack([q >> 6, q >> 4 & 3, q >> 2 & 3, q & 3], axis=1).reshape(-1)])


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 for equal digests, at most BOUND."""
    head = np.abs(a[:3].astype(np.int64) - b[:3])
    return int(min(BOUND, head.sum() + _STEP[a[3:], b[3:]].sum()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b) / BOUND


def ordered_neighbours(docs: DataFrame, key: str, text: str, rows_per_block: int) -> DataFrame:
    """Rows (block, look, key, text), each block in one partition, in descending
    key order; after a block's rows come those of the next block's first key, marked
    ``look``, so that each row's successor is in its own block.  Blocks are ranges
    of about equal numbers of rows; the texts are shuffled once."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    ids = docs.select(order.alias("o"))
    n = ids.count()
    blocks = max(1, min(20_000, n // rows_per_block))
    cuts = ids.select(F.col("o").cast("double").alias("o")).approxQuantile("o", [k / blocks for k in range(1, blocks)], 1 / (4 * blocks)) if blocks > 1 else []
    splits = [-math.inf, *sorted({math.floor(c) + 0.5 for c in cuts}), math.inf]
    if len(splits) > 2:
        to_block = lambda df: Bucketizer(splits=splits, inputCol="d", outputCol="r").transform(df.withColumn("d", F.col("o").cast("double"))).withColumn("block", (F.lit(len(splits) - 2) - F.col("r")).cast("int")).drop("d", "r")
    else:
        to_block = lambda df: df.withColumn("block", F.lit(0))
    # one row a block, at most 20,000
    heads = sorted((r[0], r[1]) for r in to_block(ids).groupBy("block").agg(F.max("o").alias("head")).collect())
    place = docs.sparkSession.createDataFrame([(b, h, heads[k - 1][0]) for k, (b, h) in enumerate(heads)], "block int, head long, before int")
    placed = to_block(rows.withColumn("o", order)).join(F.broadcast(place), "block")
    own = F.struct(F.col("block"), F.lit(0).alias("look"))
    extra = F.struct(F.col("before").alias("block"), F.lit(1).alias("look"))
    out = placed.withColumn("at", F.explode(F.when(F.col("o") == F.col("head"), F.array(own, extra)).otherwise(F.array(own))))
    out = out.select("at.block", "at.look", F.col("o"), F.col(key), F.col(text))
    return out.repartition(len(heads), "block").sortWithinPartitions("block", "look", F.desc("o"), text).drop("o") if heads else out.drop("o")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rows_per_block: int = 4_000) -> DataFrame:
    """Digest of every whole text and of its edited text (second half replaced by
    as many first characters of the next document, by descending key; after the last
    comes the first), with the likeness of a text to its edited text and to the next.

    Null text counts as empty; a null key sorts last and is kept; rows of equal
    key follow each other by text; a single row is its own successor; an empty
    table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    out = arrow_schema(schema)

    def run(batches):
        held = None  # (block, key, text, digest) of the row whose successor is awaited
        for batch in batches:
            rows = []
            for block, look, k, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if look and (held is None or held[0] != block):
                    continue
                d = digest(t.encode("utf-8"))
                if held is not None and held[0] == block:
                    _, hk, ht, hd = held
                    half = len(ht) // 2
                    edited = (ht[: len(ht) - half] + t[:half]).encode("utf-8")
                    e = digest(edited)
                    rows.append((hk, len(ht), hashlib.sha256(edited).hexdigest(), encode(hd), encode(e), likeness(hd, e), likeness(hd, d)))
                held = None if look else (block, k, t, d)
            if rows:
                yield record_batch(out, zip(*rows))

    return ordered_neighbours(docs, key, text, rows_per_block).mapInArrow(run, schema)
